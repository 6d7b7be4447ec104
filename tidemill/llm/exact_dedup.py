"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, repeats_ids, scratch, text_or_empty
from .components import dealt_join

#: The characters that do not count, ASCII white space.
IGNORED = "\x09\x0a\x0b\x0c\x0d\x20"
#: Fingerprints that a filter holds before it is handed on.
FILTER_ENTRIES = 2_000_000
#: Share of a filter's slots that are used at most.
LOAD = 0.75
#: Bits of a fingerprint. Of n distinct texts another shares one's fingerprint with probability n / 2 ** BITS: 5e-9 for 10 ** 11.
BITS = 64


class QuotientFilter:
    """A counting quotient filter, made at once from sorted fingerprints.

    The top q bits of a fingerprint are its quotient, the place of its canonical slot; the others, its remainder,
    are what a slot holds. The remainders of a quotient are a run of neighbouring slots, sorted,
    moved on where slots before it are taken. Bits of a slot: occupied (its own quotient has a run), continuation
    (not the first of a run), shifted (not in the canonical slot) and counter (a digit, base 2 ** r, of the count less one
    of the remainder before it; the lowest digit first). So a remainder that occurs once takes one slot. A slot is free if no bit is set
    and nothing of a fingerprint is lost: filters of any sizes merge as sorted streams.
    """

    def __init__(self, q: int, r: int, slots: np.ndarray, bits: np.ndarray):
        self.q, self.r, self.slots, self.bits = q, r, slots, bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, q: int | None = None, counts: np.ndarray | None = None, width: int = BITS) -> QuotientFilter:
        """Of fingerprints of `width` bits, each with its count; q follows from their number and LOAD if not given."""
        order = np.argsort(fingerprints, kind="stable")
        fp = fingerprints[order]
        own = np.ones(len(fp), dtype=np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, dtype=np.int64)
        fp, own = fp[first], np.add.reduceat(own, first) if len(first) else own
        if q is None:
            q = min(width - 8, max(1, int(np.ceil(np.log2(max(len(fp), 1) / LOAD)))))
        r = width - q
        quotient, remainder = (fp >> np.uint64(r)).astype(np.int64), fp & np.uint64((1 << r) - 1)
        digits = np.zeros(len(fp), dtype=np.int64)
        left = own - 1
        while (left > 0).any():
            digits += left > 0
            left = left >> min(r, 62)
        size = 1 + digits
        before = np.cumsum(size) - size
        place = before + np.maximum.accumulate(quotient - before) if len(fp) else before
        n = max(1 << q, int(place[-1] + size[-1])) if len(fp) else 1 << q
        slots, bits = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint8)
        slots[place] = remainder
        head = np.concatenate([[True], quotient[1:] != quotient[:-1]]) if len(fp) else np.zeros(0, dtype=bool)
        bits[place] = np.where(head, 0, CONTINUATION) | np.where(place != quotient, SHIFTED, 0)
        left = own - 1
        for k in range(1, int(digits.max(initial=0)) + 1):
            more = digits >= k
            slots[place[more] + k] = left[more].astype(np.uint64) & np.uint64((1 << r) - 1)
            bits[place[more] + k] = CONTINUATION | SHIFTED | COUNTER
            left = left >> min(r, 62)
        bits[quotient[head]] |= OCCUPIED
        return cls(q, r, slots, bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, sorted, and their counts."""
        used = np.flatnonzero(self.bits & (OCCUPIED | CONTINUATION | SHIFTED))
        bits = self.bits[used]
        quotients = np.flatnonzero(self.bits & OCCUPIED)
        run = np.cumsum((bits & CONTINUATION) == 0) - 1
        entry = np.flatnonzero((bits & COUNTER) == 0)
        fp = (quotients[run[entry]].astype(np.uint64) << np.uint64(self.r)) | self.slots[used[entry]]
        counts = np.ones(len(entry), dtype=np.int64)
        digit = np.flatnonzero(bits & COUNTER)
        if len(digit):
            of = np.searchsorted(entry, digit, side="right") - 1
            power = (digit - entry[of] - 1) * self.r
            np.add.at(counts, of, self.slots[used[digit]].astype(np.int64) << np.minimum(power, 62))
        return fp, counts

    def fingerprints(self) -> np.ndarray:
        return self.entries()[0]

    def slot(self, quotient: int) -> tuple[np.ndarray, np.ndarray]:
        """The remainders of a quotient, sorted, and their counts."""
        fp, counts = self.entries()
        own = fp >> np.uint64(self.r) == np.uint64(quotient)
        return fp[own] & np.uint64((1 << self.r) - 1), counts[own]

    def to_bytes(self) -> bytes:
        """Slots in as few whole bytes as a remainder needs, and four bits each."""
        size = -(-self.r // 8)
        raw = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        bits = np.append(self.bits, np.zeros(len(self.bits) % 2, dtype=np.uint8))
        return bytes([self.q, self.r]) + len(self.slots).to_bytes(8, "little") + raw.tobytes() + (bits[::2] | bits[1::2] << 4).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        q, r, n = data[0], data[1], int.from_bytes(data[2:10], "little")
        size = -(-r // 8)
        slots = np.zeros((n, 8), dtype=np.uint8)
        slots[:, :size] = np.frombuffer(data, np.uint8, n * size, 10).reshape(n, size)
        two = np.frombuffer(data, np.uint8, offset=10 + n * size)
        return cls(q, r, slots.reshape(-1).view("<u8"), np.stack([two & 15, two >> 4], 1).reshape(-1)[:n])


OCCUPIED, CONTINUATION, SHIFTED, COUNTER = (np.uint8(1 << k) for k in range(4))


def merge_runs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of several filters: sorted remainders merged, counts of equal ones added."""
    remainders = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(remainders, kind="stable")  # a merge sort: it finds the sorted runs
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]]))
    return remainders[first], np.add.reduceat(counts, first)


def normalised(c: str = "text") -> Column:
    return F.translate(text_or_empty(c), IGNORED, "")


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp) -> (fp, n) of those that occur more than once, by filters built per partition and merged.

    Each partition's fingerprints are parted by their top bits, several parts for each shuffle task, and
    every part is a filter of the other bits, as large as its own number needs. The filters of a part are merged by their sorted
    remainders, one after another. A fingerprint that many rows have is one entry of each filter.
    """
    top = int(np.ceil(np.log2(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))) + 2
    width = BITS - top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            fp, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (fp >> np.uint64(width)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own = [QuotientFilter.build(fp[a:z] & np.uint64((1 << width) - 1), None, counts[a:z], width).to_bytes() for a, z in zip(cut, np.append(cut[1:], len(fp)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(own, pa.binary())], names=["part", "filter"])

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += b.num_rows
            if n >= FILTER_ENTRIES:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def close():
            fp, counts = merge_runs(runs)
            more = counts > 1
            fp = (np.uint64(now) << np.uint64(width)) | fp[more]
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(counts[more])], names=["fp", "n"])

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != now and runs:
                    yield close()
                    runs = []
                now = part
                runs.append(QuotientFilter.from_bytes(data).entries())
                if len(runs) >= MERGED:
                    runs = [merge_runs(runs)]
        if runs:
            yield close()

    built = fingerprints.mapInArrow(build, "part int, filter binary")
    return built.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "fp long, n long")


#: Filters of a part that are merged at once.
MERGED = 64


def _order(text: str = "text") -> Column:
    """What the row that stays has least of: an unknown doc_id, brevity, a large doc_id, and a large digest of its own text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), (-F.length(text_or_empty(text))).alias("brevity"), F.col("doc_id").alias("doc_id"), F.sha2(text_or_empty(text), 256).alias("own"))


def _digest(x) -> Column:
    """The 32 bytes of a text's sha256."""
    return F.unhex(F.sha2(x, 256))


def _groups(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """Groups of equal texts, by their very bytes, among rows of a repeated fingerprint: _sha, the row that stays, _size."""
    routed = docs.select("doc_id", normalised().alias("_norm"), _order().alias("_order")).withColumn("_fp", F.xxhash64("_norm"))
    routed = routed.join(bounded(hot.select(F.col("fp").alias("_fp")), hot), "_fp")
    groups = routed.groupBy("_norm").agg(F.count("*").alias("_size"), F.min("_order").alias("_first")).where("_size > 1")
    return groups.select(_digest("_norm").alias("_sha"), F.col("_first.doc_id").alias("_first"), F.unhex("_first.own").alias("_own"), "_size", F.col("_size").alias("n"))


def _decided(docs: DataFrame) -> DataFrame:
    """doc_id, _row (all columns), _sha, _keep, _size and _best: whether the row is like the one that stays.

    Where groups are too many to be broadcast, rows move with digests in place of the text, unless _row is asked for.
    """
    docs = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    fp = F.xxhash64(normalised())
    with scratch() as keep:
        hot = keep(materialise(repeated_fingerprints(docs.select(fp.alias("_fp"))), "fingerprints"))
        groups = materialise(_groups(docs, hot), "copies")
    own = docs.select("doc_id", "_row", _digest(normalised()).alias("_sha"), _digest(text_or_empty()).alias("_self"))
    few = bounded(groups)
    out = dealt_join(own, groups, "_sha", "left") if few is groups else own.join(few.drop("n"), "_sha", "left")
    copy = F.col("_size").isNotNull()
    best = F.col("_first").eqNullSafe(F.col("doc_id")) & (F.col("_self") == F.col("_own"))
    out = out.withColumns({"_keep": F.when(copy, F.col("_first")).otherwise(F.col("doc_id")), "_best": F.when(copy, best).otherwise(F.lit(True))})
    return out.withColumn("_size", F.coalesce("_size", F.lit(1)).cast("long")).drop("_first", "_own", "_self")


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text is empty, and empties are
    equal to each other. The row with the most code points, then the smallest doc_id, stays; where rows repeat a
    doc_id, then the one of the smallest digest, and of rows that are alike in all this, one. So each group
    has one row that is kept. A null doc_id loses to any other; in a group with null ids only, keep_id is null.
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    out = _decided(docs).select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_best").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    if not repeats_ids(docs, nulls=True):
        return out
    # Rows that are alike in doc_id and text are counted, and the first of them is kept.
    alike = out.where("kept").groupBy(*out.columns).agg(F.count("*").alias("_n"))
    blocks = alike.withColumn("_b", F.explode(F.expr(f"sequence(0L, (_n - 1) DIV {BLOCK})")))
    each = blocks.withColumn("_i", F.explode(F.expr(f"sequence(_b * {BLOCK}, least(_n, (_b + 1) * {BLOCK}) - 1)")))
    return out.where("NOT kept").unionByName(each.withColumn("kept", F.col("_i") == 0).select(*out.columns))


#: Rows that one row of counted copies is spread to at once.
BLOCK = 4096


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    found = _decided(docs).where("_best").select("_row", "_sha", "_size")
    if not repeats_ids(docs, nulls=True):
        return found.select("_row.*")
    copies = found.where("_size > 1").dropDuplicates(["_sha"])
    return found.where("_size = 1").unionByName(copies).select("_row.*")
