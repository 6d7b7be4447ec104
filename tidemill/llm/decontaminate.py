"""Benchmark decontamination: suffix arrays of training text, searched with every benchmark suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_long, codes, column_bytes, delimiters, discard, equal_spans, materialise, slices, small_batches, span_hashes, text_or_empty

#: Bytes that part words once A-Z are lowered; all but 0-9, a-z and bytes from 0x80.
WORD_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
DELIM_TABLE = delimiters(WORD_DELIMITERS)
#: Text bytes of one shard, which has one suffix array.
SHARD_BYTES = 8 << 20
#: Benchmark text bytes that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20


@dataclass
class Block:
    """Part of a benchmark: words as codes from 1 of a vocabulary, one item after another.

    vocab has the hashes of the distinct words, sorted, under a salt that gives no two of them one
    hash; buf with starts and ends has the words themselves, to compare with.
    """

    salt: int
    vocab: np.ndarray
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    item_at: np.ndarray
    ids: list[str]
    window: int

    @classmethod
    def build(cls, items: list[tuple[str, str]], window: int) -> Block:
        texts = pa.array([t for _, t in items], pa.large_string())
        buf, off = column_bytes(texts)
        w = Words(buf, off, DELIM_TABLE, lower=True)
        first, code = codes(w.buf, w.starts, w.ends)
        starts, ends, salt = w.starts[first], w.ends[first], 0
        while len(np.unique(vocab := span_hashes(w.buf, starts, ends, salt))) < len(starts):
            salt += 1
        order = np.argsort(vocab)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(1, len(order) + 1)
        return cls(salt, vocab[order], w.buf, starts[order], ends[order], place[code], w.doc_at, [i for i, _ in items], window)

    def encode(self, w: Words) -> np.ndarray:
        """The code of each word, 0 for one that no item has, by its bytes."""
        out = np.zeros(len(w.starts), dtype=np.int64)
        if len(self.vocab):
            hashes = w.hashed(self.salt)
            at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
            met = np.flatnonzero(self.vocab[at] == hashes)
            at = at[met]
            same = equal_spans(w.buf, w.starts[met], w.ends[met], self.buf, self.starts[at], self.ends[at])
            out[met[same]] = at[same] + 1
        return out

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every suffix of every item: its first word, its length and its item."""
        n = np.diff(self.item_at)
        item = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(self.codes))
        return start, self.item_at[item + 1] - start, item


class SuffixArray:
    """The suffixes of a code sequence that start with a code above 0, in order.

    Built by doubling: order by the first h codes gives that by 2h, and only suffixes still tied are
    sorted again. Order beyond `depth` codes does not matter to a search and is left open.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq = np.concatenate([seq, np.zeros(1, dtype=np.int64)])
        n = len(seq)
        at = np.flatnonzero(seq)
        rank = np.zeros(n + 1, dtype=np.int64)
        rank[at] = seq[at]
        order = at[np.argsort(rank[at], kind="stable")]
        self.order = order
        if not len(order):
            return
        rank[order] = _first_places(rank[order])
        h = 1
        while h < depth:
            same = np.empty(len(order), dtype=bool)
            r = rank[order]
            same[:-1] = r[:-1] == r[1:]
            same[-1] = False
            tied = same.copy()
            tied[1:] |= same[:-1]
            where = np.flatnonzero(tied)
            if not len(where):
                break
            p = order[where]
            second = rank[np.minimum(p + h, n)]
            key = rank[p] * (n + 2) + second
            by = np.argsort(key, kind="stable")
            p, key = p[by], key[by]
            order[where] = p  # groups stay in their places: ranks are places
            new = np.ones(len(p), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            rank[p] = (where + 1)[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
            h *= 2

    def search(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator]:
        """Longest match of each query codes[start:start + length], by binary search one word at a time.

        Returns the matched length and its range of places, and what each depth found as (queries, lo, hi).
        """
        q = np.arange(len(start))
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.order), dtype=np.int64)
        best, best_lo, best_hi = np.zeros(len(start), dtype=np.int64), lo.copy(), lo.copy()
        levels = []
        d = 0
        last = len(self.seq) - 1
        while len(q):
            want = codes[start[q] + d]
            a = self._bound(lo, hi, d, want, last, "left")
            b = self._bound(a, hi, d, want, last, "right")
            found = b > a
            q, lo, hi = q[found], a[found], b[found]
            d += 1
            best[q], best_lo[q], best_hi[q] = d, lo, hi
            levels.append((q, lo, hi))
            more = length[q] > d
            q, lo, hi = q[more], lo[more], hi[more]
        return best, best_lo, best_hi, levels

    def _bound(self, lo, hi, d, want, last, side):
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            have = self.seq[np.minimum(self.order[mid] + d, last)]
            right = have < want[live] if side == "left" else have <= want[live]
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo


def _first_places(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(1, len(sorted_values) + 1), 0))


class Shard:
    """Some documents with the suffix array of their words; a 0 parts documents."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, block: Block):
        self.words = Words(buf, off, DELIM_TABLE, lower=True)
        self.n_words = np.diff(self.words.doc_at)
        docs = len(self.n_words)
        self.doc = self.words.doc_of_words()
        self.at = np.arange(len(self.doc)) + self.doc  # place of each word among words and separators
        seq = np.zeros(len(self.doc) + docs, dtype=np.int64)
        seq[self.at] = block.encode(self.words)
        self.block = block
        start, length, item = block.suffixes()
        self.suffix_item, self.suffix_start = item, start - block.item_at[item]
        self.array = SuffixArray(seq, int(length.max(initial=1)))
        self.best, self.lo, self.hi, levels = self.array.search(block.codes, start, length)
        # A window: a full-length suffix prefix, or a whole short item.
        total = np.diff(block.item_at)[item] if len(item) else item
        need = np.where(total >= block.window, np.where(length >= block.window, block.window, 0), np.where(self.suffix_start == 0, total, 0))
        items, places, sizes = [], [], []
        for d, (q, lo, hi) in enumerate(levels, 1):
            own = need[q] == d
            if own.any():
                n = (hi - lo)[own]
                items.append(np.repeat(item[q[own]], n))
                places.append(self.array.order[np.repeat(lo[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                sizes.append(np.full(n.sum(), d))
        self.item = np.concatenate(items) if items else np.zeros(0, dtype=np.int64)
        place = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.word = np.searchsorted(self.at, place)

    def covered(self) -> np.ndarray:
        n = len(self.doc)
        change = np.bincount(self.word, minlength=n + 1) - np.bincount(self.word + self.size, minlength=n + 1)
        return np.cumsum(change)[:n] > 0


def benchmark_blocks(benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Block, bool]]:
    """The items in blocks of bounded size, at least one, and whether it is the last; the driver has the items of one block at a time."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), text_or_empty().alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        if size >= block_bytes:
            yield Block.build(held, window), False
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"].encode())
    yield Block.build(held, window), True


def _annotated(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """row (all columns of docs), n_words, hits (array of [start, end) word spans), items (item ids).

    Each block of the benchmark is a pass; all but the last are written, and their block forgotten.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<struct<a: long, b: long>>)").alias("hits"), F.expr("CAST(array() AS array<string>)").alias("items"))
    written = None
    for block, last in benchmark_blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for whole in batches:
                flat = pa.RecordBatch.from_arrays([whole.column(0), whole.column(0).field("text"), whole.column(2), whole.column(3)], names=["row", "text", "hits", "items"])
                for b, buf, off in slices([flat], most=SHARD_BYTES):
                    s = Shard(buf, off, block)
                    hit = s.covered()
                    first = s.words.doc_at[:-1][s.n_words > 0]
                    rise = hit.copy()
                    rise[1:] &= ~hit[:-1]
                    rise[first] = hit[first]
                    edge = np.flatnonzero(rise)
                    pairs = np.unique(s.doc[s.word] * (len(block.ids) + 1) + s.item) if len(s.word) else np.zeros(0, dtype=np.int64)
                    hits, items = b.column(2).to_pylist(), b.column(3).to_pylist()
                    stop = np.flatnonzero(~hit)
                    for e in edge:
                        d = int(s.doc[e])
                        k = np.searchsorted(stop, e)
                        end = min(int(stop[k]) if k < len(stop) else len(hit), int(s.words.doc_at[d + 1]))
                        hits[d].append({"a": int(e - s.words.doc_at[d]), "b": int(end - s.words.doc_at[d])})
                    for p in pairs:
                        d, i = divmod(int(p), len(block.ids) + 1)
                        items[d].append(block.ids[i])
                    yield pa.RecordBatch.from_arrays([b.column(0), as_long(s.n_words), pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "hits", "items"])

        out = out.mapInArrow(run, out.schema)
        if not last:
            done, out = written, materialise(out, "passes")
            written = out
            sent.destroy()
            if done is not None:
                discard(done)
    return out


def _union_words(docs: DataFrame) -> DataFrame:
    """Adds n_hit: words in the union of the spans, which passes over several blocks may find twice."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["reach"]))).alias("n"), F.greatest(s["reach"], p["b"]).alias("reach"))
    return docs.withColumn("n_hit", F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.array_sort("hits"), start, step)["n"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document word inside any occurrence of `window` consecutive words of an item, or of a whole
    shorter item, is hit. Null and empty texts have no words and items without words match nothing.
    Items of one id count once; a null item_id is written null. Repeated rows get equal results. An
    empty benchmark hits nothing; an empty docs gives no rows. Other columns are not looked at.
    """
    found = _union_words(_annotated(docs.select("doc_id", "text"), benchmark, window))
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in, with all their columns."""
    return _annotated(docs, benchmark, window).where("size(hits) = 0").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per benchmark suffix the longest verbatim match in docs: item_id, item_start, length, doc_id, doc_start.

    Of equally long matches the one in the smallest doc_id, then the first place, is named.
    """
    spark, out = docs.sparkSession, None
    schema = "item_id string, item_start long, length long, doc_id long, doc_start long"
    for block, last in benchmark_blocks(benchmark, 10):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b, buf, off in slices(batches, most=SHARD_BYTES):
                ids = b.column(0).to_pylist()
                s = Shard(buf, off, block)
                for k in np.flatnonzero(s.best):
                    word = np.searchsorted(s.at, s.array.order[s.lo[k] : s.hi[k]])
                    d, at = min((ids[x] is None, ids[x], int(w - s.words.doc_at[x])) for x, w in zip(s.doc[word], word, strict=True))[1:]
                    row = [block.ids[s.suffix_item[k]], int(s.suffix_start[k]), int(s.best[k]), d, at]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 4], strict=True)], names=["item_id", "item_start", "length", "doc_id", "doc_start"])

        own = docs.select("doc_id", "text").mapInArrow(run, schema)
        if not last:
            own = materialise(own, "matches")
            sent.destroy()
        out = own if out is None else out.unionByName(own)
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_start")).alias("m")
    return out.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", (-F.col("m.l")).alias("length"), "m.doc_id", "m.doc_start")
