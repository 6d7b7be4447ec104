"""Substring deduplication over a De Bruijn graph of word k-mers.

An edge is a window of k words, a node the k - 1 words that two windows share. Only repeated edges can
matter. Edges whose shared node has one way in and one way out, over all their occurrences, always occur
together, so a nonbranching path of them is one repeated span: it has one list of occurrences, and
the occurrence in its smallest document is its source. Paths are compacted by joins on coordinates in
the source; their occurrences elsewhere are what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Words, as_long, discard, materialise, mix, range_hashes, repeats_ids, run_hashes, scratch, slices, small_batches

#: Words of an anchor, and so k - ANCHOR + 1 anchors to choose a window's from.
ANCHOR = 4
#: Places of one row of a document are below this; the rows that repeat a doc_id follow each other.
PART = 1 << 40


def numbered(docs: DataFrame) -> DataFrame:
    """docs with part: 0, or the row's number among the rows that repeat a doc_id."""
    if not repeats_ids(docs):
        return docs.withColumn("part", F.lit(0).cast("long"))
    return docs.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long") - 1)


def _window_anchors(w: Words, k: int) -> np.ndarray:
    """Each window's anchor: the smallest hash among its ANCHOR-word runs. Equal windows have equal anchors."""
    low = run_hashes(w.hashes, ANCHOR, salt=1)
    need, have = k - ANCHOR + 1, 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low >> np.uint64(16)


def _cut_by_anchor(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, the windows in a row that share an anchor: anchor, document, first word and number of windows."""
    at = np.flatnonzero(w.whole(k))
    anchor, doc = _window_anchors(w, k)[at], w.doc_of_words()[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    return anchor[cut], doc[cut], at[cut], np.diff(np.append(cut, len(at)))


def _segments(k: int, salt: int):
    """(doc_id, text) -> (anchor, segment, doc_id): segment is a hash of all words of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in slices(batches):
            w = Words(buf, off, SPACE_TABLE, salt=salt)
            if len(w.starts) >= k:
                anchor, doc, start, size = _cut_by_anchor(w, k)
                yield pa.RecordBatch.from_arrays([as_long(anchor), as_long(range_hashes(w.hashes, start, start + size + k - 1)), b.column(0).take(pa.array(doc))], names=["anchor", "segment", "doc_id"])

    return run


def _units(k: int, salt: int):
    """(doc_id, text, part, anchors) -> the units of segments with such anchors: where they are, and what is beside them.

    anchors are doubled, plus one where the anchor is mixed. Equal windows have equal anchors. So if
    all segments of an anchor are the same words, its windows occur nowhere else and the segment is a
    nonbranching path as it stands, one unit of n edges; the edges of a mixed anchor are a unit each.
    unit and check are hashes of the unit's words under two salts. before and after are hashes of the edge
    or word beside the unit, 0 at an end of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in slices(batches):
            w = Words(buf, off, SPACE_TABLE, salt=salt)
            if len(w.starts) < k:
                continue
            anchor, doc, start, size = _cut_by_anchor(w, k)
            listed = b.column(3)
            owner = np.repeat(np.arange(len(listed), dtype=np.uint64), np.diff(listed.offsets.to_numpy()))
            values = listed.flatten().to_numpy().view(np.uint64)
            salted = lambda a, d: mix(a * np.uint64(0x9E3779B97F4A7C15) + d.astype(np.uint64))
            known = salted(values >> np.uint64(1), owner)
            order = np.argsort(known)
            known, values = known[order], values[order]
            if not len(known) or not len(anchor):
                continue
            want = salted(anchor, doc)
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            keep = known[at] == want
            if not keep.any():
                continue
            doc, start, size, mixed = doc[keep], start[keep], size[keep], (values[at[keep]] & np.uint64(1)).astype(bool)
            h = w.hashes
            other = w.hashed(salt + 1)
            word = (h >> np.uint64(1)) + np.uint64(1)
            edge = run_hashes(h, k)
            pieces = []
            if not mixed.all():
                d, s, n = doc[~mixed], start[~mixed], size[~mixed]
                pieces.append((d, s, n, range_hashes(h, s, s + n + k - 1), range_hashes(other, s, s + n + k - 1), np.ones(len(d), bool), np.ones(len(d), bool)))
            if mixed.any():
                n = size[mixed]
                s = np.repeat(start[mixed] - np.cumsum(n) + n, n) + np.arange(n.sum())
                d = np.repeat(doc[mixed], n)
                pieces.append((d, s, np.ones(len(s), dtype=np.int64), edge[s], range_hashes(other, s, s + k), s == np.repeat(start[mixed], n), s == np.repeat(start[mixed] + n - 1, n)))
            d, s, n, unit, check, opens, closes = (np.concatenate(x) for x in zip(*pieces, strict=True))
            end = s + n + k - 1
            before = np.where(opens, np.where(s > w.doc_at[d], word[np.maximum(s - 1, 0)], np.uint64(0)), edge[np.minimum(np.maximum(s - 1, 0), len(edge) - 1)])
            after = np.where(closes, np.where(end < w.doc_at[d + 1], word[np.minimum(end, len(h) - 1)], np.uint64(0)), edge[np.minimum(s + 1, len(edge) - 1)])
            place = s - w.doc_at[d] + b.column(2).to_numpy()[d] * PART
            small = pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([as_long(unit), small, b.column(0).take(pa.array(d)), as_long(place), pa.array(n.astype(np.int32)), as_long(before), as_long(after)], names=["unit", "check", "doc_id", "place", "n", "before", "after"])

    return run


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a text that continue each other here and in their source, as one."""
    line = ["doc_id", "part", "source_id", "shift"]
    w = Window.partitionBy(*line).orderBy("start")
    own = spans.withColumns({"shift": F.col("source_place") - F.col("start"), "end": F.col("start") + F.col("n_edges")})
    own = own.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("island", F.sum((F.col("start") > F.coalesce("reach", F.lit(-1))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = own.groupBy(*line, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select("doc_id", "part", "start", (F.col("end") - F.col("start")).alias("n_edges"), "source_id", (F.col("start") + F.col("shift")).alias("source_place"))


def repeated_spans(docs: DataFrame, k: int = 13, salt: int = 0) -> DataFrame:
    """(doc_id, part, start, n_edges, source_id, source_place): spans of docs that begin in an earlier document.

    A span is n_edges consecutive windows, so n_edges + k - 1 words. docs has doc_id, text and part. Words
    meet by their hashes under salt.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "part")
    at = known.select("doc_id", "text").mapInArrow(_segments(k, salt), "anchor long, segment long, doc_id long")
    span = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("segment").alias("s0"), F.max("segment").alias("s1")]
    shared = at.groupBy("anchor").agg(*span).where("low < high").select("anchor", (F.col("anchor") * 2 + (F.col("s0") < F.col("s1")).cast("long")).alias("marked"))
    marked = materialise(at.select("anchor", "doc_id").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("marked").alias("anchors")), "anchors")

    rows = known.join(marked, "doc_id").select("doc_id", "text", "part", "anchors")
    units = materialise(rows.mapInArrow(_units(k, salt), "unit long, check int, doc_id long, place long, n int, before long, after long"), "units")
    discard(marked)

    key = ["unit", "check"]
    found = [F.min("doc_id").alias("source_id"), F.min_by("place", "doc_id").alias("source_place"), F.max("doc_id").alias("high"), F.max("n").alias("n"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")]
    own = units.groupBy(*key).agg(*found).where("source_id < high")
    own = materialise(own.select(*key, "source_id", "source_place", "n", (F.col("b0") == F.col("b1")).alias("one_in"), (F.col("a0") == F.col("a1")).alias("one_out")), "sources")
    # Paths: a unit goes on from the one that ends where it starts in the source, if the node between them does not branch.
    ahead = own.where("one_out").select("source_id", (F.col("source_place") + F.col("n")).alias("source_place"), F.lit(True).alias("joins"))
    linked = own.join(ahead, ["source_id", "source_place"], "left").withColumn("head", ~(F.col("one_in") & F.coalesce("joins", F.lit(False))))
    line = Window.partitionBy("source_id").orderBy("source_place")
    linked = linked.withColumn("path", F.sum(F.col("head").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    paths = linked.withColumn("n_edges", F.sum("n").over(Window.partitionBy("source_id", "path"))).where("head")
    paths = materialise(paths.select(*key, "source_id", "source_place", "n_edges"), "paths")
    discard(own)
    spans = units.select(*key, "doc_id", "place").join(paths, key).where("doc_id > source_id")
    spans = spans.select("doc_id", F.floor(F.col("place") / PART).cast("long").alias("part"), F.pmod("place", F.lit(PART)).alias("start"), "n_edges", "source_id", "source_place")
    spans = materialise(_joined(spans), "spans")
    discard(units)
    discard(paths)
    return spans


def _digests(k: int):
    """(doc_id, part, text, places) -> a digest of the words at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for row in range(batch.num_rows):
                words = (batch.column(2)[row].as_py() or "").encode().split()
                for at in batch.column(3)[row].as_py():
                    own = b" ".join(words[at["start"] : at["start"] + at["n_edges"] + k - 1])
                    for col, v in zip(out, (ids[row], parts[row], at["start"], at["n_edges"], hashlib.blake2b(own, digest_size=16).digest()), strict=True):
                        col.append(v)
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "part", "start", "n_edges", "digest"])

    return run


def verified(docs: DataFrame, spans: DataFrame, k: int = 13) -> DataFrame:
    """The spans whose words are those at their source coordinates, by a digest of both texts' words.

    So what is removed does not rest on window hashes: a span that met its source by a collision stays.
    """
    key = ["doc_id", "part", "start", "n_edges"]
    source = [F.col("source_id").alias("doc_id"), F.floor(F.col("source_place") / PART).cast("long").alias("part"), F.pmod("source_place", F.lit(PART)).alias("start"), F.col("n_edges").cast("long").alias("n_edges")]
    own = spans.select("doc_id", "part", "start", F.col("n_edges").cast("long").alias("n_edges"))
    places = own.unionByName(spans.select(*source)).groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "n_edges")).alias("places"))
    rows = docs.join(places, ["doc_id", "part"]).select("doc_id", "part", "text", "places")
    found = materialise(rows.mapInArrow(_digests(k), "doc_id long, part long, start long, n_edges long, digest binary"), "digests")
    theirs = found.select(*[F.col(c).alias(f"s_{c}") for c in key], F.col("digest").alias("s_digest"))
    both = spans.select(*own.columns, *[c.alias(f"s_{n}") for c, n in zip(source, key, strict=True)]).join(theirs, [f"s_{c}" for c in key]).join(found, key)
    out = materialise(both.where("digest = s_digest").select(*key).distinct(), "verified")
    discard(found)
    return out


def sure_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, part, start, n_edges): all spans that begin in an earlier document, every one compared with its source.

    Words that differ but have one hash could hide a true source behind a false one. Then a span fails
    the comparison, and the spans are sought again under another salt, until none fails.
    """
    salt = 0
    while True:
        with scratch() as keep:
            spans = keep(repeated_spans(docs, k, salt))
            sure = verified(docs, spans, k)
            if sure.count() == spans.select(*sure.columns).distinct().count():
                return sure
            discard(sure)
        salt += 2


def _cut(k: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, removed, digest = [], [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                cuts = batch.column(2)[row].as_py()
                gone = 0
                total.append(len(words))
                if cuts:
                    keep = np.ones(len(words), dtype=bool)
                    for c in cuts:
                        keep[c["start"] : c["start"] + c["n_edges"] + k - 1] = False
                    gone = int((~keep).sum())
                    words = list(compress(words, keep))
                removed.append(gone)
                text = b" ".join(words)
                digest.append(hashlib.sha256(text).hexdigest())
                out.append(text.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, k: int = 13, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless texts) for each row of docs.

    A word goes if a window of k words over it also starts in a document of a smaller doc_id; the
    input decides, not what is left of it. Words are parted by ASCII white space and kept words are joined by
    one space. Null and empty texts have no words. Rows that repeat a doc_id do not cut each other. A row
    with a null doc_id has no order: it loses nothing and is no source. An empty table gives no rows.
    Other columns are not looked at.
    """
    docs = numbered(docs.select("doc_id", "text"))
    sure = sure_spans(docs, k)
    cuts = materialise(sure.groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "n_edges")).alias("cuts")), "cuts")
    discard(sure)
    small_batches(docs.sparkSession)
    rows = docs.join(cuts, ["doc_id", "part"], "left").select("doc_id", "text", "cuts")
    return rows.mapInArrow(_cut(k, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
