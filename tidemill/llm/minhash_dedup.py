"""Near-duplicate components: tensored minhash tables find candidates, full shingle sets confirm links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Words, as_long, bounded, codes, discard, materialise, repeats_ids, scratch, slices
from .components import components, dealt_join


@dataclass(frozen=True)
class Params:
    """words: of a shingle. percent: least similarity of a link, in hundredths. collections: minhash
    groups on each side of the tensor, so collections ** 2 tables. rows: minhashes in a group, so a
    table key holds 2 * rows. block_words: words that one block of a candidate component holds about.

    A link of similarity s is missed with at most 2 * (1 - s ** rows) ** collections: at 0.85, 0.00015, and at 0.9, 0.000004.
    """

    words: int = 5
    percent: int = 85
    collections: int = 10
    rows: int = 3
    block_words: int = 200_000


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all documents and, per document, where its own start. A short document is one shingle."""
    n = np.diff(w.doc_at)
    h = w.runs(k)
    ok = w.whole(k)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], dtype=np.uint64)
    long_docs = np.repeat(n >= k, counts)
    out[long_docs] = h[ok]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = w.hashes[w.doc_at[d] : w.doc_at[d + 1]]
        out[at[d]] = run_of(own)
    return out, at


def run_of(words: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little"))


def digest_of(text: bytes) -> bytes:
    """The digest of a text's words in lower case; of no words, nothing. Texts of one digest have one shingle set."""
    words = text.lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else b""


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of shingles as sorted numbers: equal numbers are equal words, by comparison and not by hash.

    Words get codes, then runs of twice the length get codes of pairs of codes. A text of fewer words
    than k is one shingle, filled up with code 0.
    """
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), off, SPACE_TABLE, lower=True)
    n = np.diff(w.doc_at)
    room = np.where((n > 0) & (n < k), k, n)
    at = np.concatenate([[0], np.cumsum(room)])
    run = np.zeros(at[-1], dtype=np.int64)
    run[np.arange(len(w.starts)) + np.repeat(at[:-1] - w.doc_at[:-1], n)] = codes(w.buf, w.starts, w.ends)[1] + 1
    size = 1
    while size < k:
        step = min(size, k - size)
        a, b = (run[:-step], run[step:]) if len(run) > step else (run[:0], run[:0])
        run = np.unique(a * (run.max(initial=0) + 1) + b, return_inverse=True)[1]
        size += step
    return [np.unique(run[a : max(a, z - k + 1)]) for a, z in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, n_words, digest, left, right): the digest is that of the words."""
    m = p.collections * p.rows
    rng = np.random.Generator(np.random.PCG64(97))
    mul = rng.integers(1, 2**63, size=2 * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, size=2 * m, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in slices(batches):
            w = Words(buf, off, SPACE_TABLE, lower=True)
            h, at = shingles(w, p.words)
            docs_n = len(at) - 1
            full = np.flatnonzero(np.diff(at))
            # distinct shingles of each document, sorted
            doc = np.repeat(np.arange(docs_n), np.diff(at))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            at = np.searchsorted(doc, np.arange(docs_n + 1))
            digests = [digest_of(buf[a:z].tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)]
            keys = np.zeros((docs_n, 2 * p.collections), dtype=np.uint64)
            if len(full):
                for c in range(2 * p.collections):
                    key = np.zeros(len(full), dtype=np.uint64)
                    for j in range(c * p.rows, (c + 1) * p.rows):
                        x = h * mul[j] + add[j]
                        low = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25), at[full])
                        key = (key ^ low) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                    keys[full, c] = key

            def lists(x):
                flat = as_long(np.ascontiguousarray(x).reshape(-1))
                return pa.ListArray.from_arrays(pa.array(np.arange(docs_n + 1, dtype=np.int32) * p.collections), flat)

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), as_long(np.diff(at)), as_long(np.diff(w.doc_at)), pa.array(digests, pa.binary()), lists(keys[:, : p.collections]), lists(keys[:, p.collections :])],
                names=["doc_id", "n_shingles", "n_words", "digest", "left", "right"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, n_words long, digest binary, left array<long>, right array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(node, key) for each pair of a left and a right group: the tensor of the two collections."""
    one = classes.select("node", "right", F.posexplode("left").alias("i", "u"))
    both = one.select("node", "i", "u", F.posexplode("right").alias("j", "v"))
    return both.select("node", F.xxhash64("i", "u", "j", "v").alias("key"))


def confirmed_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the exact similarity graph of sorted distinct sets.

    known: a number for each set; those of one number are connected already.

    Prefix filtering: under one order of all shingles, rarest first, two sets that are similar enough
    share one of their first n - ceil(percent * n / 100) + 1. Pairs already connected are not compared
    again, and every other pair that shares such a shingle is compared on the full sets.
    """
    n = np.array([len(s) for s in sets])
    if len(sets) < 2 or not n.sum():
        return []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((code, df[code], owner))
    code, owner = code[order], owner[order]
    place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    need = n - (percent * n + 99) // 100 + 1
    keep = (place < need[owner]) & (df[code] > 1)
    code, owner = code[keep], owner[keep]
    order = np.lexsort((n[owner], code))
    code, owner = code[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=int)
    cuts = np.append(cuts, len(code))
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    tried: set[tuple[int, int]] = set()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        posting = owner[a:b]
        if b - a < 2 or (root[posting] == root[posting[0]]).all():
            continue
        for k in range(1, len(posting)):
            x = int(posting[k])
            before = posting[:k]
            near = before[(100 * n[before] >= percent * n[x]) & (root[before] != root[x])]
            for y in near:
                y = int(y)
                if root[y] == root[x] or (key := (min(x, y), max(x, y))) in tried:
                    continue
                tried.add(key)
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    links.append(key)
                    root[root == root[x]] = root[y]
    return links


def candidate_components(classes: DataFrame, p: Params) -> DataFrame:
    """(node, root, hub): classes that some chain of shared tables connects, and the smallest class that shares a table with each."""
    with scratch() as keep:
        keys = table_keys(classes.where("n_shingles > 0"))
        shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
        shared = keep(materialise(shared.select("key", "low", "n"), "shared"))
        stars = dealt_join(keys, shared, "key").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        stars = keep(materialise(stars.distinct(), "stars"))
        hubs = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hub"))
        found = components(stars).join(hubs, "node", "left").withColumn("hub", F.coalesce("hub", "node"))
        return materialise(found, "candidates")


def _confirmed(docs: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """(a, b): links between classes that connect what is alike in each group.

    members: node, rep, digest, known (what is connected already), g, i, j: the groups that a class is in. It stands
    for itself by a text of doc_id rep that has its digest. Every group is compared in one task, word by word.
    """
    members = materialise(members, "members")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text").join(bounded(members), "rep")
    spread = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, known, texts = None, [], [], []

        def close():
            links = confirmed_links(exact_sets(texts, p.words), p.percent, np.array(known))
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], pa.int64()), pa.array([ids[y] for _, y in links], pa.int64())], names=["a", "b"])

        for batch, buf, off in slices(batches):
            cols = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
            for d, (node, digest, own, *group) in enumerate(zip(*cols, strict=True)):
                if group != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, known, texts = group, [], [], []
                if ids and ids[-1] == node:  # rows that repeat a text stand once
                    continue
                text = buf[off[d] : off[d + 1]].tobytes()
                if digest_of(text) == digest:  # other texts of a repeated doc_id are other classes
                    ids.append(node)
                    known.append(own)
                    texts.append(text)
        if len(ids) > 1:
            yield close()

    with scratch() as keep:
        keep(members)
        return materialise(spread.select("node", "text", "digest", "known", "g", "i", "j").mapInArrow(run, "a long, b long"), "links")


def near_links(docs: DataFrame, candidates: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """(a, b): links between classes that connect each exact component.

    A candidate component of up to block_words is one group. A larger one is compared around its hubs
    first: a hub and its classes, in parts of about block_words that each have the hub. So copies of one
    text are connected in time and shuffle that grow with their number. What is still apart is cut
    into blocks, and every pair of blocks that is not connected throughout is a group: no pair is left out.
    """
    with scratch() as keep:
        sized = keep(materialise(candidates.join(classes.select("node", "rep", "digest", "n_words"), "node"), "sized"))
        share = F.ceil(F.sum("n_words") / p.block_words).cast("int")
        large = keep(materialise(sized.groupBy("root").agg(share.alias("blocks"), F.count("*").alias("n")).where("blocks > 1").select("root", F.lit(True).alias("large"), "n"), "large"))
        placed = dealt_join(sized, large, "root", "left").withColumn("large", F.coalesce("large", F.lit(False)))
        place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
        cols = ["node", "rep", "digest", F.col("node").alias("known"), F.col("g"), F.col("i"), F.lit(0).alias("j")]
        first = placed.where("NOT large").withColumns({"g": F.col("root"), "i": F.lit(0)}).select(*cols)
        if large.isEmpty():
            return _confirmed(docs, first, p)
        rest = keep(materialise(placed.where("large").drop("large"), "rest"))
        hubs = keep(materialise(rest.groupBy("hub").agg(share.alias("blocks"), F.count("*").alias("n")), "hubs"))
        around = dealt_join(rest, hubs, "hub").withColumns({"g": F.col("hub"), "i": place("blocks")}).select(*cols)
        centres = rest.join(hubs.select(F.col("hub").alias("node"), "blocks"), "node").withColumns({"g": F.col("node"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select(*cols)
        links = _confirmed(docs, first.unionByName(around).unionByName(centres).distinct(), p)
        if not (apart := _apart(rest, links, p, keep)):
            return links
        more = keep(_confirmed(docs, apart, p))
        both = materialise(keep(links).unionByName(more), "links")
        return both


def _apart(rest: DataFrame, links: DataFrame, p: Params, keep) -> DataFrame | None:
    """Members of the pairs of blocks that are left to compare once links connect parts of the components of rest."""
    subs = keep(materialise(components(links).withColumnRenamed("root", "known"), "subs"))
    now = keep(materialise(rest.drop("hub").join(subs, "node", "left").withColumn("known", F.coalesce("known", "node")), "now"))
    parted = now.groupBy("root").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count("*").alias("n")).where("a < b")
    parted = keep(materialise(parted.select("root", "n"), "parted"))
    if parted.isEmpty():
        return None
    still = dealt_join(now, parted, "root")
    # A connected part over block_words has blocks of its own, which need not meet each other; the others share blocks.
    parts = still.groupBy("root", "known").agg(F.sum("n_words").alias("words"))
    parts = parts.withColumn("own", F.when(F.col("words") > p.block_words, F.col("known")).otherwise(F.lit(-1)))
    blocks = parts.groupBy("root", "own").agg(F.ceil(F.sum("words") / p.block_words).cast("int").alias("blocks"))
    line = Window.partitionBy("root").orderBy("own")
    blocks = blocks.withColumn("end", F.sum("blocks").over(line)).withColumn("total", F.sum("blocks").over(Window.partitionBy("root")))
    blocks = keep(materialise(blocks.select("root", "own", "blocks", (F.col("end") - F.col("blocks")).alias("base"), "total"), "blocks"))
    owners = blocks.where("own >= 0").select("root", F.col("own").alias("known"), F.lit(True).alias("big"))
    owned = still.join(bounded(owners, blocks), ["root", "known"], "left").withColumn("own", F.when(F.col("big"), F.col("known")).otherwise(F.lit(-1)))
    at = owned.join(bounded(blocks), ["root", "own"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("node"), "blocks"))
    others = F.expr("filter(sequence(0L, total - 1), x -> own < 0 OR x < base OR x >= base + blocks)")
    pairs = at.withColumn("other", F.explode(others))
    return pairs.select("node", "rep", "digest", "known", F.col("root").alias("g"), F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j")).distinct()


def _labelled(docs: DataFrame, p: Params) -> DataFrame:
    """near_duplicates() with each row's digest, and stays: whether its class is the one of its component that stays, written."""
    with scratch() as keep:
        sig = keep(materialise(signatures(docs, p), "signatures"))
        known = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
        first = [F.first(c).alias(c) for c in ("n_shingles", "n_words", "left", "right")]
        classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *first)
        classes = keep(materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes"))
        candidates = keep(candidate_components(classes, p))
        links = keep(near_links(docs, candidates, classes, p))
        roots = keep(materialise(components(links), "roots"))
        named = classes.select("node", "digest", "rep", F.col("n").alias("rows")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = keep(materialise(named, "named"))
        best = named.groupBy("root").agg(F.min(F.struct("rep", "digest")).alias("best"), F.count("*").alias("n"))
        best = keep(materialise(best, "best"))
        named = dealt_join(named, best, "root").select("digest", F.col("best.rep").alias("component"), (F.col("best.digest") == F.col("digest")).alias("first"), F.col("rows").alias("n"))
        named = keep(materialise(named, "components-of-classes"))
        out = dealt_join(sig, named, "digest", "left")
        component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
        kept = component.eqNullSafe(F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", "digest", component.alias("component_id"), kept.alias("kept"), (kept & F.coalesce(F.col("doc_id").isNull() | F.col("first"), F.lit(True))).alias("stays"))
        return materialise(out, "components")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents of the same words form a class at once; classes are hashed into tables and
    compared. Null, empty and wordless texts have no shingles and are linked with nothing. A null
    doc_id has no place among ids: such a row stays unlinked, with a null component. Of rows that
    repeat a doc_id with different texts, each text is compared and has the component of its own
    class, named by its smallest doc_id. An empty table gives no rows.
    """
    return _labelled(docs, p).drop("digest", "stays")


def deduplicate(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents of docs that stay, one of each component, with all their columns.

    Where doc_ids repeat, one row of the text that stays does; rows without words or doc_id are linked with nothing and all stay.
    """
    rows = _labelled(docs, p)
    gone = materialise(rows.where("doc_id IS NOT NULL AND NOT stays").select("doc_id").distinct(), "gone")
    if not repeats_ids(docs):
        discard(rows)
        return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest_of(t.encode()))

    own = docs.withColumn("_digest", digest(F.coalesce("text", F.lit(""))))
    free = (F.length("_digest") == 0) | F.col("doc_id").isNull()
    stay = rows.where("stays AND n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_own")).distinct()
    parts = own.where(~free).join(stay, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_own")), "left_semi")
    return own.where(free).unionByName(parts.dropDuplicates(["doc_id", "_digest"])).select(*docs.columns)
