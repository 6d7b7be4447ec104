"""Corpus and terminology: candidate features, mining, bursts, decay."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_life, js_round, ratio
from ..functions.text import WORD, injected, ngrams, words
from .lifecycle import burst, rules, term_lifecycle

c = F.col


def tokens(docs: DataFrame, text: str = "text", most: int = 1, pattern: str = WORD) -> DataFrame:
    """A row for each distinct run of 1 to `most` lower-case words of each document, joined by a space."""
    d = docs.withColumn("_w", words(F.lower(text), pattern)).drop(text)
    runs = c("_w") if most == 1 else F.concat("_w", *[ngrams("_w", n) for n in range(2, most + 1)])
    # outer: the filter that is inferred for an inner explode would find the words anew for every run
    return d.withColumn("term", F.explode_outer(F.array_distinct(runs))).drop("_w").where("term IS NOT NULL")


def candidate_features(rows: DataFrame, dictionary: list[str], once: bool = False) -> DataFrame:
    """A08. Features and decision of each span over its occurrences.

    Needs span, doc, cluster, day, language; a doc has one cluster, day and language. burst is the busiest day's share,
    stability the active days of 30. once: a span has one row per document, so rows need not be told apart by document.
    Rows are counted by (span, cluster, language, day) before any is moved; what is left is moved once, by span.
    """
    key = ["span", "cluster", "language", "day"]
    if once:
        cells = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count("doc").alias("d"))
    else:
        cells = rows.groupBy(*key, "doc").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("n"), F.count("doc").alias("d"))
    cells = cells.repartition("span")
    days = cells.groupBy("span", "day").agg(F.sum("n").alias("n")).groupBy("span").agg(F.max("n").alias("_peak"), F.count("*").alias("active_days"))
    g = cells.groupBy("span").agg(F.sum("n").alias("frequency"), F.countDistinct("cluster").alias("clusters"), F.sum("d").alias("documents"), F.countDistinct("language").alias("languages"))
    out = g.join(days, "span")
    inj = injected("span")
    out = out.withColumns({"burst": js_round(c("_peak") / c("frequency"), 6), "stability": js_round(F.least(F.lit(30), c("active_days")) / 30, 6), "_spread": 1 - c("clusters") / c("frequency")})
    out = out.withColumn("anomaly", js_round(F.greatest(F.when(inj, 1.0).otherwise(0.0), c("_spread")), 6))
    decision = rules((inj, "REJECTED"), (F.length(F.trim("span")) < 3, "REJECTED"), (c("span").isin(dictionary) & (c("clusters") >= 2), "ACCEPTED"), otherwise="AMBIGUOUS")
    flags = F.array_compact(F.array(F.when(inj, F.lit("PROMPT_INJECTION")), F.when(c("_spread") >= 0.5, F.lit("CORRELATED_SOURCES")), F.when((c("frequency") >= 3) & (c("burst") >= 0.8), F.lit("TEMPORAL_BURST"))))
    return out.withColumns({"decision": decision, "flags": F.array_join(flags, ",")}).drop("_peak", "_spread")


def hypotheses(rows: DataFrame, least_creators: int = 2, least_documents: int = 2) -> DataFrame:
    """A23. Terms of enough creators and documents, with their languages. rows: one per term and document, as tokens() gives with most=4."""
    own = rows.groupBy("term", "creator", "language").agg(F.count("*").alias("n"))
    g = own.groupBy("term").agg(F.countDistinct("creator").alias("creators"), F.sum("n").alias("documents"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return g.where((c("creators") >= least_creators) & (c("documents") >= least_documents))


def hypotheses_of_texts(docs: DataFrame, most: int = 4, least_creators: int = 2, least_documents: int = 2) -> DataFrame:
    """A23. hypotheses() of the runs of 1 to `most` words of docs (text, language, creator), which are moved packed."""
    least = {"creator": least_creators, "language": 0}
    g = counted_runs(docs, least, listed=("language",), least_documents=least_documents, most=most)
    return g.select("term", c("creator").alias("creators"), "documents", F.array_join(F.array_sort("language"), ",").alias("languages"))


#: Words that are no terms by themselves, and the words that runs are made of.
STOPWORDS = ["about", "after", "before", "could", "from", "have", "into", "more", "that", "their", "there", "these", "this", "trade", "trader", "trading", "with", "your"]
SURFACE = r"[\p{L}\p{N}][\p{L}\p{N}+#./-]*"


def minable(term: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Whether a run may be a candidate term of A25."""
    return F.length(term).between(2, 40) & ~term.isin(stopwords) & ~term.rlike(r"^\d+$")


def mined(g: DataFrame, least_creators: int = 2) -> DataFrame:
    """A25. Score and lifecycle of terms by creators, communities, families and documents."""
    score = 2 * c("creators") + c("communities") + c("families") + F.least(F.lit(3.0), c("documents") / 5)
    return g.withColumn("score", F.round(score, 6)).withColumn("lifecycle", rules(((c("families") >= 2) & (c("creators") >= least_creators), "VALIDATED"), otherwise="CANDIDATE"))


def mine(rows: DataFrame, stopwords: list[str] = STOPWORDS, least_creators: int = 2) -> DataFrame:
    """A25. Scored candidate terms of each language: 2 * creators + communities + families + min(3, documents / 5).

    rows: one per term and document, as tokens() gives with most=2 and SURFACE. A term without a language has und.
    """
    own = rows.where(minable(c("term"), stopwords)).withColumn("language", F.coalesce("language", F.lit("und")))
    own = own.groupBy("term", "language", "creator", "community", "family").agg(F.count("*").alias("n"))
    g = own.groupBy("term", "language").agg(F.countDistinct("creator").alias("creators"), F.countDistinct("community").alias("communities"), F.countDistinct("family").alias("families"), F.sum("n").alias("documents"))
    return mined(g, least_creators)


def mine_texts(docs: DataFrame, most: int = 2) -> DataFrame:
    """A25. mine() of the runs of 1 to `most` words of docs (text, language, creator, community, family), which are moved packed."""
    g = counted_runs(docs.withColumn("language", F.coalesce("language", F.lit("und"))), dict.fromkeys(["creator", "community", "family"], 0), within="language", most=most, pattern=SURFACE)
    return mined(g.where(minable(c("term"))).select("term", "language", c("creator").alias("creators"), c("community").alias("communities"), c("family").alias("families"), "documents"))


def term_burst(rows: DataFrame, as_of, current_days: int = 7, baseline_days: int = 28) -> DataFrame:
    """A24, D18, R10. Sources of each term now and in the weeks before, and whether it bursts."""
    at = F.lit(as_of).cast("timestamp")
    day = lambda n: at - F.make_dt_interval(F.lit(n))
    now = (c("observed_at") > day(current_days)) & (c("observed_at") <= at)
    before = (c("observed_at") > day(current_days + baseline_days)) & (c("observed_at") <= day(current_days))
    own = rows.groupBy("term", "source").agg(F.max(now & c("source").isNotNull()).alias("_now"), F.max(before & c("source").isNotNull()).alias("_before"))
    g = own.groupBy("term").agg(F.count_if("_now").alias("current"), F.count_if("_before").alias("baseline"))
    return g.withColumn("burst", burst(c("current"), c("baseline")))


def term_evidence(rows: DataFrame, as_of_age: Column, weight: Column) -> DataFrame:
    """A20, A21, D08. Decayed evidence of each term, weighted yield and lifecycle state.

    Needs term, creator, community, executions, term_yield, is_brand. Sums are taken by term, creator and community first.
    """
    own = rows.groupBy("term", "creator", "community").agg(F.sum(weight * half_life(as_of_age)).alias("_d"), F.count("*").alias("_n"), F.sum("executions").alias("_x"), F.sum(c("term_yield") * c("executions")).alias("_y"), F.max("is_brand").alias("_b"))
    g = own.groupBy("term").agg(F.round(F.sum("_d"), 9).alias("decayed"), F.countDistinct("creator").alias("creators"), F.countDistinct("community").alias("communities"), F.sum("_n").alias("evidence"), F.sum("_x").alias("executions"), F.round(ratio(F.sum("_y"), F.sum("_x")), 9).alias("term_yield"), F.max("_b").alias("is_brand"))
    return g.withColumn("state", term_lifecycle()).withColumn("eligible", c("state").isin("PROVEN", "SEARCH_TRIAL"))


def trial_outcomes(rows: DataFrame, key: list[str]) -> DataFrame:
    """A26. Cost and distinct relevant creators of trials that have any."""
    g = rows.groupBy(*key).agg(F.sum("cost").alias("cost"), F.countDistinct(F.when(c("relevant"), c("creator"))).alias("relevant"), F.count("*").alias("n"))
    return g.where("n > 0")


def history(rows: DataFrame, key: str, order: str, value: str, lane: str) -> DataFrame:
    """A22. Each key's values in order, joined, and its count by lane as one string."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c(value).cast("string").alias("v")))), lambda x: x["v"]), ",")
    lanes = rows.groupBy(key, lane).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(c(lane).cast("string"), F.lit("="), c("n").cast("string")))), ",").alias("lanes"))
    return rows.groupBy(key).agg(ordered.alias("history")).join(lanes, key)


def evidence_documents(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """T32. One document per filled field of each row, with a digest of its text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.text").where("text IS NOT NULL AND trim(text) <> ''").withColumn("checksum", F.sha2("text", 256))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """T32. Rows that one side has more often than the other: (side, ...)."""
    b = b.select(a.columns)
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def language_packs(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """T33. Terms of a small pack table that documents of its language have."""
    t = tokens(docs)
    return t.join(F.broadcast(packs.select("language", "term", "pack")), ["language", "term"])


#: Words that are counted at once before they are packed, and buckets for each shuffle partition.
CHUNK, BUCKETS = 1_200_000, 8


def _put(*columns) -> bytes:
    """Columns of whole numbers, each in as few bytes as it needs, and bytes, compressed."""
    parts = []
    for x in columns:
        if not isinstance(x, bytes):
            top = int(x.max(initial=0))
            x = x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")
            parts.append(f"u{x.itemsize}".encode())
            x = x.tobytes()
        else:
            parts.append(b"by")
        parts += [len(x).to_bytes(4, "little"), x]
    raw = b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _take(blob: bytes) -> list:
    raw, out, at = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(raw):
        kind, size = raw[at : at + 2], int.from_bytes(raw[at + 2 : at + 6], "little")
        x = raw[at + 6 : at + 6 + size]
        out.append(x if kind == b"by" else np.frombuffer(x, f"<{kind.decode()}").astype(np.int64))
        at += 6 + size
    return out


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(data))


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is faster here than by hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, then those of starts[1], and so on."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))


def _pack(words: pa.Array, attributes: list[pa.Array], most: int, buckets: int):
    """(bucket, blob): the runs of some documents with within, documents and distinct values of each attribute.

    attributes: within, then those to be told apart. A run of two words or more that always goes on alike here is not
    listed: the longer one says how many runs that begin it have its documents. They are in one bucket, by their first two words.
    """
    lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    doc, encoded = np.repeat(np.arange(len(lens)), lens), words.flatten().dictionary_encode()
    if not len(doc):
        return
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    names, rank = encoded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, crc = rank[encoded.indices.to_numpy()], np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.uint64)
    coded = [x.dictionary_encode() for x in attributes]
    codes, values = [pc.fill_null(x.indices, -1).to_numpy().astype(np.int64) for x in coded], [[y.encode() for y in x.dictionary.to_pylist()] for x in coded]
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(doc))  # words from here to the end of the document
    levels = []
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        key = ids * len(values[0]) + codes[0][doc] if n == 1 else levels[-1][0][at].astype(np.int64) * len(order) + ids[at + n - 1]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        run, first = np.full(len(doc), -1, np.int32), np.empty(len(times), np.int64)
        run[at], first[inverse] = inverse, at
        levels.append((run, times, first))
    texts, spots, more, docs, entries, base = [], [], [], [], [[] for _ in codes[1:]], 0
    for n, (run, times, first) in enumerate(levels, 1):
        alone = lambda k, at: (levels[k][0][at] >= 0) & (levels[k - 1][1][levels[k - 1][0][at]] == levels[k][1][levels[k][0][at]])  # noqa: E731  whether a run of k words always goes on alike
        kept = ~alone(n, first) if 1 < n < most else np.ones(len(times), bool)
        first = first[kept]
        shorter, going = np.zeros(len(first), np.int64), np.ones(len(first), bool)
        for k in range(n - 1, 1, -1):
            going &= alone(k, first)
            shorter += going
        number = np.full(len(times) + 1, -1)  # at -1: no run
        number[:-1][kept] = np.arange(len(first))
        mine = number[run]
        at = np.flatnonzero(mine >= 0)
        own = _distinct(mine[at] * len(lens) + doc[at])
        g, d = own // len(lens), own % len(lens)
        docs.append(np.bincount(g, minlength=len(first)))
        for e, code, known in zip(entries, codes[1:], values[1:], strict=True):
            width = max(1, len(known))
            has = code[d] >= 0
            own = _distinct(g[has] * width + code[d][has])
            e.append(np.stack([own // width + base, own % width]))
        parts = [names.take(pa.array(ids[first + k])) for k in range(n)]
        texts.append(pc.binary_join_element_wise(*parts, " ").cast(pa.large_string()) if n > 1 else parts[0].cast(pa.large_string()))
        mix = crc[ids[first]] if n == 1 else crc[ids[first]] * np.uint64(1_000_003) + crc[ids[first + 1]] * np.uint64(8_191) + np.uint64(7)
        spots.append((mix % np.uint64(buckets)).astype(np.int64))
        more.append(np.stack([shorter, codes[0][doc[first]]]))
        base += len(first)
        del own, g, d, mine, number, at, mix, parts
    spot, more, docs, entries = np.concatenate(spots), np.concatenate(more, axis=1), np.concatenate(docs), [np.concatenate(e, axis=1) for e in entries]
    del levels, run, times
    order = np.argsort(spot, kind="stable")
    text = pa.chunked_array(texts).combine_chunks()
    del texts
    text = text.take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], "<i8")[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2].to_pybytes()
    counts = [np.bincount(e[0], minlength=base) for e in entries]
    begins = [np.cumsum(x) - x for x in counts]
    ends = np.flatnonzero(np.diff(spot[order], append=-1)) + 1
    for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        rows = order[a:z]
        columns = [np.diff(offsets[a : z + 1]), data[offsets[a] : offsets[z]], more[0][rows], docs[rows]]
        for x, known in [(more[1][rows], values[0])] + [(e[1][_ranges(b[rows], n[rows])], known) for e, b, n, known in zip(entries, begins, counts, values[1:], strict=True)]:
            used, local = np.unique(x, return_inverse=True)
            used = [known[k] for k in used]
            columns += [np.array([len(y) for y in used], np.int64), b"".join(used), local]
        columns += [n[rows] for n in counts]
        yield int(spot[order[a]]), _put(*columns)


def _unpack(blobs: list[bytes], attributes: int, least: list[int], listed: list[bool]) -> list[pa.Array]:
    """Term, within, documents and, of each attribute, the number or the list of distinct values, of one bucket."""
    known, texts, more, docs, own = [{} for _ in range(attributes)], [], [], [], [[] for _ in range(attributes)]
    for blob in blobs:
        sizes, data, shorter, n, *rest = _take(blob)
        texts.append(_strings(sizes, data))
        row = len(more) and sum(map(len, more))
        more.append(shorter)
        docs.append(n)
        counts = rest[3 * attributes :]
        for k in range(attributes):
            names = _strings(rest[3 * k], rest[3 * k + 1]).to_pylist()
            to = np.array([known[k].setdefault(x, len(known[k])) for x in names], np.int64)
            rows = np.arange(len(n)) if not k else np.repeat(np.arange(len(n)), counts[k - 1])
            own[k].append(np.stack([rows + row, to[rest[3 * k + 2]] if len(to) else np.zeros(0, np.int64)]))
    text, more, docs, own = pa.chunked_array(texts).combine_chunks(), np.concatenate(more), np.concatenate(docs), [np.concatenate(x, axis=1) for x in own]
    parts, source, rows, cut = [text], [np.arange(len(docs))], np.arange(len(docs)), text
    for k in range(1, int(more.max(initial=0)) + 1):
        has = np.flatnonzero(more[rows] >= k)
        rows, cut = rows[has], pc.replace_substring_regex(cut.take(pa.array(has)), r" [^ ]*$", "")
        parts.append(cut)
        source.append(rows)
    encoded, source = pa.chunked_array(parts).combine_chunks().dictionary_encode(), np.concatenate(source)
    width = max(1, len(known[0]))
    keys, key = np.unique(encoded.indices.to_numpy().astype(np.int64) * width + own[0][1][source], return_inverse=True)
    total = np.bincount(key, docs[source], minlength=len(keys)).astype(np.int64)
    # runs of each listed row, so that its entries go to each of them
    order = np.argsort(source, kind="stable")
    runs = np.bincount(source, minlength=len(docs))
    begins = np.cumsum(runs) - runs
    good, sets = total >= least[0], []
    for k in range(1, attributes):
        rows, value = own[k]
        n = runs[rows]
        size = max(1, len(known[k]))
        pairs = _distinct(key[order[_ranges(begins[rows], n)]] * size + np.repeat(value, n))
        count = np.bincount(pairs // size, minlength=len(keys))
        good &= count >= least[k]
        sets.append((pairs, size, count))
    out = [encoded.dictionary.take(pa.array(keys[good] // width)).cast(pa.string()), pa.array(list(known[0]), pa.string()).take(pa.array(keys[good] % width)), pa.array(total[good])]
    for k, (pairs, size, count) in enumerate(sets, 1):
        if listed[k]:
            has = pairs[good[pairs // size]] % size
            values = pa.array(list(known[k]), pa.string()).take(pa.array(has))
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[good])]).astype(np.int32)), values))
        else:
            out.append(pa.array(count[good].astype(np.int64)))
    return out


def counted_runs(docs: DataFrame, of: dict[str, int], within: str | None = None, listed: tuple[str, ...] = (), least_documents: int = 1, most: int = 1, pattern: str = WORD) -> DataFrame:
    """A23, A25. Runs of 1 to `most` lower-case words of text, for each value of within: term, within, documents and, of each column of `of`, the number (listed: the array) of its distinct values.

    of: columns and how many values a run needs at least. Documents are rows. Runs are counted where their texts are read and
    moved packed, sorted and compressed, by hash of their first words, since they are many times as large as the texts. Words
    must be without spaces. within must not be null.
    """
    names = [within or "within", *of]
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, lists = [least_documents, *of.values()], [False, *(x in listed for x in of)]

    def pack(batches):
        for b in batches:
            arrays = b.columns
            ends, start = np.cumsum(pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy()), 0
            while start < b.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
                found = list(_pack(arrays[0].slice(start, stop - start), [x.slice(start, stop - start) for x in arrays[1:]], most, buckets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])
                start = stop

    def unpack(batches):
        now, blobs = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield pa.RecordBatch.from_arrays(_unpack(blobs, len(names), least, lists), names=["term", names[0], "documents", *of])
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield pa.RecordBatch.from_arrays(_unpack(blobs, len(names), least, lists), names=["term", names[0], "documents", *of])

    d = docs.select(words(F.lower("text"), pattern).alias("_w"), (c(within).cast("string") if within else F.lit("")).alias(names[0]), *[c(x).cast("string") for x in of])
    kinds = ", ".join(f"`{x}` {'array<string>' if x in listed else 'long'}" for x in of)
    packed = d.mapInArrow(pack, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    out = packed.mapInArrow(unpack, f"term string, `{names[0]}` string, documents long, {kinds}")
    return out if within else out.drop("within")
