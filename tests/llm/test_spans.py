import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, decontaminate, substring_dedup


def doubled(n):
    """Two words of n letters whose polynomial sums modulo 2^64 are equal for every base: the Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def low_words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if i is not None and first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    bank = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 12)))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(bank).split()
            a = rng.randrange(0, 20)
            parts += [" \t\n".join(s[a : a + rng.randrange(5, 30)]), rng.choice("xyz") * 3]
        rows.append((i, " ".join(parts)))
    rows += [(70, "a " * 50), (71, "a " * 30), (72, None), (73, ""), (None, bank[0]), (74, bank[0]), (74, bank[0] + " q"), (74, bank[0]), (75, bank[0] + " é " + bank[1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")
    for k in (5, 13):
        got = [tuple(r) for r in substring_dedup.remove_repeats(docs, k).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(brute_repeats(rows, k), key=key)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_only_seem_equal(spark, n):
    one, two = doubled(n)
    tail = " " + " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, one + tail), (2, two + tail), (3, two + tail)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert hits == {1: (1, 1, True), 2: (0, 0, False), 3: (0, 0, False)}


def test_hash_collisions_change_nothing(spark, monkeypatch):
    """With hashes of a few bits under all salts but some, results are those of the words themselves."""
    true = common.span_hashes
    weak = lambda buf, a, z, salt=0: true(buf, a, z, salt) & np.uint64(7 if salt == 0 else 2**64 - 1)
    monkeypatch.setattr(common, "span_hashes", weak)
    buf = np.frombuffer(b"one two three four one five six seven eight nine ten two", dtype=np.uint8)
    w = common.Words(buf, np.array([0, len(buf)]), common.SPACE_TABLE)
    first, code = common.codes(w.buf, w.starts, w.ends)
    own = [bytes(buf[a:z]) for a, z in zip(w.starts, w.ends)]
    assert [own[f] for f in first[code]] == own and len(first) == len(set(own))
    monkeypatch.setattr(decontaminate, "span_hashes", weak)
    block = decontaminate.Block.build([("1", "one two three four five six seven eight nine"), ("2", "ten eleven")], 10)
    assert block.salt > 0 and sorted(block.codes) == list(range(1, 12))
    spans, salts = substring_dedup.repeated_spans, []

    def misled(docs, k, salt):
        salts.append(salt)
        found = spans(docs, k, salt)
        return common.materialise(found.withColumn("source_place", F.col("source_place") + 1), "spans") if salt == 0 else found

    monkeypatch.setattr(substring_dedup, "repeated_spans", misled)
    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, "x " + " ".join(f"w{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == brute_repeats(rows, 13)
    assert salts == [0, 2]


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(200_000))
    part = " ".join(long.split()[150_000:150_040])
    rows = [(1, long), (2, "q " + part + " r"), (3, "z" * 1_000_000), (4, "z" * 999_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == brute_repeats(rows, 13)
    items = [(1, part), (2, "z" * 1_000_000)]
    got = [tuple(r) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()]
    assert got == brute_hits(rows, items, 10)


def test_spans_that_are_not_their_source_stay(spark):
    bank = " ".join(f"w{i}" for i in range(30))
    docs = substring_dedup.numbered(spark.createDataFrame([(1, bank), (2, "x " + bank), (3, "y " * 40)], "doc_id long, text string"))
    spans = substring_dedup.repeated_spans(docs, 13)
    assert [(r.doc_id, r.start, r.n_edges, r.source_id, r.source_place) for r in spans.collect()] == [(2, 1, 18, 1, 0)]
    wrong = spans.unionByName(spans.selectExpr("3L AS doc_id", "part", "start", "n_edges", "source_id", "source_place"))
    assert [(r.doc_id, r.start, r.n_edges) for r in substring_dedup.verified(docs, wrong, 13).collect()] == [(2, 1, 18)]


def test_repeats_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 0


def brute_hits(rows, items, window):
    want = {}
    for item, t in items:
        w = low_words(t)
        for p in range(max(len(w) - window + 1, 1) if w else 0):
            want.setdefault(tuple(w[p : p + window]), set()).add(str(item) if item is not None else "null")
    sizes = {len(g) for g in want}
    out = []
    for i, t in rows:
        w = low_words(t)
        hit, ids = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                g = tuple(w[p : p + n])
                if g in want:
                    hit |= set(range(p, p + n))
                    ids |= want[g]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def hit_case():
    rng = random.Random(8)
    items = [(n, " ".join(rng.choice(["Ä", "b", "C", "d9"]) for _ in range(rng.randrange(1, 40)))) for n in range(12)]
    items += [(50, "one short item"), (51, None), (52, "..."), (None, "null item words"), (50, "again SHORT")]
    rows = []
    for i in range(50):
        own = [" ".join(rng.choice(["Ä", "b", "c", "D9"]) for _ in range(rng.randrange(0, 20)))]
        if i % 3 == 0:
            own.append(rng.choice(items)[1] or "")
        rows.append((i, rng.choice([" ", ", "]).join(own)))
    rows += [(60, "x ONE short; item y"), (61, "one short"), (62, "item"), (63, None), (64, ""), (65, "again short"), (None, "null-item words"), (66, "one short item " * 30)]
    return rows, items


def test_hits_against_brute_force(spark, monkeypatch):
    rows, items = hit_case()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0)
    for window, block in ((10, 1 << 20), (4, 60)):  # one pass, and several
        monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (10, block))
        got = [tuple(r) for r in decontaminate.contamination(docs, bench, window).collect()]
        want = brute_hits(rows, items, window)
        assert sorted(got, key=key) == sorted(want, key=key)
        kept = decontaminate.decontaminate(docs, bench, window)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if not r[5]}


def test_hits_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.contamination(docs, none).collect()] == [(3, 0, 0)]
    assert decontaminate.contamination(docs.where("false"), none).count() == 0


def test_longest(spark):
    docs = spark.createDataFrame([(4, "p q r s t"), (2, "z q r s"), (9, "q r s u"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "q r s t v"), (2, "nothing here")], "item_id long, text string")
    got = {(r.item_id, r.item_start): (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got == {("1", 0): (4, 4, 1), ("1", 1): (3, 4, 2), ("1", 2): (2, 4, 3), ("1", 3): (1, 4, 4)}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 3, 400)
    a = decontaminate.SuffixArray(seq, 64)
    keys = [tuple(np.concatenate([seq, np.zeros(64, dtype=int)])[p : p + 64]) for p in a.order]
    cut = [k[: k.index(0)] if 0 in k else k for k in keys]
    assert len(a.order) == (seq > 0).sum()
    assert [c[:4] for c in cut] == sorted(c[:4] for c in cut)
