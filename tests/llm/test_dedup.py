import re
from itertools import combinations

import numpy as np
import pytest

from tidemill.llm import exact_dedup, minhash_dedup
from tidemill.llm.components import components

from .test_spans import doubled

SCHEMA = "doc_id long, text string, keep_id string, _size string"
DATA = "/root/testdata/sf0.001/documents.parquet"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def words(text):
    low = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in low))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_exact_edges(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a b "), (1, None), (2, ""), (4, " \t"), (None, "a  b  "), (7, "A b"), (8, "x" * 100_000)]
    got = {r.doc_id: r for r in exact_dedup.classify(frame(spark, rows)).collect()}
    assert got[3].keep_id == got[5].keep_id == got[9].keep_id == 9 and got[3].group_size == 4
    assert got[1].keep_id == 4 and got[1].group_size == 3 and got[4].kept
    assert got[7].kept and got[8].group_size == 1 and not got[None].kept
    kept = exact_dedup.deduplicate(frame(spark, [*rows, (8, "x" * 100_000)]))
    assert kept.columns == ["doc_id", "text", "keep_id", "_size"]
    assert sorted(r.doc_id for r in kept.collect()) == [4, 7, 8, 9]
    assert exact_dedup.classify(frame(spark, [])).count() == 0


def test_exact_one_row_of_each_group(spark):
    rows = [(5, "ab"), (5, "a b"), (6, "a b"), (None, "c d"), (None, "cd"), (7, "e "), (7, " e"), (8, "f"), (8, "f"), (8, "f"), (9, "g"), (None, ""), (None, None)]
    got = exact_dedup.classify(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.group_size for r in got) == 3 * 3 + 2 * 2 + 2 * 2 + 3 * 3 + 1 + 2 * 2
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == 6 and all(r.doc_id == r.keep_id for r in kept)
    left = [tuple(r) for r in exact_dedup.deduplicate(frame(spark, rows)).select("doc_id", "text").collect()]
    assert len(left) == 6 and {(5, "a b"), (None, "c d"), (8, "f"), (9, "g")} <= set(left)
    low = [(-(2**63), "x y"), (3, "x y"), (3, "xy")]
    assert [tuple(r) for r in exact_dedup.deduplicate(frame(spark, low)).select("doc_id", "text").collect()] == [(-(2**63), "x y")]


def test_exact_by_shuffle_as_by_broadcast(spark, monkeypatch):
    rows = [(i, "x" * (i % 7) + " " * (i % 5)) for i in range(200)] + [(None, "xx"), (3, "x xx"), (500, None)]
    few = sorted(map(str, exact_dedup.classify(frame(spark, rows)).collect()))
    monkeypatch.setattr("tidemill.llm.common.BROADCAST_BYTES", 0)
    assert sorted(map(str, exact_dedup.classify(frame(spark, rows)).collect())) == few
    assert exact_dedup.deduplicate(frame(spark, rows)).count() == 7


def test_filter_slots():
    """The slots are those of a filter that takes one fingerprint after another by linear probing."""
    rng = np.random.default_rng(9)
    for width, q, n in ((16, 5, 24), (12, 4, 30), (20, 3, 40), (64, None, 3000)):
        fp = rng.integers(0, 2**12 if width < 64 else 2**63, n, dtype=np.uint64) % np.uint64(2 ** min(width, 62))
        counts = rng.integers(1, 2000, n)
        f = exact_dedup.QuotientFilter.build(fp, q, counts, width)
        want = {}
        for x, c in zip(fp.tolist(), counts.tolist()):
            want[x] = want.get(x, 0) + c
        for g in (f, exact_dedup.QuotientFilter.from_bytes(f.to_bytes())):
            assert dict(zip(*(a.tolist() for a in g.entries()))) == want and g.fingerprints().tolist() == sorted(want)
        used, at = {}, 0
        for x in sorted(want):
            at = max(at, x >> f.r)
            used[at] = x & ((1 << f.r) - 1)
            at += 1
            left = want[x] - 1
            while left:
                used[at], left, at = left & ((1 << f.r) - 1), left >> f.r, at + 1
        taken = np.flatnonzero(f.bits & 7)
        assert {int(k): int(f.slots[k]) for k in taken} == used


def test_filters_merge_losslessly():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    fps = np.concatenate([fps, fps[:700], fps[:40], np.repeat(fps[:1], 500)])
    parts = [exact_dedup.QuotientFilter.build(p, 6) for p in np.array_split(fps, 7)]
    assert np.array_equal(np.sort(np.unique(np.array_split(fps, 7)[0])), parts[0].fingerprints())
    merged = {}
    for run in range(64):
        r, n = exact_dedup.merge_runs([p.slot(run) for p in parts])
        merged |= {(run << 58) | int(x): int(c) for x, c in zip(r, n, strict=True)}
    values, counts = np.unique(fps, return_counts=True)
    assert merged == dict(zip(map(int, values), map(int, counts), strict=True))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (33, 31)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 33: 30}


@pytest.mark.parametrize("block_words", [1_000_000, 400])
def test_near_against_brute_force(spark, block_words):
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = "one two three four five six seven eight nine ten eleven twelve".split() * 4
    for k in range(40):  # a group of near copies
        w = [f"{x}{n}" for n, x in enumerate(base)]
        w[k] = f"edit{k}"
        rows.append((100_000 + k, " ".join(w)))
    rows += [(200_000, ""), (200_001, None), (200_002, "Tiny text"), (200_003, "tiny\ttext "), (200_004, "  ")]
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    p = minhash_dedup.Params(block_words=block_words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, p).collect()}
    assert got == want
    kept = {r.doc_id for r in minhash_dedup.deduplicate(docs, p).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_words_that_only_seem_equal(spark):
    one, two = doubled(1024)
    tail = [" ".join(f"{x}{i}" for i in range(50)) for x in "pq"]
    rows = [(1, one), (2, two), (3, f"{one} {tail[0]}"), (4, f"{two} {tail[0]}"), (5, f"{one} {one}"), (6, f"{two} {two}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)
    sets = minhash_dedup.exact_sets([t.encode() for _, t in rows], 5)
    assert [len(s) for s in sets] == [1, 1, 47, 47, 1, 1] and len(np.intersect1d(sets[2], sets[3])) == 46 and not len(np.intersect1d(sets[0], sets[1]))


def test_near_one_stays_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (1, text.replace("w59", "v")), (3, None), (3, None), (None, text)]
    kept = [tuple(r) for r in minhash_dedup.deduplicate(frame(spark, rows)).select("doc_id", "text").collect()]
    assert len([x for x in kept if x[0] == 1]) == 1 and (2, text) not in kept and kept.count((3, None)) == 2 and (None, text) in kept


def test_a_component_of_many_blocks(spark):
    """Chains and a hub over several blocks, with parts that only meet across blocks."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(120)]
        for k in range(30):
            w = list(base)
            for at in rng.choice(120, rng.integers(0, 3), replace=False):
                w[at] = f"e{rng.integers(0, 9)}"
            rows.append((1000 * c + k, " ".join(w)))
    now = [f"d{i}" for i in range(120)]  # a chain: each is like the next one only
    for k in range(40):
        now[(3 * k) % 120] = f"x{k}"
        rows.append((9000 - k, " ".join(now)))
    rows.append((50_005, "long " * 1_000 + " ".join(f"u{i}" for i in range(4_000))))
    rows.append((50_006, "long " * 1_001 + " ".join(f"u{i}" for i in range(3_999))))
    want = brute(rows)
    for words in (1500,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, rows), minhash_dedup.Params(block_words=words)).collect()}
        assert got == want


def test_near_edges(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_near_texts_of_one_id(spark):
    def text(name, edit=None):
        return " ".join(f"{name}{edit if n == 30 and edit else n}" for n in range(100))

    rows = [(5, text("a")), (5, text("b")), (5, text("c")), (2, text("a", "x")), (6, text("b", "x")), (7, text("c", "x")), (5, None)]
    rows += [(50 + k, text(f"d{k}")) for k in range(4)] + [(50, text("e")), (60, text("e", "x")), (61, text("d0", "x"))]
    want = {(2, "a"): 2, (5, "a"): 2, (5, "b"): 5, (6, "b"): 5, (5, "c"): 5, (7, "c"): 5, (50, "d0"): 50, (61, "d0"): 50, (50, "e"): 50, (60, "e"): 50}
    for order in (rows, rows[::-1]):
        for block_words in (1_000_000, 150):
            p = minhash_dedup.Params(block_words=block_words)
            got = sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, order), p).collect())
            assert got == sorted([(i, c) for (i, _), c in want.items()] + [(5, 5)] + [(50 + k, 50 + k) for k in range(1, 4)])
        kept = minhash_dedup.deduplicate(frame(spark, order))
        assert kept.columns == ["doc_id", "text", "keep_id", "_size"]
        left = {(2, text("a", "x")), (5, text("b")), (5, text("c")), (5, None), (50, text("d0")), (50, text("e"))} | {(50 + k, text(f"d{k}")) for k in range(1, 4)}
        found = [tuple(r) for r in kept.select("doc_id", "text").collect()]
        assert set(found) == left and len(found) == len(left)


def test_confirmed_links_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 52, replace=False), rng.integers(0, 2**62, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(80)]
    links = minhash_dedup.confirmed_links(sets, 85)
    up = list(range(80))

    def find(u, x):
        while u[x] != x:
            x = u[x]
        return x

    for a, b in links:
        up[find(up, a)] = find(up, b)
    full = list(range(80))
    for a, b in combinations(range(80), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            full[find(full, a)] = find(full, b)
    parts = lambda u: {frozenset(x for x in range(80) if find(u, x) == r) for r in {find(u, x) for x in range(80)}}
    assert parts(up) == parts(full)
