import zlib

import numpy as np
import pytest

from tidemill.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    perm = to.Permutation(n, "k")
    slots = perm.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert list(perm.index(slots)) == list(range(n))
    if n > 100:
        assert list(to.Permutation(n, "other").slot(np.arange(n))) != list(slots)
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def test_round_trip_and_resume(spark, tmp_path):
    enc = to.load(to.default_ranks())
    rows = [(i, f"text number {i} " * (i % 23)) for i in range(120)] + [(200, None), (201, ""), (None, "no id"), (202, "twin a"), (202, "twin b"), (202, "twin a"), (203, "long words " * 60_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, slot string")
    p = to.Params(length=16, shard=50)
    out = f"file://{tmp_path}/a"
    found = sorted(to.write_shards(docs, out, p).collect(), key=lambda r: r.slot)
    assert [r.slot for r in found] == list(range(len(found)))
    read = list(to.read_from(out, 0, p))
    assert [(s, d, k) for s, d, k, _ in read] == [(r.slot, r.doc_id, r.part) for r in found]
    assert [tuple(x[:3]) for x in to.read_from(out, 77, p)] == [tuple(x[:3]) for x in read[77:]]
    assert list(to.read_from(out, len(found), p)) == []
    for r in found[:60]:
        with open(f"{tmp_path}/a/shard-{r.shard:08d}.bin", "rb") as f:
            f.seek(r.offset)
            assert zlib.crc32(f.read(p.stride)) == r.crc32
    # each document's parts give back its text
    perm = to.Permutation(len(found), p.key)
    by_number = dict(zip(perm.index(np.arange(len(found))), read, strict=True))
    streams, now = [], []
    for k in range(len(found)):
        _, doc, part, ids = by_number[k]
        if part == 0 and now:
            streams.append(now)
            now = []
        now += [(doc, x) for x in ids.tolist()]
    streams.append(now)
    texts = [(s[0][0], enc.decode([x for _, x in s[:-1]])) for s in streams]
    assert all(s[-1][1] == p.end for s in streams)
    assert sorted(map(repr, texts)) == sorted(repr((i, t or "")) for i, t in rows)
    # the same order from other partitions
    again = sorted(to.write_shards(docs.repartition(7), f"file://{tmp_path}/b", p).collect(), key=lambda r: r.slot)
    assert [(r.doc_id, r.part, r.crc32) for r in again] == [(r.doc_id, r.part, r.crc32) for r in found]


@pytest.mark.parametrize("piece", [8, 40, 200])
def test_pieces_give_the_ids_of_the_whole(piece):
    enc = to.load(to.default_ranks())
    rng = np.random.default_rng(3)
    parts = ["word", " word", "  ", "\n", "\t", "\r\n", "'s", "'ll", "123", "日本語", "...", " !?", "é", "\u00a0", "\u2003", "\x1c", "x" * 30, " " * 25, "'", "d", "🙂"]
    for _ in range(150):
        text = "".join(rng.choice(parts, rng.integers(0, 60)))
        assert to.tokens(enc, text, piece) == enc.encode_ordinary(text)
    for text in ("ab" * 400_000, "日本" * 200_000, ("a b" + " " * 300_000) * 2):
        assert enc.decode(to.tokens(enc, text)) == text


def test_shorter_run_in_the_same_folder(spark, tmp_path):
    p, out = to.Params(length=4, shard=3), f"file://{tmp_path}/a"
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)] + [(-(2**63), "least"), (None, "none")], "doc_id long, text string")
    long = to.write_shards(docs, out, p)
    assert [x[1] for x in to.read_from(out, 0, p)].count(-(2**63)) == 1 and long.count() == long.count()
    short = to.write_shards(docs.where("doc_id < 3 OR doc_id IS NULL"), out, p).count()
    assert len(list(to.read_from(out, 0, p))) == short < long.count()
    with pytest.raises(ValueError):
        list(to.read_from(out, 0, to.Params(length=8, shard=3)))
    wide = to.Params(length=4, shard=3, token_bytes=4)
    to.write_shards(docs, f"file://{tmp_path}/w", wide)
    assert sorted((d or 0, k, x.tolist()) for _, d, k, x in to.read_from(f"file://{tmp_path}/w", 0, wide)) == sorted((d or 0, k, x.tolist()) for _, d, k, x in (list(to.read_from(out, 0, p)) if to.write_shards(docs, out, p) else []))
    with pytest.raises(Exception, match="token_bytes"):
        to.write_shards(docs, f"file://{tmp_path}/n", to.Params(length=4, token_bytes=1))


def test_bases_over_blocks_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(to, "SUMS", 3)
    found = spark.createDataFrame([(c, 1 + (7 * c) % 11) for c in range(14) for _ in range(1 + c % 2)], "chunk int, n long")
    own, base = {}, 0
    for r in sorted(found.collect()):
        own[r.chunk] = own.get(r.chunk, 0) + -(-r.n // 4)
    got = {r.chunk: r.base for r in to._bases(found, to.Params(length=4)).collect()}
    for c in sorted(own):
        assert got[c] == base
        base += own[c]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert to.write_shards(docs, f"file://{tmp_path}/e").count() == 0
