import random

import numpy as np
import pytest

from tidemill.llm import sentencepiece_nbest as sp


@pytest.fixture(scope="module")
def enc():
    return sp.load(sp.default_model())


def brute(enc, text):
    """Every segmentation of a short text with its score, best first."""
    if not text:
        return [(0.0, [])]
    raw = b" " + text.encode()
    into = {}
    for j, edges in enumerate(enc.lattice(raw)):
        for start, piece, score in edges:
            into.setdefault(start, []).append((j, enc.ids_of(raw, start, j, piece), score * sp.UNIT))
    out = []

    def walk(at, ids, score):
        if at == len(raw):
            out.append((score, ids))
        for j, own, s in into.get(at, []):
            walk(j, [*ids, *own], score + s)

    walk(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


TEXTS = ["", " ", "a", "the cat", "of the inner", "é▁x", "  two  ", "a\nb\tc", "梦想 ң", "\U0001f600!", "<s> <0x41>", "ab12", "thndhain"]


@pytest.mark.parametrize("text", TEXTS)
def test_nbest_against_enumeration(enc, text):
    want = brute(enc, text)
    got = enc.nbest(text, 6)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]])
    assert len(got) == min(6, len(want)) and len({tuple(i) for _, i in got}) == len(got)
    assert all(enc.decode(i) == text.encode() for _, i in got)
    assert got[0][1] == enc.encode(text)
    sums = {tuple(i): s for s, i in want}
    assert all(sums[tuple(i)] == pytest.approx(s) for s, i in got)


def test_batch_equals_single_chunks(enc):
    rng = random.Random(6)
    texts = ["".join(rng.choice("thaenior é.\n▁ü1") for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    texts += ["x" * 100, "word" * 60 + " ñ", "日本語" * 40]
    raw = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    batch = enc.encode_batch(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for d, t in enumerate(texts):
        ids = batch.tokens[batch.token_at[d] : batch.token_at[d + 1]].tolist()
        assert ids == enc.encode(t) and enc.decode(ids) == t.encode()
        if t:
            into = enc.lattice(b" " + t.encode())
            assert batch.nbest(d, 1)[0][0] == enc.forward(into)[-1] * sp.UNIT


class Toy(sp.Encoder):
    """Pieces of our own, so that nothing rests on a model file."""

    def __init__(self, scores):
        self.pieces = {p: 256 + k for k, p in enumerate(scores)}
        self.piece_bytes = [bytes([b]) for b in range(256)] + list(scores)
        self.byte_ids = np.arange(256, dtype=np.int32)
        self.scores = np.array([0] * 256 + [round(v / sp.UNIT) for v in scores.values()], dtype=np.int64)
        self.unknown, self.longest = round(-9 / sp.UNIT), max(map(len, scores))
        self.inside = np.zeros((256, 256), dtype=bool)
        for p in scores:
            for a, b in zip(p, p[1:]):
                self.inside[a, b] = True
        self._index()


def test_ties_and_runs_against_enumeration():
    toy = Toy({b" ": -1.0, b"a": -1.0, b"b": -1.5, b"aa": -2.0, b"ab": -2.5, b"aaa": -2.9, b"ba": -2.5, b" a": -1.7})
    rng = random.Random(2)
    for size in range(1, 13):
        for text in {"a" * size, "".join(rng.choice("ab") for _ in range(size)), "".join(rng.choice("ab c\u00e9") for _ in range(size))}:
            want, got = brute(toy, text), toy.nbest(text, 9)
            assert [s for s, _ in got] == [s for s, _ in want[:9]] and len({tuple(i) for _, i in got}) == len(got)
            assert got[0][1] == toy.encode(text) == list(toy.chunk_nbest(b" " + text.encode(), 1)[0][1])
            assert all(toy.decode(i) == text.encode() and (s, i) in want for s, i in got)


@pytest.mark.parametrize("c", "x.#a")
def test_long_runs(enc, c):
    got = enc.nbest(c * 20_000, 4)
    assert len({tuple(i) for _, i in got}) == 4 and all(enc.decode(i) == c.encode() * 20_000 for _, i in got)
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_batch_equals_single_search(enc):
    texts = ["ab" * k + "." * (45 - k) for k in range(40)] + ["#" * 300, "x" * 500]
    for t in texts:  # one rule of ties, by chunk and by batch
        own = enc.nbest(t, 4)
        assert own[0][1] == enc.encode(t) and own[0][0] == enc.forward(enc.lattice(b" " + t.encode()))[-1] * sp.UNIT


def test_query_rows(spark, enc):
    docs = spark.createDataFrame([(1, "the cat", 0), (2, None, 0), (2, "", 0), (None, "x▁ y", 0), (5, "long text " * 20_000, 0)], "doc_id long, text string, ids int")
    rows = sp.encode(docs)
    assert all(r.round_trip and len(r.ids) == r.n_tokens and r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in rows.collect())
    texts = {1: "the cat", None: "x▁ y", 5: "long text " * 20_000}
    for r in rows.collect():
        text = texts.get(r.doc_id, "")
        whole = [(b.score, sp.edited(r.ids, b.edits)) for b in r.nbest]
        assert whole[0][1] == r.ids and whole == [(s, list(i)) for s, i in enc.nbest(text, 4)] and [s for s, _ in whole] == r.nbest_scores
    back = sorted((r.doc_id or 0, r.text) for r in sp.decode(rows).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in [tuple(r) for r in docs.collect()])
    assert sp.encode(docs.where("false")).count() == 0
