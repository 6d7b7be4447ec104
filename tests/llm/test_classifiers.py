import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from tidemill.llm import common, language_id, quality, queries

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    found = queries.op2_language_id(spark, DATA)
    rows = found.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(own) / len(own) > 0.97


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    rows = [(i, t, lang, 0) for i, (t, lang) in enumerate([("the cat and the dog went home", "en"), ("der hund und die katze gehen heim", "de"), (None, "en"), ("123 !!", "fr"), ("the dog", None)])]
    docs = spark.createDataFrame(rows, schema)
    contents = language_id.train(docs.select("doc_id", "text", "lang"))
    assert sorted(contents) == ["de", "en"]
    test = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (3, "12 + 3", "x", 0), (4, "the cat went home", None, 0), (4, "die katze und der hund " * 9000, None, 0), (None, "und die katze", None, 0)], schema)
    got = language_id.identify(test, contents)
    assert got.select("row.*").columns == docs.columns
    assert [(r.lang_pred, r.rejected) for r in got.collect()] == [("und", True), ("und", True), ("und", True), ("en", False), ("de", False), ("de", False)]
    assert language_id.identify(test, {}).where("lang_pred = 'und'").count() == 6
    assert language_id.identify(test.where("false"), contents).count() == 0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_letters(text):
    own = " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split())
    return own if any(unicodedata.category(c)[0] == "L" for c in own) else ""


def test_language_against_plain_zstandard(spark):
    """Sample, dictionaries and sizes computed again, text by text, with nothing of the operator but its parameters."""
    p = language_id.Params()
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seen, count = {}, {}
    for i, text, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text and plain_letters(text):
            count[lang] = count.get(lang, 0) + 1
            h = signed(xxhash.xxh64(text.encode(), seed=42).intdigest())
            seen[lang, h % p.snippets] = min(seen.get((lang, h % p.snippets), (h, text)), (h, text))
    contents = {}
    for (lang, _), (h, text) in sorted(seen.items(), key=lambda x: x[1]):
        at = ((h % (1 << 64)) >> 8) % (max(len(text) - p.snippet_chars, 0) + 1)
        contents.setdefault(lang, []).append(plain_letters(text[at : at + p.snippet_chars]))
    size = {}
    for lang in sorted(contents, key=lambda x: (-count[x], x)):
        content = " ".join(contents[lang]).encode()
        own = zstandard.ZstdCompressionParameters.from_level(p.level, dict_size=len(content), min_match=p.min_match, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        size[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=own)
    found = {r.doc_id: r.lang_pred for r in queries.op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    for i, text, _ in docs:
        raw = plain_letters(text or "").encode()
        sizes = {lang: sum(len(c.compress(raw[a : a + p.chunk])) for a in range(0, len(raw), p.chunk)) for lang, c in size.items()}
        assert found[i] == (min(sizes, key=sizes.get) if raw else "und")


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅳ ⅻ ⁵", "\u0301 \u093e", "_ __", "٣ ৪", "😀 ✓"])
def test_no_letter_is_undetermined(spark, text):
    c = language_id.Compressors({"en": b"the cat and the dog", "de": b"der hund und die katze"}, language_id.Params())
    assert c.predict(text) == ("und", 0.0, True) and c.predict(text + " dog")[0] == "en"
    assert language_id.letters("क्या 1 é") == "क्या é"


def test_quality_against_dense_equations(spark):
    """Statistics, normal equations and pooling over all rows at once give the scores that partitions summed up to."""
    p, path = quality.Params(), DATA
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect() if r.quality is not None}
    x = np.vstack([quality.statistics(*common.column_bytes(pa.array([r.text]))) for r in docs])

    def fold(row):
        h = 42
        for v in row:
            h = xxhash.xxh64(struct.pack("<d", v + 0.0), seed=h).intdigest()
        return signed(h) % 4

    learn = np.array([r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in docs])
    y = np.array([labels.get(r.doc_id, 0) for r in docs], dtype=float)
    folds = np.array([fold(row) for row in x])
    fit, rest = learn & (folds > 0), learn & (folds == 0)
    assert fit.sum() > 50 and rest.sum() > 10
    rng = np.random.Generator(np.random.PCG64(p.seed))
    w, b = rng.normal(size=(x.shape[1], p.size)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, p.size)
    scale = np.sqrt(np.maximum((x[fit] ** 2).mean(0) - x[fit].mean(0) ** 2, 1e-8))
    z = np.hstack([np.sqrt(2 / p.size) * np.cos(np.clip((x - x[fit].mean(0)) / scale, -6, 6) @ w + b), np.ones((len(x), 1))])
    penalty = np.append(np.full(p.size, np.sqrt(p.ridge * fit.sum())), 0)
    beta = np.linalg.lstsq(np.vstack([z[fit], np.diag(penalty)]), np.append(y[fit], np.zeros(p.size + 1)), rcond=None)[0]
    raw = z @ beta
    place = np.clip(((raw[rest] + 0.5) * p.bins / 2).astype(int), 0, p.bins - 1)
    used = np.unique(place)
    n, hits = np.array([(place == k).sum() for k in used]), np.array([y[rest][place == k].sum() for k in used])
    mean = lambda a, z: hits[a : z + 1].sum() / n[a : z + 1].sum()
    rising = np.array([max(min(mean(a, z) for z in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))])
    at = (used + 0.5) * 2 / p.bins - 0.5
    knots = [(np.average(at[rising == v], weights=n[rising == v]), v) for v in np.unique(rising)]
    want = np.interp(raw, *zip(*knots))
    got = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert max(abs(got[r.doc_id] - s) for r, s in zip(docs, want)) < 1e-5


def test_quality_ties_and_order(spark):
    """Equal texts have equal scores, whatever their ids and whichever partition they are in."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text")).repartition(5)
    scores = {}
    for r in quality.classify(twice, labels).collect():
        scores.setdefault(r.doc_id % 1_000_000, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_quality_held_out(spark):
    rows = queries.op10_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = [r.score for r in test if r.quality], [r.score for r in test if not r.quality]
    pairs = [(g > b) + (g == b) / 2 for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "  \n", 5), (None, "a b", 5), (3, "word " * 60_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(docs, labels.where("false")).columns == docs.columns
    assert quality.keep_good(docs, labels.where("false")).count() == 5
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_pool_is_isotonic():
    x, y = pool_case()
    knots, values = quality.pool(x, y, np.ones(len(x)))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    assert abs(values.mean() - y.mean()) < 0.5


def pool_case():
    rng = np.random.default_rng(4)
    x = np.arange(50.0)
    return x, x / 50 + rng.normal(0, 0.3, 50)


def test_words_match_split():
    texts = ["  a bb\tccc\n", "", None, "é ü\x0bz", "tail", "head  ", "x" * 9000]
    buf, off = common.column_bytes(pa.array(texts))
    w = common.Words(buf, off, common.SPACE_TABLE)
    own = [bytes(buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    assert own == [x for t in texts for x in (t or "").encode().split()]
    assert list(np.diff(w.doc_at)) == [len((t or "").encode().split()) for t in texts]
    again = common.Words(*common.column_bytes(pa.array(["ccc tail a"])), common.SPACE_TABLE)
    assert [w.hashes[own.index(x)] for x in (b"ccc", b"tail", b"a")] == list(again.hashes)
