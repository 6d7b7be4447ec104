import corpus_pipeline
from tidemill.llm import quality
from tidemill.llm.common import table

from .test_dedup import brute
from .test_spans import brute_hits

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DATA)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id for r in out.collect()}
        if name.startswith("quality"):
            labels = table(spark, DATA, "labels")
            found = quality.classify(docs, labels)
            assert got == {r.doc_id for r in found.where("predicted = 1").collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good - got) <= 0.05 * len(good)
        elif name.startswith("exact"):
            groups = {}
            for i, t in before.items():
                groups.setdefault("".join(c for c in t or "" if c not in "\t\n\x0b\x0c\r "), []).append((-len(t or ""), i))
            assert got == {min(g)[1] for g in groups.values()}
        elif name.startswith("minhash"):
            assert got == {i for i, (_, c) in brute(list(before.items()), 80).items() if i == c}
        elif name.startswith("benchmark"):
            assert got == {r[0] for r in brute_hits(list(before.items()), items, 10) if not r[5]}
        else:
            assert got == set(before) and all(r.round_trip for r in out.collect())
        docs = out
        counts.append(len(got))
    assert counts == sorted(counts, reverse=True)
    assert corpus_pipeline.run(spark, DATA).count() == counts[-1]


def test_stages_on_odd_rows(spark, tmp_path):
    good = table(spark, DATA, "documents").limit(3).collect()
    rows = [(good[0].doc_id, good[0].text, "en", "s", 1, "x"), (900, None, None, None, None, None), (901, "", "en", None, 0, "y"), (None, good[1].text, None, None, None, None), (902, good[0].text, "en", "s", 1, "z"), (902, good[0].text, "en", "s", 1, "z"), (903, "one two", "en", "s", 1, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for start, name in ((docs, "odd"), (docs.where("false"), "empty")):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, DATA)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
        ids = [r.doc_id for r in now.collect()]
        assert len(ids) == len(set(ids)) and 902 not in ids
