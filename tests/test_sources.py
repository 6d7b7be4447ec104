import json

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.session import session
from tidemill.sources import providers

CH = lambda k: "UC" + f"{k:022d}"


def test_search_page(spark):
    body = json.dumps({"items": [{"id": "a", "title": "A", "url": "https://x.example/1"}, {"title": "no id"}, {"id": "b"}], "nextPageToken": "t"})
    rows = providers.search_page(spark.createDataFrame([(1, body), (2, "{}"), (3, "not json"), (4, None)], "run int, body string")).collect()
    assert [(r.run, r.rank, r.id, r.has_next) for r in rows] == [(1, 1, "a", True), (1, 3, "b", True)]


def test_staging_and_requests(spark):
    cands = spark.createDataFrame([("https://ok.example/a", "fine", 1), ("https://ok.example/a", "again", 2), ("https://m.noise.example/x", "t", 3), ("https://b.example", "Top 10 lists", 4), ("https://old.example", "t", 5)], "url string, title string, rank int")
    known = spark.createDataFrame([("https://old.example",)], "url string")
    got = {r.url: r.noise for r in providers.staged(cands, known, ("noise.example",), r"(?i)^top \d+").collect()}
    assert got == {"https://ok.example/a": None, "https://m.noise.example/x": "EXCLUDED_DOMAIN", "https://b.example": "NOISE_TITLE"}
    q = spark.createDataFrame([('"a"  b', "de", None)], "q string, co string, la string").select(providers.search_request("q", "co", "la", 99, -1).alias("r")).first().r
    assert tuple(q) == ("a b", "DE", "en", 20, 0)


def test_featured_sections(spark):
    sections = {"items": [{"type": "multipleChannels", "position": 2, "channels": [CH(3), CH(1)]}, {"type": "multipleChannels", "position": 1, "channels": [CH(1), "bad", CH(2), CH(1)]}, {"type": "other", "position": 0, "channels": [CH(9)]}]}
    rows = providers.featured(spark.createDataFrame([("p", json.dumps(sections)), ("q", json.dumps({"items": []}))], "parent string, body string"), most=2)
    assert [(r.n, r.channel_id) for r in rows.orderBy("n").collect()] == [(1, CH(1)), (2, CH(2))]


def test_paged_records(spark, tmp_path):
    for p in range(5):
        (tmp_path / f"{p}.json").write_text(json.dumps({"page": p, "items": [{"k": p}, {"k": -p}]}))
    providers.register(spark)
    read = lambda **o: spark.read.format("paged_records").option("path", str(tmp_path)).options(**o).load()
    assert read().count() == 10
    assert read(maxPages="2").agg(F.max("page")).first()[0] == 1
    assert read(quota="7", pageCost="3").count() == 4


def test_retry_and_components(spark):
    got = [r[0] for r in spark.range(6).select(providers.retry_delay_ms(F.col("id"))).collect()]
    assert got == [100.0, 200.0, 400.0, 800.0, None, None]


def test_schemas(spark):
    df = spark.createDataFrame([("1", "x", "en", "s", "2024-01-01")], "doc_id string, text string, lang string, source string, observed_at string")
    out = schemas.conform(df.withColumn("extra", F.lit(1)), "document")
    assert out.columns == ["doc_id", "text", "lang", "source", "observed_at"] and out.first().doc_id == 1
    with pytest.raises(ValueError, match="lacks text"):
        schemas.conform(df.drop("text"), "document")
    for name, ddl in schemas.ENTITIES.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_session(spark):
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"
