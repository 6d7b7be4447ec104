"""Queries of reports, table changes and provider answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import reporting as P
from ..sources import providers
from ..sources.tables import table
from .bindings import CREATORS, EXAMPLES, SIGHTINGS, creators, examples, sightings, sql
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


@query(sql(CREATORS, query="SELECT creator_id, name || ': ' || status || ' (' || quality || ') - ' || CASE WHEN quality >= 50 THEN segment || ', ' || region ELSE 'nothing' END || ' for, ' || CASE WHEN quality < 50 THEN segment ELSE 'nothing' END || ' against' AS line FROM creators"))
def r01_evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.when(c("quality") >= 50, F.array("segment", "region")).otherwise(F.array().cast("array<string>"))
    no = F.when(c("quality") < 50, F.array("segment")).otherwise(F.array().cast("array<string>"))
    return creators(spark, sf_dir).select("creator_id", P.report_line("name", "status", "quality", yes, no).alias("line"))


@query(sql(SIGHTINGS, query="SELECT event_id, outcome = 'CONFIRMED' AND quality >= 55 AS quality_creator, event_id % 2 = 0 AND (epoch_us(TIMESTAMP '2026-01-10') - epoch_us(ts)) / 86400e6 > 730 AS stale, outcome IN ('NON_TRADING') AS terminal FROM sightings"))
def r02_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).withColumns({"kind": F.when(c("event_id") % 2 == 0, "VIDEO").otherwise("CHANNEL"), "state": F.when(c("outcome") == "NON_TRADING", "REJECTED").otherwise(c("outcome"))})
    return s.select("event_id", P.is_quality("outcome", "quality").alias("quality_creator"), P.stale_document("kind", "ts", "2026-01-10").alias("stale"), P.is_terminal("state").alias("terminal"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 10 <> 0 AS safe FROM events")
def r03_payload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    payload = F.create_map(F.when(c("k") % 10 == 0, "authToken").otherwise("k"), c("k").cast("double"))
    return e.select("event_id", P.safe_payload(payload).alias("safe"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, best FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def r04_lateral_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").withColumn("k", c("o_custkey"))
    return P.with_aggregate(cu, o, ["k"], n=F.count("*"), best=F.max("o_totalprice")).select(c("k").alias("c_custkey"), F.coalesce("n", F.lit(0)).alias("n"), "best")


@query("""SELECT user_id, (SELECT arg_max(value, event_id) FROM events p WHERE p.user_id = u.user_id AND event_type = 'purchase') AS purchase, (SELECT arg_max(value, event_id) FROM events p WHERE p.user_id = u.user_id AND event_type = 'view') AS viewed, (SELECT arg_max(event_type, event_id) FROM events p WHERE p.user_id = u.user_id) AS last_type FROM (SELECT DISTINCT user_id FROM events) u""")
def r05_latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = [F.desc("event_id")]
    return P.latest_of_all(e.select("user_id").distinct(), "user_id", {"purchase": (e.where("event_type = 'purchase'"), order, "value"), "viewed": (e.where("event_type = 'view'"), order, "value"), "last_type": (e, order, "event_type")})


@query("""SELECT c_custkey, c_mktsegment, (SELECT max(o_totalprice) FROM orders) AS top FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def r06_exists_beside_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rich = P.having(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), o.where("o_totalprice > 300000").withColumn("c_custkey", c("o_custkey")), "c_custkey")
    return P.beside(rich, o.agg(F.max("o_totalprice").alias("top")))


@query(sql(SIGHTINGS, query="SELECT run_id, n, lag(n) OVER (ORDER BY run_id) AS previous_n FROM (SELECT run_id, count(*) AS n FROM sightings GROUP BY 1)"))
def r07_previous_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sightings(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return P.with_previous(runs, "k", "run_id", "n").drop("k")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0""")
def r08_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = t.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit(None).cast("string"))
    return P.delete_using(P.update_from(t, new, "c_custkey", ["c_mktsegment"]), t.where("c_custkey % 5 = 0"), "c_custkey")


@query(sql(EXAMPLES, query="""SELECT dimension, value, count(*) AS n, count(*) FILTER (truth) AS positive FROM (SELECT 'segment' AS dimension, segment AS value, truth FROM examples UNION ALL SELECT 'predicted', predicted, truth FROM examples UNION ALL SELECT 'flag', unnest(CASE WHEN toxic = 1 THEN ['toxic', 'any'] ELSE ['any'] END), truth FROM examples) GROUP BY 1, 2"""))
def r09_admission_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).withColumns({"positive": c("truth"), "flags": F.when(c("toxic") == 1, F.array(F.lit("toxic"), F.lit("any"))).otherwise(F.array(F.lit("any")))})
    return P.admission_baseline(rows, {"segment": "segment", "predicted": "predicted", "flag": "flags"})


@query(sql(EXAMPLES, query="""SELECT truth, count(*) AS n, round(sum(w), 6) AS weight, round(sum(CASE WHEN predicted = 'NEGATIVE' THEN w ELSE 0 END) / sum(w), 9) AS withheld_share FROM (SELECT *, 10000.0 / inclusion_bp AS w FROM examples WHERE score < 0.9) GROUP BY truth"""))
def r10_visible_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = examples(spark, sf_dir).withColumns({"visible": c("score") < 0.9, "withheld": c("predicted") == "NEGATIVE", "v": F.lit(2)})
    old = e.withColumns({"v": F.lit(1), "withheld": F.lit(True)})
    return P.visible_counterfactual(e.unionByName(old), "key", [F.desc("v")], 10000.0 / c("inclusion_bp"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS observations FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def r11_counted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counted_latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "observations")


@query("""SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN NULL ELSE o_orderdate END AS d FROM orders) ORDER BY d ASC NULLS LAST, o_orderkey LIMIT 400""")
def r12_deadline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 50 == 0, c("o_orderdate")).alias("d"))
    return P.by_deadline(o, "d", "o_orderkey", 400)


@query("""SELECT page_id % 20 AS k, page_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id % 3 DESC, page_id) AS rank FROM pages""")
def r13_ranked_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select((c("page_id") % 20).alias("k"), "page_id", (c("page_id") % 3).alias("s"))
    return P.ranked_surfaces(p, "k", "s", "page_id").drop("s")


@query("""SELECT 'event' AS kind, event_id AS id, event_type AS a, NULL AS b FROM events UNION ALL SELECT 'order', o_orderkey, NULL, o_orderpriority FROM orders""")
def r14_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), c("event_id").alias("id"), c("event_type").alias("a"))
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), c("o_orderkey").alias("id"), c("o_orderpriority").alias("b"))
    return P.together(e, o)


@query("""SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'nation_1' THEN 'United' WHEN 'nation_2' THEN 'United' ELSE 'Nation_' || n_nationkey END AS country FROM nation""")
def r15_country_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", P.canonical_country("n_name", {"NATION_1": "United", "Nation_2": "United"}).alias("country"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([a-z0-9.-]*\\.)?example\\.com([/?#:]|$)') THEN 'SOCIAL' WHEN regexp_matches(url, '^https?://([a-z0-9.-]*\\.)?example\\.net([/?#:]|$)') THEN 'STORE' WHEN regexp_matches(url, '^https?://[^/?#:]') THEN 'WEBSITE' ELSE 'NONE' END AS kind FROM pages""")
def r16_external_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.external_identity("url", {"example.com": "SOCIAL", "example.net": "STORE"}).alias("kind"))


@query("""WITH t AS (SELECT lang AS source, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}''’.-]*'))) AS text FROM documents), g AS (SELECT text, source, count(*) AS support FROM t GROUP BY 1, 2)
SELECT text, source, support FROM g WHERE support >= 5 AND text NOT IN ('the', 'de', 'and') QUALIFY row_number() OVER (PARTITION BY text ORDER BY support DESC, source) = 1""")
def r17_organic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(c("lang").alias("source"), F.explode(F.array_distinct(words(F.lower("text")))).alias("text"))
    known = spark.createDataFrame([("the",), ("de",), ("and",)], "text string")
    return P.organic_queries(t.groupBy("text", "source").agg(F.count("*").alias("support")), 5, known)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM (SELECT user_id % 20 AS k, ts, event_id FROM events) WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)), i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY ts, event_id) AS s FROM g)
SELECT k, min(ts) AS started_at, count(*) AS events FROM i GROUP BY k, s""")
def r18_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.episodes(table(spark, sf_dir, "events").withColumn("k", c("user_id") % 20), "k", "6 hours")


@query("""WITH f AS (SELECT user_id % 30 AS lock, user_id AS owner FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, user_id) = 1) SELECT lock, owner, CASE WHEN lock % 3 = 0 AND owner <> lock THEN 'HELD' ELSE 'ACQUIRED' END AS result FROM f""")
def r19_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((c("user_id") % 30).alias("lock"), c("user_id").alias("owner"), c("ts").alias("requested_at"))
    until = F.when(c("lock") % 3 == 0, F.lit("2024-03-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp"))
    locks = e.select("lock").distinct().select("lock", c("lock").alias("owner"), until.alias("until"))
    return P.lease(locks, e, "2024-02-01")


@query("""SELECT user_id, count(DISTINCT event_type) AS stages, arg_max(event_type, (ts, event_id)) AS last_stage, count(*) AS events, bool_or(event_type IN ('purchase', 'error')) AS ended FROM events GROUP BY 1""")
def r20_session_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trace(table(spark, sf_dir, "events").withColumn("stage", c("event_type")), "user_id")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS event_type, arg_max(value, event_id) FILTER (value > 20) AS value FROM events GROUP BY 1""")
def r21_trigger_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(c("event_type") != "view", c("event_type")).alias("event_type"), F.when(c("value") > 20, c("value")).alias("value"))
    return P.projected(e, "user_id", "event_id", ["event_type", "value"])


@query("""SELECT 'lang' AS dimension, lang AS value, count(*) FILTER (n_chars >= 1000) AS ready, count(*) FILTER (n_chars < 1000) AS waiting FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FILTER (n_chars >= 1000), count(*) FILTER (n_chars < 1000) FROM documents GROUP BY source""")
def r22_stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stage_summary(table(spark, sf_dir, "documents"), ["lang", "source"], c("n_chars") >= 1000)


@query("""SELECT p_partkey AS query_id, type, term FROM (SELECT p_partkey, 'p_brand' AS type, lower(trim(p_brand)) AS term FROM part UNION ALL SELECT p_partkey, 'p_type', lower(trim(p_type)) FROM part UNION ALL SELECT p_partkey, 'p_name', lower(trim(p_name)) FROM part) WHERE term <> ''""")
def r23_query_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("query_id", c("p_partkey"))
    return providers.query_components(p.unionByName(p.where("p_size < 5")), ["p_brand", "p_type", "p_name"])


@query("""SELECT event_type AS provider, event_id AS call_id, 1 AS attempt, CASE WHEN value > 50 THEN 'TIMEOUT' WHEN user_id % 5 < 4 THEN 'SUCCESS' ELSE 'ERROR' END AS status, least(value, 50.0) AS latency_ms, 1 AS cost FROM events""")
def r24_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("event_type").alias("provider"), c("event_id").alias("call_id"), F.lit(1).alias("attempt"), c("value").alias("elapsed_ms"), F.when(c("user_id") % 5 < 4, 200).otherwise(500).alias("http"), F.lit(1).alias("cost"))
    return providers.call_events(e, 50.0)
