"""Queries of result-set analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import quota_day
from ..operators import analytics as A
from ..operators.relational import apportion
from ..sources.tables import table
from .bindings import ACTIONS, CREATORS, FIRSTS, SIGHTINGS, actions, creators, observations, sightings, sql
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

JR = lambda x, d=0: f"(floor(({x}) * {10**d}.0 + 0.5) / {10**d}.0)"
RATIO = lambda a, b: f"(CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"

FUNNEL = f"""counts AS (
  SELECT run_id, count(*) AS distinct_creators, count(*) FILTER (persisted AND NOT was_known) AS new_creators,
         count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, count(*) FILTER (outcome = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (outcome = 'UNCERTAIN') AS uncertain,
         count(*) FILTER (outcome = 'NON_TRADING') AS non_trading, count(*) FILTER (outcome = 'COUNTRY_REJECTED') AS country_rejected,
         count(*) FILTER (outcome = 'CONFIRMED' AND quality >= 55) AS quality_creators, count(*) FILTER (has_community) AS community_creators,
         {JR("coalesce(avg(quality) FILTER (persisted), 0)")} AS avg_quality FROM firsts GROUP BY run_id
), raws AS (SELECT run_id, count(*) AS raw_results FROM sightings GROUP BY run_id
), rates AS (
  SELECT *, non_trading + uncertain + needs_review + confirmed AS evaluated, greatest(0, raw_results - distinct_creators) AS duplicates,
         {RATIO("new_creators", "distinct_creators")} AS novelty, {RATIO("distinct_creators - country_rejected", "distinct_creators")} AS country_precision,
         {RATIO("confirmed", "(non_trading + uncertain + needs_review + confirmed)")} AS trading_precision,
         {RATIO("quality_creators", "(non_trading + uncertain + needs_review + confirmed)")} AS quality_yield,
         {RATIO("community_creators", "(non_trading + uncertain + needs_review + confirmed)")} AS community_yield FROM counts JOIN raws USING (run_id)
), funnel AS (
  SELECT *, {JR("100 * (0.30 * trading_precision + 0.25 * novelty + 0.20 * quality_yield + 0.15 * country_precision + 0.10 * community_yield)")} AS score FROM rates
)"""


@query(sql(SIGHTINGS, FIRSTS, FUNNEL, query="SELECT * FROM funnel"))
def q01_query_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.query_funnel(sightings(spark, sf_dir), ["run_id"])


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).join(creators(spark, sf_dir).select("creator_id", "country", "region", "segment"), "creator_id")


LOCATED = "located AS (SELECT sightings.*, country, region, segment FROM sightings JOIN creators USING (creator_id))"


@query(sql(SIGHTINGS, CREATORS, LOCATED, query="""
SELECT dimension, value, count(*) AS events, count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, count(*) FILTER (outcome = 'COUNTRY_REJECTED') AS rejected, count(*) FILTER (event_id % 17 = 0) AS corrections
FROM (SELECT 'all' AS dimension, 'ALL' AS value, * FROM located UNION ALL SELECT 'country', country, * FROM located UNION ALL SELECT 'segment', segment, * FROM located)
GROUP BY dimension, value"""))
def q02_replay_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _located(spark, sf_dir).withColumn("recorded_at", F.col("ts"))
    return A.replay_funnel(s.unionByName(s), ["country", "segment"], "event_id", F.col("event_id") % 17 == 0)


@query(sql(SIGHTINGS, FIRSTS, FUNNEL, query="""
SELECT run_id, metric, expected, actual, actual - expected AS delta, abs(actual - expected) <= 0.05 * greatest(1.0, abs(expected)) AS within FROM (
  SELECT run_id, 'confirmed' AS metric, CAST(confirmed AS DOUBLE) AS expected, CAST(quality_creators AS DOUBLE) AS actual FROM funnel
  UNION ALL SELECT run_id, 'distinct_creators', CAST(distinct_creators AS DOUBLE), CAST(raw_results AS DOUBLE) FROM funnel)"""))
def q02b_metric_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.query_funnel(sightings(spark, sf_dir), ["run_id"])
    other = f.select("run_id", F.col("quality_creators").alias("confirmed"), F.col("raw_results").alias("distinct_creators"))
    return A.reconcile(f.select("run_id", "confirmed", "distinct_creators"), other, ["run_id"], ["confirmed", "distinct_creators"], 0.05)


@query(sql(SIGHTINGS, FIRSTS, FUNNEL, query="SELECT sum(raw_results) AS raw_results, sum(distinct_creators) AS distinct_creators, sum(new_creators) AS new_creators, sum(confirmed) AS confirmed, sum(duplicates) AS duplicates FROM funnel"))
def q02c_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(A.query_funnel(sightings(spark, sf_dir), ["run_id"]), ["raw_results", "distinct_creators", "new_creators", "confirmed", "duplicates"])


@query(sql(SIGHTINGS, CREATORS, LOCATED, query="""
SELECT region, segment, count(DISTINCT run_id) AS runs, count(DISTINCT creator_id) AS creators, count(DISTINCT creator_id) FILTER (outcome = 'CONFIRMED') AS confirmed,
       count(DISTINCT creator_id) FILTER (NOT was_known) AS new, count(DISTINCT creator_id) FILTER (outcome = 'CONFIRMED' AND quality >= 55) AS quality FROM located GROUP BY region, segment"""))
def q03_lane_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lane_performance(_located(spark, sf_dir), ["region", "segment"])


@query(sql(CREATORS, query="SELECT count(*) AS total, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'REVIEW') AS in_review, count(*) FILTER (quality >= 55) AS quality, (SELECT count(*) FROM events) AS events FROM creators"))
def q03b_dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dashboard_summary(creators(spark, sf_dir), table(spark, sf_dir, "events"))


@query("""SELECT event_type AS provider, count(*) AS calls, count(*) FILTER (user_id % 4 < 2) AS successes, count(*) FILTER (user_id % 4 = 2) AS timeouts, count(*) FILTER (user_id % 4 = 3) AS errors,
round(avg(value), 6) AS avg_latency_ms, round(sum(value * 2), 6) AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type""")
def q03c_provider_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
    status = F.when(F.col("user_id") % 4 < 2, "SUCCESS").when(F.col("user_id") % 4 == 2, "TIMEOUT").otherwise("ERROR")
    return A.provider_metrics(e.select(F.col("event_type").alias("provider"), status.alias("status"), F.col("value").alias("latency_ms"), (F.col("value") * 2).alias("cost")), ["provider"])


RUNS_OF = """ordered AS (SELECT neighborhood, run_id, row_number() OVER (PARTITION BY neighborhood ORDER BY run_id) AS i FROM (SELECT DISTINCT neighborhood, run_id FROM sightings)
), members AS (SELECT DISTINCT neighborhood, run_id, creator_id FROM sightings
), placed AS (SELECT members.*, i, lag(i) OVER (PARTITION BY neighborhood, creator_id ORDER BY i) AS last FROM members JOIN ordered USING (neighborhood, run_id)
), perrun AS (SELECT neighborhood, run_id, i, count(*) AS n, count(*) FILTER (last = i - 1) AS shared, count(*) FILTER (last >= i - 5) AS recent FROM placed GROUP BY 1, 2, 3
), lagged AS (SELECT *, lag(n) OVER (PARTITION BY neighborhood ORDER BY i) AS before FROM perrun
), laps AS (SELECT neighborhood, run_id, n, floor(CASE WHEN before IS NOT NULL THEN shared / CAST(n + before - shared AS DOUBLE) END * 1000 + 0.5) / 1000 AS jaccard,
  floor(CASE WHEN before IS NOT NULL THEN recent / CAST(n AS DOUBLE) END * 1000 + 0.5) / 1000 AS overlap FROM lagged)"""


@query(sql(SIGHTINGS, RUNS_OF, query="SELECT * FROM laps"))
def q08_run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_overlap(sightings(spark, sf_dir))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return A.neighborhood_observations(s, A.run_overlap(s))


OBSERVED = """raw_of AS (SELECT neighborhood, run_id, count(*) AS raw FROM sightings GROUP BY 1, 2
), first_of AS (SELECT neighborhood, run_id, count(*) AS "distinct", count(*) FILTER (NOT was_known) AS new, count(*) FILTER (was_known) AS known, count(*) FILTER (outcome = 'CONFIRMED') AS relevant,
    count(*) FILTER (outcome = 'CONFIRMED' AND quality >= 55) AS quality, count(*) FILTER (NOT was_known AND outcome = 'CONFIRMED') AS rn, count(*) FILTER (NOT was_known AND outcome = 'CONFIRMED' AND quality >= 55) AS qn FROM firsts GROUP BY 1, 2
), observed AS (SELECT neighborhood, run_id, raw, "distinct", new, known, relevant, quality, greatest(0, raw - "distinct") / CAST(greatest(1, raw) AS DOUBLE) AS duplicate_ratio,
    known / CAST("distinct" AS DOUBLE) AS known_ratio, new / CAST("distinct" AS DOUBLE) AS new_ratio, rn / CAST("distinct" AS DOUBLE) AS relevant_new, qn / CAST("distinct" AS DOUBLE) AS quality_new, jaccard, overlap
  FROM first_of JOIN raw_of USING (neighborhood, run_id) LEFT JOIN laps USING (neighborhood, run_id))"""


@query(sql(SIGHTINGS, FIRSTS, RUNS_OF, OBSERVED, query="SELECT * FROM observed"))
def q09_neighborhood_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)


BANDED = "banded AS (SELECT run_id, band, count(*) AS creators FROM (SELECT run_id, CASE WHEN quality < 10 THEN 'A' WHEN quality < 40 THEN 'B' WHEN quality < 80 THEN 'C' ELSE 'D' END AS band FROM firsts) GROUP BY 1, 2)"


@query(sql(SIGHTINGS, FIRSTS, BANDED, query="""
SELECT run_id, band, creators, quota, CAST(base + CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY round(share - base, 9) DESC, band) <= quota - total THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM (
  SELECT *, floor(share) AS base, sum(floor(share)) OVER (PARTITION BY run_id) AS total FROM (SELECT *, 100 + run_id % 7 AS quota, (100 + run_id % 7) * creators / sum(creators) OVER (PARTITION BY run_id) AS share FROM banded))"""))
def q10_quota_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    band = F.when(q < 10, "A").when(q < 40, "B").when(q < 80, "C").otherwise("D")
    rows = observations(spark, sf_dir).withColumn("band", band).groupBy("run_id", "band").agg(F.count("*").alias("creators")).withColumn("quota", 100 + F.col("run_id") % 7)
    return apportion(rows, ["run_id"], "creators", "quota", "band")


OBS_VALUE = lambda r, q, c, i, f, quota, o: f"(floor(greatest(0, least(100, 25 * {r}) + least(100, 35 * {q}) + least(100, 20 * {c}) + least(100, 15 * {i}) + least(100, 20 * {f}) - 5 * {quota} / 100.0 - 30 * {o}) * 10 + 0.5) / 10)"


@query(sql(SIGHTINGS, FIRSTS, RUNS_OF, OBSERVED, query=f"""
SELECT neighborhood, run_id, prior_n, {OBS_VALUE("relevant_new", "quality_new", "new_ratio", "quality_new", "greatest(0, 1 - coalesce(overlap, 0))", "raw", "coalesce(overlap, 0)")} AS observed_value,
       CASE WHEN prior_n = 0 THEN 0 ELSE {OBS_VALUE("2 * pr", "1.5 * pq", "pr", "pq", "greatest(0, 1 - po)", "raw", "po")} END AS expected_value FROM (
  SELECT *, count(*) OVER w AS prior_n, avg(relevant_new) OVER w AS pr, avg(quality_new) OVER w AS pq, avg(coalesce(overlap, 0)) OVER w AS po FROM observed
  WINDOW w AS (PARTITION BY neighborhood ORDER BY run_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""))
def q11_expected_value_last20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marginal_values(_observed(spark, sf_dir), F.col("raw")).select("neighborhood", "run_id", "prior_n", "observed_value", "expected_value")


HEALTH_RUNS = """hruns AS (SELECT run_id, country, region, segment, count(*) FILTER (outcome = 'CONFIRMED' AND NOT was_known) AS valuable, count(*) FILTER (NOT was_known) AS new_creators, count(DISTINCT creator_id) AS distinct_creators,
  count(*) AS quota, run_id % 4 / 4.0 AS overlap, run_id % 6 AS source FROM located GROUP BY run_id, country, region, segment)"""


@query(sql(SIGHTINGS, CREATORS, LOCATED, HEALTH_RUNS, query=f"""
SELECT dimension, value, runs, quota, valuable, new_creators, distinct_creators, sources, yield_per_1000, saturation, underexplored_pct, diversity, floor((1 - saturation) * 100 + 0.5) / 100 AS expansion, valuable = 0 OR underexplored_pct < 15 OR runs < 3 AS coverage_gap FROM (
  SELECT dimension, value, count(*) AS runs, sum(quota) AS quota, sum(valuable) AS valuable, sum(new_creators) AS new_creators, sum(distinct_creators) AS distinct_creators, count(DISTINCT source) AS sources,
    {JR("1000.0 * sum(valuable) / greatest(1, sum(quota))", 2)} AS yield_per_1000, greatest(0, least(1, {JR("avg(overlap)", 2)})) AS saturation,
    least(100, {JR("100.0 * sum(" + JR("quota * greatest(0, 1 - overlap)") + ") / greatest(1, sum(quota))", 1)}) AS underexplored_pct, least(1, {JR("count(DISTINCT source) / CAST(greatest(1, count(*)) AS DOUBLE)", 2)}) AS diversity
  FROM (SELECT 'country' AS dimension, country AS value, * FROM hruns UNION ALL SELECT 'region', region, * FROM hruns UNION ALL SELECT 'segment', segment, * FROM hruns) GROUP BY 1, 2)"""))
def q12_segment_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_if = A.n_if
    runs = _located(spark, sf_dir).groupBy("run_id", "country", "region", "segment").agg(n_if("outcome = 'CONFIRMED' AND NOT was_known").alias("valuable"), n_if("NOT was_known").alias("new_creators"), F.countDistinct("creator_id").alias("distinct_creators"), F.count("*").alias("quota"))
    return A.segment_health(runs.withColumns({"overlap": F.col("run_id") % 4 / 4.0, "source": F.col("run_id") % 6}), ["country", "region", "segment"])


@query("""
WITH parsed AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'HIDDEN' WHEN s_suppkey % 3 = 0 THEN CAST(floor(abs(s_acctbal)) AS BIGINT) || 'K' WHEN s_suppkey % 3 = 1 THEN (CAST(floor(abs(s_acctbal)) AS BIGINT) % 90) / 10 || '.5M' ELSE CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) END AS txt FROM supplier),
nums AS (SELECT CASE WHEN regexp_full_match(txt, '[0-9]+(\\.[0-9]+)?[KMB]?') THEN floor(CAST(regexp_extract(txt, '^([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) * CASE right(txt, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END + 0.5) END AS n FROM parsed)
SELECT CASE WHEN n IS NULL OR n < 0 THEN 'UNKNOWN' WHEN n < 10000 THEN 'MICRO_<10K' WHEN n < 100000 THEN 'MID_10K_100K' WHEN n < 500000 THEN 'LARGE_100K_500K' ELSE 'MAJOR_500K+' END AS band, count(*) AS creators FROM nums GROUP BY 1""".replace("% 90) / 10 ||", "% 90) // 10 ||"))
def q14_size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.abs("s_acctbal"))
    text = F.when(F.col("s_suppkey") % 11 == 0, None).when(F.col("s_suppkey") % 7 == 0, "HIDDEN").when(F.col("s_suppkey") % 3 == 0, F.concat(n.cast("string"), F.lit("K"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.floor(n % 90 / 10).cast("string"), F.lit(".5M"))).otherwise(n.cast("string"))
    rows = table(spark, sf_dir, "supplier").withColumn("audience", text)
    twice = rows.withColumn("seen", F.lit(2)).unionByName(rows.withColumn("audience", F.lit("1")).withColumn("seen", F.lit(1)))
    return A.size_bands(twice, "s_suppkey", "audience", [F.desc("seen")])


@query(sql(SIGHTINGS, query=f"""SELECT arm, count(*) AS runs, sum(quota) AS quota, sum(new) AS new, sum(relevant) AS relevant, {JR("1000.0 * sum(new) / sum(quota)", 2)} AS new_per_1000, {JR("1000.0 * sum(relevant) / sum(quota)", 2)} AS relevant_per_1000
FROM (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'CANARY' ELSE 'LEGACY' END AS arm, count(*) AS quota, count(*) FILTER (NOT was_known) AS new, count(*) FILTER (outcome = 'CONFIRMED') AS relevant FROM sightings GROUP BY run_id) GROUP BY arm"""))
def q15_arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sightings(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("quota"), A.n_if("NOT was_known").alias("new"), A.n_if("outcome = 'CONFIRMED'").alias("relevant"))
    return A.arm_comparison(runs.withColumn("arm", F.when(F.col("run_id") % 2 == 0, "CANARY").otherwise("LEGACY")))


PAGES = """paged AS (SELECT neighborhood, CASE WHEN run_id % 3 = 0 THEN 'DATE' ELSE 'RELEVANCE' END AS config, run_id, page, max(ts) AS ts, count(DISTINCT creator_id) AS "distinct", count(*) FILTER (outcome = 'CONFIRMED') AS confirmed,
  count(*) FILTER (outcome = 'CONFIRMED' AND quality >= 55) AS quality, count(*) FILTER (was_known) AS known, count(*) AS quota, 1 - count(DISTINCT creator_id) / CAST(count(*) AS DOUBLE) AS duplicate_ratio FROM sightings GROUP BY 1, 2, 3, 4)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).withColumn("config", F.when(F.col("run_id") % 3 == 0, "DATE").otherwise("RELEVANCE"))
    d = F.countDistinct("creator_id")
    return s.groupBy("neighborhood", "config", "run_id", "page").agg(F.max("ts").alias("ts"), d.alias("distinct"), A.n_if("outcome = 'CONFIRMED'").alias("confirmed"), A.n_if("outcome = 'CONFIRMED' AND quality >= 55").alias("quality"), A.n_if("was_known").alias("known"), F.count("*").alias("quota"), (1 - d / F.count("*")).alias("duplicate_ratio"))


EVIDENCE = f"""perrun2 AS (SELECT neighborhood, config, run_id, sum("distinct") AS d, sum(confirmed) AS c, sum(quality) AS q, sum(known) AS k, sum(quota) AS quota, avg(duplicate_ratio) AS dup, max(ts) AS ts, count(*) AS pages FROM paged GROUP BY 1, 2, 3
), evidence1 AS (SELECT neighborhood, config, count(*) AS runs, {JR("avg(" + RATIO("c", "d") + ")", 3)} AS relevant, {JR("avg(" + RATIO("q", "d") + ")", 3)} AS quality, {JR("avg(dup)", 3)} AS duplicate, {JR("avg(" + RATIO("k", "d") + ")", 3)} AS known,
  round(avg(quota), 6) AS quota, count(*) FILTER (ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent_runs, sum(pages) AS pages, {JR("1 / sqrt(1 + count(*))", 3)} AS uncertainty FROM perrun2 GROUP BY 1, 2
), evidence2 AS (SELECT *, {JR("greatest(0, least(100, 50 * relevant + 50 * quality - 20 * duplicate - 10 * known))", 1)} AS observed FROM evidence1
), evidence AS (SELECT *, {JR("greatest(0, least(100, observed * (1 - 0.3 * uncertainty)))", 1)} AS expected FROM evidence2)"""


@query(sql(SIGHTINGS, PAGES, EVIDENCE, query="SELECT * FROM evidence"))
def q15b_retrieval_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retrieval_evidence(_pages(spark, sf_dir), "2024-01-31")


@query(sql(SIGHTINGS, query="""SELECT run_id, sum(raw) AS raw_results, sum(d) AS distinct_results, round(sum(dup * d) / sum(d), 9) AS duplicate_ratio, round(sum(nov * d) / sum(d), 9) AS novelty FROM (
  SELECT run_id, page, count(*) AS raw, count(DISTINCT creator_id) AS d, 1 - count(DISTINCT creator_id) / CAST(count(*) AS DOUBLE) AS dup, count(*) FILTER (NOT was_known) / CAST(count(*) AS DOUBLE) AS nov FROM sightings GROUP BY 1, 2) GROUP BY run_id"""))
def q15c_page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.countDistinct("creator_id")
    p = sightings(spark, sf_dir).groupBy("run_id", "page").agg(F.count("*").alias("raw_results"), d.alias("distinct_results"), (1 - d / F.count("*")).alias("duplicate_ratio"), (A.n_if("NOT was_known") / F.count("*")).alias("novelty"))
    return A.page_rollup(p, ["run_id"], ["duplicate_ratio", "novelty"])


@query(sql(SIGHTINGS, """m AS (SELECT DISTINCT run_id % 6 AS lane, neighborhood, creator_id FROM sightings)""", """n AS (SELECT neighborhood, lane, count(*) AS n FROM m GROUP BY 1, 2)""", """p AS (SELECT a.neighborhood, a.lane AS la, b.lane AS lb, count(*) AS common FROM m a JOIN m b ON a.neighborhood = b.neighborhood AND a.creator_id = b.creator_id AND a.lane < b.lane GROUP BY 1, 2, 3)""", query="""
SELECT s.neighborhood, seen, coalesce(unseen, 0) AS unseen, round(1 / sqrt(greatest(1, seen)), 9) AS uncertainty FROM (SELECT neighborhood, count(DISTINCT creator_id) AS seen FROM m GROUP BY 1) s
LEFT JOIN (SELECT p.neighborhood, round(avg(greatest(0, x.n * y.n / CAST(common AS DOUBLE) - (x.n + y.n - common))), 6) AS unseen FROM p JOIN n x ON x.neighborhood = p.neighborhood AND x.lane = la JOIN n y ON y.neighborhood = p.neighborhood AND y.lane = lb GROUP BY 1) e USING (neighborhood)"""))
def q36_capture_recapture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.capture_recapture(sightings(spark, sf_dir).withColumn("lane", F.col("run_id") % 6), ["neighborhood"], "lane", "creator_id")


SETS = "sets AS (SELECT DISTINCT run_id AS key, 'creator' AS component, CAST(creator_id AS VARCHAR) AS member FROM sightings UNION SELECT DISTINCT run_id, 'outcome', outcome FROM sightings UNION SELECT DISTINCT run_id, 'page', CAST(page AS VARCHAR) FROM sightings)"


@query(sql(SIGHTINGS, SETS, "n AS (SELECT key, component, count(*) AS n FROM sets GROUP BY 1, 2)", """j AS (SELECT a.key, a.component, b.key AS other, count(*) AS common FROM sets a JOIN sets b ON a.component = b.component AND a.member = b.member AND b.key < a.key GROUP BY 1, 2, 3)""",
    """t AS (SELECT j.key, j.component, max(common / CAST(x.n + y.n - common AS DOUBLE)) AS j FROM j JOIN n x ON x.key = j.key AND x.component = j.component JOIN n y ON y.key = other AND y.component = j.component GROUP BY 1, 2)""", query="""
SELECT key, round(coalesce(v, 0), 9) AS overlap FROM (SELECT DISTINCT key FROM sets) LEFT JOIN (SELECT key, sum(CASE component WHEN 'creator' THEN 0.45 WHEN 'outcome' THEN 0.25 ELSE 0.2 END * j) AS v FROM t GROUP BY key) USING (key)"""))
def q37_ecosystem_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    member = lambda name, c: s.select(F.col("run_id").alias("key"), F.lit(name).alias("component"), F.col(c).cast("string").alias("member"))
    sets = member("creator", "creator_id").unionByName(member("outcome", "outcome")).unionByName(member("page", "page"))
    return A.ecosystem_overlap(sets, "key", {"creator": 0.45, "outcome": 0.25, "page": 0.2})


TRUST = """truns AS (SELECT run_id, segment, count(DISTINCT creator_id) AS distinct_creators, count(*) FILTER (NOT was_known) AS new_creators, count(*) FILTER (NOT was_known AND outcome = 'CONFIRMED') AS relevant_new, count(*) AS quota, run_id % 13 = 0 AS failed, avg(value) AS execution_ms FROM located GROUP BY 1, 2)"""


@query(sql(SIGHTINGS, CREATORS, LOCATED, TRUST, "g AS (SELECT segment, count(*) AS runs, sum(distinct_creators) AS distinct_creators, sum(new_creators) AS new_creators, sum(relevant_new) AS relevant_new, sum(quota) AS quota, count(*) FILTER (failed) AS failures, round(avg(execution_ms), 6) AS avg_execution_ms FROM truns GROUP BY segment)",
    f"r AS (SELECT *, {RATIO('relevant_new', 'new_creators')} AS p, {RATIO('failures', 'runs')} AS f, {RATIO('relevant_new', 'runs')} AS u, 3.8416 AS zz, CAST(new_creators AS DOUBLE) AS n FROM g)", query="""
SELECT segment, runs, distinct_creators, new_creators, relevant_new, quota, failures, avg_execution_ms, round(p, 9) AS precision, round(f, 9) AS failure_rate, round(u, 9) AS relevant_per_run, round(CASE WHEN relevant_new > 0 THEN quota / CAST(relevant_new AS DOUBLE) END, 9) AS cost_per_useful,
  CASE WHEN runs < 20 THEN 'INSUFFICIENT_EVIDENCE' WHEN f >= 0.2 OR p < 0.1 THEN 'DEGRADED' WHEN f >= 0.1 OR u < 0.2 THEN 'WATCH' ELSE 'HEALTHY' END AS status,
  round(CASE WHEN n > 0 THEN greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) END, 9) AS precision_lower,
  round(CASE WHEN n > 0 THEN least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) END, 9) AS precision_upper FROM r"""))
def q38_trust_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _located(spark, sf_dir).groupBy("run_id", "segment").agg(F.countDistinct("creator_id").alias("distinct_creators"), A.n_if("NOT was_known").alias("new_creators"), A.n_if("NOT was_known AND outcome = 'CONFIRMED'").alias("relevant_new"), F.count("*").alias("quota"), F.avg("value").alias("execution_ms"))
    return A.trust(runs.withColumn("failed", F.col("run_id") % 13 == 0), ["segment"])


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.95) AS p95, CASE WHEN quantile_disc(value, 0.95) <= 100 THEN 'PASS' ELSE 'LATENCY_BUDGET_EXCEEDED' END AS status FROM events GROUP BY event_type")
def q39_percentile_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_validation(table(spark, sf_dir, "events"), ["event_type"], "value", 100.0)


@query("""SELECT count(*) FILTER (age <= 15) AS arrived_15m, count(*) FILTER (age <= 15 AND status = 'DONE') AS done_15m, count(*) FILTER (age <= 60) AS arrived_1h, count(*) FILTER (age <= 60 AND status = 'DONE') AS done_1h,
count(*) FILTER (age <= 360) AS arrived_6h, count(*) FILTER (age <= 360 AND status = 'DONE') AS done_6h, count(*) FILTER (status = 'WAITING') AS waiting, min(ts) FILTER (status = 'WAITING') AS oldest_waiting
FROM (SELECT ts, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) / 60e6 AS age, CASE WHEN event_type IN ('purchase', 'signup') THEN 'DONE' ELSE 'WAITING' END AS status FROM events WHERE ts <= TIMESTAMP '2024-01-30')""")
def q40_backlog_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").where("ts <= TIMESTAMP '2024-01-30'").withColumn("status", F.when(F.col("event_type").isin("purchase", "signup"), "DONE").otherwise("WAITING"))
    return A.backlog_windows(jobs, "2024-01-30", [("15m", 15), ("1h", 60), ("6h", 360)])


@query(sql(CREATORS, query="""
SELECT coalesce(region, '*') AS region, coalesce(country, '*') AS country, coalesce(segment, '*') AS segment, count(*) AS n, grouping(region, country, segment) AS level FROM creators GROUP BY ROLLUP (region, country, segment)"""))
def q45_coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage_rollup(creators(spark, sf_dir), ["region", "country", "segment"])


@query(sql(SIGHTINGS, query="SELECT neighborhood AS cell, count(*) AS observations, sum(rank) AS distinct_results, count(*) FILTER (NOT was_known) AS new_creators, count(*) FILTER (was_known) AS duplicate_results, min(ts) AS first_at, max(ts) AS last_at FROM sightings GROUP BY 1"))
def q46_coverage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).select(F.col("event_id").alias("outcome_key"), F.col("neighborhood").alias("cell"), "ts", F.col("rank").cast("long").alias("distinct_results"), (~F.col("was_known")).cast("int").alias("new_creators"), F.col("was_known").cast("int").alias("duplicate_results"))
    return A.coverage_replay(s.unionByName(s.where("outcome_key % 3 = 0")), "outcome_key", "cell")


@query("""SELECT lang, count(DISTINCT CASE WHEN source <> 'src0' THEN CASE WHEN doc_id % 9 = 0 THEN 'doc:' || doc_id ELSE source END END) AS independent_families, count(*) FILTER (source <> 'src0') AS documents, count(*) FILTER (source = 'src0') AS excluded FROM documents GROUP BY lang""")
def q50_source_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("family", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    return A.source_independence(d, "lang", "family", "doc_id", F.col("source") == "src0")


@query("""
WITH r AS (SELECT source AS creator, lang AS family, CASE doc_id % 3 WHEN 0 THEN 'trading' WHEN 1 THEN 'alternative' ELSE 'other' END AS topic, n_chars / 1000.0 AS mass, (50 + doc_id % 50) / 100.0 AS confidence, CAST(doc_id % 800 AS DOUBLE) AS age FROM documents),
f AS (SELECT creator, family, topic, sum(confidence * exp(-age / 730) * mass) AS m FROM r GROUP BY 1, 2, 3), nrm AS (SELECT creator, family, topic, m / sum(m) OVER (PARTITION BY creator, family) AS m FROM f),
k AS (SELECT creator, count(DISTINCT family) AS families FROM f GROUP BY 1)
SELECT creator, topic, families, mass, round(greatest(0, mass - least(0.25, 0.35 / sqrt(families))), 9) AS lower FROM (SELECT creator, topic, families, round(sum(m) / families, 9) AS mass FROM nrm JOIN k USING (creator) GROUP BY 1, 2, 3)""")
def q51_creator_focus_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    topic = F.when(F.col("doc_id") % 3 == 0, "trading").when(F.col("doc_id") % 3 == 1, "alternative").otherwise("other")
    rows = d.select(F.col("source").alias("creator"), F.col("lang").alias("family"), topic.alias("topic"), (F.col("n_chars") / 1000.0).alias("mass"), ((50 + F.col("doc_id") % 50) / 100.0).alias("confidence"), (F.col("doc_id") % 800).cast("double").alias("age"))
    return A.creator_focus(rows, F.col("age"))


@query("""
WITH r AS (SELECT 'c' || (doc_id % 11) AS concept, source AS country, lang AS language, 'Latn' AS script, CASE WHEN doc_id % 4 = 0 THEN ' Corr ' WHEN doc_id % 4 = 1 THEN '' END AS correlation, doc_id AS source_id, 0.95 AS confidence, (70 + doc_id % 30) / 100.0 AS reliability, 0.9 AS validity, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS observed_at, CASE WHEN doc_id % 19 = 0 THEN 'Cyrl' ELSE 'Latn' END AS os FROM documents),
g AS (SELECT concept, country, language, script, count(DISTINCT coalesce(nullif(lower(trim(correlation)), ''), CAST(source_id AS VARCHAR))) AS sources, round(avg(confidence * reliability * validity), 9) AS strength, max(observed_at) AS newest, count(DISTINCT os) AS sc FROM r GROUP BY 1, 2, 3, 4)
SELECT concept, country, language, script, sources, strength, CAST(newest AS TIMESTAMP) AS newest, concat_ws(',', CASE WHEN sources < 2 THEN 'INSUFFICIENT_SOURCES' END, CASE WHEN strength < 0.55 THEN 'WEAK_EVIDENCE' END, CASE WHEN date_diff('day', newest, DATE '2025-01-01') > 180 THEN 'STALE' END, CASE WHEN sc > 1 THEN 'SCRIPT_CONFLICT' END) AS reasons,
  NOT (sources < 2 OR strength < 0.55 OR date_diff('day', newest, DATE '2025-01-01') > 180 OR sc > 1) AS eligible FROM g""")
def q52_osint_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), (i % 11).cast("string")).alias("concept"), F.col("source").alias("country"), F.col("lang").alias("language"), F.lit("Latn").alias("script"), F.when(i % 4 == 0, " Corr ").when(i % 4 == 1, "").alias("correlation"), i.alias("source_id"), F.lit(0.95).alias("confidence"), ((70 + i % 30) / 100.0).alias("reliability"), F.lit(0.9).alias("validity"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("timestamp").alias("observed_at"), F.when(i % 19 == 0, "Cyrl").otherwise("Latn").alias("observed_script"))
    return A.osint_evidence(rows, "2025-01-01")


@query("""SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS quota_day, count(*) AS quota, count(*) FILTER (user_id % 4 = 0) AS exploration_quota, round(count(*) FILTER (user_id % 4 = 0) / CAST(count(*) AS DOUBLE), 6) AS ratio,
round(count(*) FILTER (user_id % 4 = 0) / CAST(count(*) AS DOUBLE), 6) < 0.2 AS floor_active, round(count(*) FILTER (user_id % 4 = 0) / CAST(count(*) AS DOUBLE), 6) >= 0.3 AS ceiling_active FROM events GROUP BY 1""")
def q53_pacific_quota_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.lit(1).alias("quota"), (F.col("user_id") % 4 == 0).alias("exploration"))
    return A.exploration_status(e, quota_day("ts"))


@query("""SELECT source, count(*) AS documents, count(DISTINCT doc_id % 4) AS types, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, CAST(min(o) AS TIMESTAMP) AS oldest, CAST(max(o) AS TIMESTAMP) AS newest, count(*) FILTER (a <= 30) AS within_30, count(*) FILTER (a <= 90) AS within_90, count(*) FILTER (a <= 365) AS within_365, count(*) FILTER (a <= 730) AS within_730, count(*) >= 50 AS complete
FROM (SELECT *, DATE '2023-01-01' + CAST(doc_id % 900 AS INTEGER) AS o, date_diff('day', DATE '2023-01-01' + CAST(doc_id % 900 AS INTEGER), DATE '2025-06-30') AS a FROM documents) GROUP BY source""")
def q62_evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 4).alias("type"), F.col("lang").alias("language"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).cast("timestamp").alias("observed_at"))
    return A.evidence_coverage(d, "source", "2025-06-30", 50)


@query("SELECT o_orderstatus, count(*) FILTER (a <= 30) AS d30, count(*) FILTER (a <= 90) AS d90, count(*) FILTER (a <= 365) AS d365, count(*) FILTER (a <= 730) AS d730 FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS a FROM orders) GROUP BY 1")
def q63_freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.datediff(F.lit("2001-08-01").cast("timestamp"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").withColumn("a", a).groupBy("o_orderstatus").agg(*[A.n_if(F.col("a") <= d).alias(f"d{d}") for d in (30, 90, 365, 730)])


@query(sql(CREATORS, query="""SELECT region, string_agg(DISTINCT country, ',' ORDER BY country) AS country, string_agg(DISTINCT segment, ',' ORDER BY segment) AS segment, count(*) AS rows FROM creators GROUP BY region"""))
def q64_dimension_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.surfaces(creators(spark, sf_dir), "region", ["country", "segment"])


@query(sql(ACTIONS, query="SELECT dimension, value, count(*) AS rows, sum(quota) AS quota FROM (SELECT 'program_id' AS dimension, program_id AS value, provider_cost AS quota FROM actions UNION ALL SELECT 'action_type', action_type, provider_cost FROM actions UNION ALL SELECT 'cluster_key', CAST(cluster_key AS VARCHAR), provider_cost FROM actions) GROUP BY 1, 2"))
def q64b_frontier_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frontier_diagnostics(actions(spark, sf_dir).withColumn("quota", F.col("provider_cost")), ["program_id", "action_type", "cluster_key"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1, 2")
def q64c_status_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_costs(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query("SELECT lang, source, count(*) AS total, count(*) FILTER (n_chars >= 1000) AS available, 10000 * count(*) FILTER (n_chars >= 1000) // count(*) AS availability_bp FROM documents GROUP BY 1, 2")
def q64d_bundle_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bundle_availability(table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars") >= 1000)


@query("SELECT s_nationkey AS key_id, 40 AS \"limit\", CAST(greatest(0, least(40, count(*) * 9)) AS BIGINT) AS used, CAST(40 - greatest(0, least(40, count(*) * 9)) AS BIGINT) AS remaining FROM supplier GROUP BY 1")
def q64e_quota_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key_id"), F.lit(9).alias("units"))
    return A.quota_projection(s, s.select("key_id").distinct().withColumn("limit", F.lit(40))).select("key_id", "limit", F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"))


@query("""
WITH a AS (SELECT user_id % 12 AS k, count(*) AS n, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), b AS (SELECT user_id % 12 AS k, count(*) AS n, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_base, round(a.m - b.m, 9) AS effect, CASE WHEN least(coalesce(a.n, 0), coalesce(b.n, 0)) < 10 THEN 'INSUFFICIENT' WHEN abs(round(a.m - b.m, 9)) < 2 THEN 'OBSERVE' WHEN round(a.m - b.m, 9) < 0 THEN 'AUDIT' ELSE 'REACTIVATION' END AS decision FROM a FULL JOIN b ON a.k = b.k""")
def q64f_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 12)
    return A.drift(e.where("ts >= TIMESTAMP '2024-01-20'"), e.where("ts < TIMESTAMP '2024-01-20'"), "k", "value", effect=2.0)


@query("""
WITH r AS (SELECT source AS k, CASE WHEN doc_id % 3 = 0 THEN 'NATIVE' WHEN doc_id % 7 = 0 THEN 'BOOTSTRAP' ELSE 'TRANSLATED' END AS st, lang AS locale, n_chars > 2000 AS q, doc_id % 5 = 0 AS sw, doc_id % 41 = 0 AS str, doc_id % 3 AS com FROM documents),
l AS (SELECT k, locale FROM (SELECT k, locale, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, locale) = 1),
g AS (SELECT k, count(*) FILTER (st = 'NATIVE') AS native, count(*) FILTER (st = 'NATIVE' AND q) AS native_quality, max(st = 'BOOTSTRAP') AS bootstrap, max(str) AS structured, avg(CAST(sw AS INT)) AS s, count(DISTINCT com) AS communities FROM r GROUP BY 1),
h AS (SELECT *, CASE WHEN native > 0 THEN 'NATIVE' WHEN bootstrap THEN 'BOOTSTRAP' ELSE 'TRANSLATED' END AS status, 0.2 + CASE WHEN structured THEN 0.3 ELSE 0 END + CASE WHEN native >= 1 THEN 0.2 ELSE 0 END + least(0.3, 0.1 * native_quality) + least(0.1, 0.05 * communities) AS c FROM g)
SELECT k AS source, native, native_quality, bootstrap, structured, communities, status, s > 0.3 AS code_switched, (native >= 1 AND (native_quality >= 2 OR structured)) OR bootstrap AS eligible,
  round(CAST(least(0.95, CASE WHEN native_quality <= 1 AND NOT structured AND status <> 'BOOTSTRAP' THEN least(0.45, c) ELSE c END) AS DOUBLE), 9) AS confidence, l.locale AS dominant_locale FROM h JOIN l USING (k)""")
def q64g_native_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", F.when(i % 3 == 0, "NATIVE").when(i % 7 == 0, "BOOTSTRAP").otherwise("TRANSLATED").alias("status"), F.col("lang").alias("locale"), (F.col("n_chars") > 2000).alias("quality"), (i % 5 == 0).alias("switched"), (i % 41 == 0).alias("structured"), (i % 3).alias("community"))
    return A.native_projection(rows, "source")


@query("""SELECT source, n, unique_yield, confirm_rate, uncertainty, cost, days_since, round((unique_yield + confirm_rate + uncertainty + least(1.0, days_since / 90.0)) / greatest(1.0, cost), 9) AS score, n >= 30 AND unique_yield < 0.05 AND uncertainty < 0.1 AS saturated FROM (
SELECT source, count(*) AS n, round(count(DISTINCT text) / CAST(count(*) AS DOUBLE), 9) AS unique_yield, round(count(*) FILTER (lang = 'en') / CAST(count(*) AS DOUBLE), 9) AS confirm_rate, round(1 / sqrt(1 + count(*)), 9) AS uncertainty, round(avg(n_chars) / 1000, 9) AS cost, CAST(max(doc_id) % 120 AS DOUBLE) AS days_since FROM documents GROUP BY 1)""")
def q64h_coverage_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    g = table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("n"), F.round(F.countDistinct("text") / n, 9).alias("unique_yield"), F.round(A.n_if("lang = 'en'") / n, 9).alias("confirm_rate"), F.round(1 / F.sqrt(1 + n), 9).alias("uncertainty"), F.round(F.avg("n_chars") / 1000, 9).alias("cost"), (F.max("doc_id") % 120).cast("double").alias("days_since"))
    return A.coverage_opportunity(g)
