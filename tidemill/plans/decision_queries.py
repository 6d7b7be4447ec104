"""Queries of decisions, evaluation, experiments and allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, numbers
from ..operators import allocation as L
from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators import lifecycle as D
from ..sources.tables import table
from .analytics_queries import EVIDENCE, JR, OBSERVED, PAGES, RUNS_OF, _observed, _pages
from .bindings import ACTIONS, CREATORS, EXAMPLES, FIRSTS, HEX8, SIGHTINGS, actions, creators, examples, sightings, sql
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col

TREND = """trends AS (SELECT neighborhood, count(*) AS n, arg_min(relevant_new, run_id) AS earliest, arg_max(relevant_new, run_id) AS latest, arg_max(overlap, run_id) AS latest_overlap, sum(relevant_new) AS total_yield, avg(relevant_new) AS avg_relevant, avg(quality_new) AS avg_quality, avg(known_ratio) AS avg_known, avg(coalesce(overlap, 0)) AS avg_overlap FROM observed GROUP BY 1
), flagged AS (SELECT *, coalesce(n >= 3 AND latest < 0.5 * earliest AND latest < 0.15 AND latest_overlap > 0.7, false) AS saturating FROM trends)"""


@query(sql(SIGHTINGS, FIRSTS, RUNS_OF, OBSERVED, TREND, query="""
SELECT neighborhood, n, saturating, CASE WHEN n = 0 THEN 'UNEXPLORED' WHEN n < 3 THEN 'PROBING' WHEN avg_relevant = 0 AND avg_quality = 0 AND avg_known < 0.1 AND avg_overlap > 0.8 THEN 'HARMFUL'
  WHEN saturating OR (avg_overlap >= 0.75 AND avg_relevant < 0.05) THEN CASE WHEN total_yield > 0 THEN 'MAINTENANCE' WHEN avg_overlap >= 0.85 AND avg_relevant < 0.02 THEN 'SATURATED' ELSE 'SATURATING' END
  WHEN avg_relevant >= 0.15 OR avg_quality >= 0.1 OR 100 * avg_relevant >= 15 OR avg_quality * 10 >= 1 THEN 'PRODUCTIVE' ELSE 'PARTIALLY_OBSERVED' END AS state FROM flagged"""))
def q13_frontier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trend(_observed(spark, sf_dir)).withColumns({"rel": c("avg_relevant"), "qual": c("avg_quality"), "known": c("avg_known"), "overlap": c("avg_overlap"), "mv": 100 * c("avg_relevant"), "efficiency": F.when(c("saturating"), 0.0).otherwise(10 * c("avg_quality"))})
    t = t.withColumn("efficiency", F.when((c("overlap") >= 0.75) & (c("rel") < 0.05), 0.0).otherwise(c("efficiency")))
    return t.select("neighborhood", "n", "saturating", D.frontier_state().alias("state"))


@query(sql(SIGHTINGS, FIRSTS, query="""SELECT run_id, CASE WHEN d = 0 THEN 'NOISY' WHEN rel > 0 AND qual > 0 THEN 'PRODUCTIVE' WHEN rel > 0 OR cov >= 0.2 THEN 'PROMISING' WHEN run_id % 10 / 10.0 >= 0.8 THEN 'SATURATED' WHEN d >= 100 AND rel = 0 AND known < 0.1 THEN 'HARMFUL' ELSE 'UNCERTAIN' END AS outcome FROM (
SELECT run_id, count(*) AS d, count(*) FILTER (outcome = 'CONFIRMED' AND NOT was_known) AS rel, count(*) FILTER (outcome = 'CONFIRMED' AND quality >= 90 AND NOT was_known) AS qual, count(*) FILTER (NOT was_known) / CAST(count(*) AS DOUBLE) AS cov, count(*) FILTER (was_known) / CAST(count(*) AS DOUBLE) AS known FROM firsts GROUP BY 1)"""))
def q13b_trial_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bindings import observations

    n = F.count("*")
    g = observations(spark, sf_dir).groupBy("run_id").agg(n.alias("distinct"), A.n_if("outcome = 'CONFIRMED' AND NOT was_known").alias("rel"), A.n_if("outcome = 'CONFIRMED' AND quality >= 90 AND NOT was_known").alias("qual"), (A.n_if("NOT was_known") / n).alias("cov"), (A.n_if("was_known") / n).alias("known"), n.alias("quota"))
    g = g.withColumns({"overlap_before": F.lit(0.0), "overlap_after": c("run_id") % 10 / 10.0})
    return g.select("run_id", D.trial_outcome().alias("outcome"))


EVID = """ev AS (SELECT source AS k, CASE WHEN doc_id % 4 = 3 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity, doc_id % 3 AS category_order, 'C' || (doc_id % 3) AS category, 1 + doc_id % 5 AS matches, lang AS source, least(10 + doc_id % 4 * 5, (1 + doc_id % 5) * 3.0) * 0.9 * 0.85 AS weight FROM documents),
asm AS (SELECT k, round(coalesce(sum(weight) FILTER (polarity = 'POSITIVE'), 0), 9) AS positive, round(coalesce(sum(weight) FILTER (polarity = 'NEGATIVE'), 0), 9) AS negative, count(DISTINCT source) AS sources, count(*) AS items FROM ev GROUP BY 1),
pts AS (SELECT k, category FROM (SELECT k, category, sum(2 * matches) AS p, min(category_order) AS o FROM ev WHERE polarity = 'POSITIVE' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY p DESC, o) = 1),
st AS (SELECT asm.*, category AS primary_category, CASE WHEN negative >= 25 AND (positive = 0 OR negative > 1.5 * positive) THEN 'FAIL' WHEN negative >= 25 THEN 'MIXED' ELSE 'PASS' END AS contradiction FROM asm LEFT JOIN pts USING (k)),
lf AS (SELECT *, CASE WHEN contradiction = 'FAIL' THEN 'REJECT' WHEN positive > 0 AND sources >= 2 AND contradiction = 'PASS' THEN 'CONFIRM' ELSE 'UNCERTAIN' END AS lifecycle, greatest(0, least(100, 50 + positive - negative)) AS raw FROM st),
pr AS (SELECT *, floor(CASE WHEN raw < 25 THEN 0.8 * raw WHEN raw < 50 THEN 20 + 0.9 * (raw - 25) WHEN raw < 65 THEN 43 + 0.8 * (raw - 50) WHEN raw < 80 THEN 55 + 1.4 * (raw - 65) ELSE least(96, 76 + raw - 80) END + 0.5) AS prob, lifecycle = 'CONFIRM' AND positive >= 15 AND raw >= 65 AS ok, lifecycle = 'REJECT' AND negative >= 25 AND (positive = 0 OR negative > 1.5 * positive) AS no FROM lf)"""


@query(sql(EVID, query="""SELECT k AS source, positive, negative, sources, items, primary_category, contradiction, lifecycle, round(raw, 9) AS raw, CASE WHEN ok THEN 'CONFIRMED' WHEN no THEN 'REJECTED' ELSE 'UNCERTAIN' END AS decision, CASE WHEN ok THEN greatest(82, prob) WHEN no THEN least(22, prob) ELSE greatest(23, least(79, prob)) END AS score FROM pr"""))
def q23_evidence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("doc_id")
    matches = 1 + i % 5
    weight = D.evidence_weight(matches, F.lit(3.0), (10 + i % 4 * 5).cast("double"), F.lit(0.9), F.lit(0.85))
    ev = table(spark, sf_dir, "documents").select(c("source").alias("k"), F.when(i % 4 == 3, "NEGATIVE").otherwise("POSITIVE").alias("polarity"), (i % 3).alias("category_order"), F.concat(F.lit("C"), (i % 3).cast("string")).alias("category"), matches.alias("matches"), c("lang").alias("source"), weight.alias("weight"))
    out = D.decision(D.staged(D.assemble(ev, "k")).withColumn("strong", F.lit(True)), numbers.calibrate_decision)
    return out.select(c("k").alias("source"), "positive", "negative", "sources", "items", "primary_category", "contradiction", "lifecycle", "raw", "decision", "score")


CNTRY = """ce AS (SELECT c_custkey AS k, n_name AS country, 1 + (c_custkey * 7 + s) % 5 AS priority, 40 + (c_custkey * 13 + s * 17) % 60 AS confidence FROM customer, (SELECT unnest(range(3)) AS s), nation WHERE n_nationkey = (c_nationkey + s * (c_custkey % 3)) % 25),
cp AS (SELECT *, min(priority) OVER (PARTITION BY k) AS p FROM ce), cb AS (SELECT k, country, priority, max(confidence) AS confidence FROM cp WHERE priority = p GROUP BY 1, 2, 3),
ct AS (SELECT *, max(confidence) OVER (PARTITION BY k) AS top FROM cb), cn AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ct WHERE confidence = top), co AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY k ORDER BY country) = 1)"""


@query(sql(CNTRY, query="""SELECT k, country, priority, CASE WHEN country IN ('NATION_4') AND n = 1 THEN 'REJECTED' WHEN n > 1 THEN 'UNCERTAIN' WHEN confidence >= 85 THEN 'CONFIRMED' WHEN confidence >= 60 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS status, CASE WHEN country IN ('NATION_4') AND n = 1 THEN 100 WHEN n > 1 THEN least(49, confidence) ELSE confidence END AS confidence, n > 1 AS conflict FROM co"""))
def q26_country_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("nk"), c("n_name").alias("country"))
    ev = cu.withColumn("nk", (c("c_nationkey") + c("s") * (c("k") % 3)) % 25).join(F.broadcast(n), "nk")
    ev = ev.withColumns({"priority": 1 + (c("k") * 7 + c("s")) % 5, "confidence": 40 + (c("k") * 13 + c("s") * 17) % 60})
    return D.country(ev, "k", ["NATION_4"])


PCT = lambda a, b: f"CASE WHEN {b} = 0 THEN 100.0 ELSE floor(100.0 * {a} / ({b}) * 100 + 0.5) / 100 END"
DIMS = "dims AS (SELECT 'all' AS dimension, 'ALL' AS value, * FROM examples UNION ALL SELECT 'segment', segment, * FROM examples)"


@query(sql(EXAMPLES, DIMS, "g AS (SELECT dimension, value, count(*) FILTER (predicted = 'POSITIVE' AND truth) AS tp, count(*) FILTER (predicted = 'POSITIVE' AND NOT truth) AS fp, count(*) FILTER (predicted = 'NEGATIVE' AND NOT truth) AS tn, count(*) FILTER (predicted = 'NEGATIVE' AND truth) AS fn, count(*) FILTER (predicted = 'UNCERTAIN') AS abstained FROM dims GROUP BY 1, 2)",
    f"p AS (SELECT *, {PCT('tp', 'tp + fp')} AS precision, {PCT('tp', 'tp + fn')} AS recall FROM g)", query="SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE floor(2 * precision * recall / (precision + recall) * 100 + 0.5) / 100 END AS f1 FROM p"))
def q27_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(examples(spark, sf_dir), ["segment"])


@query(sql(EXAMPLES, query="SELECT b AS bin, coalesce(n, 0) AS n, coalesce(confidence, 0) AS confidence, coalesce(accuracy, 0) AS accuracy FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT CAST(least(9, floor(score * 10)) AS BIGINT) AS b, count(*) AS n, round(avg(score), 9) AS confidence, round(avg(CAST(truth AS INT)), 9) AS accuracy FROM examples GROUP BY 1) USING (b)"))
def q28_reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reliability_curve(examples(spark, sf_dir))


WEIGHTED = """wd AS (SELECT *, 10000.0 / inclusion_bp AS w, CAST(truth AS INT) AS y, least(9, floor(score * 10)) AS bin FROM dims),
wg AS (SELECT dimension, value, count(*) AS n, sum(w) AS weight, sum(w * w) AS w2, coalesce(sum(w) FILTER (predicted = 'POSITIVE' AND truth), 0) AS tp, coalesce(sum(w) FILTER (predicted = 'POSITIVE' AND NOT truth), 0) AS fp, coalesce(sum(w) FILTER (predicted = 'NEGATIVE' AND truth), 0) AS fn, coalesce(sum(w) FILTER (predicted = 'NEGATIVE' AND NOT truth), 0) AS tn,
  coalesce(sum(w) FILTER (predicted = 'UNCERTAIN'), 0) AS abstain, sum(w * (score - y) ** 2) AS brier, sum(w) FILTER (predicted = 'POSITIVE') AS pw, sum(w * w) FILTER (predicted = 'POSITIVE') AS pw2 FROM wd GROUP BY 1, 2),
wb AS (SELECT dimension, value, sum(abs(bp - bo)) AS gap FROM (SELECT dimension, value, bin, sum(w * score) AS bp, sum(w * y) AS bo FROM wd GROUP BY 1, 2, 3) GROUP BY 1, 2),
wp AS (SELECT *, weight * weight / w2 AS ess, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN pw2 > 0 THEN pw * pw / pw2 END AS pn, 3.8416 AS zz FROM wg JOIN wb USING (dimension, value))"""


@query(sql(EXAMPLES, DIMS, WEIGHTED, query="""SELECT dimension, value, n, round(ess, 6) AS effective_n, round(weight, 6) AS weight, round(p, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate, round(abstain / weight, 6) AS abstention_rate, round(brier / weight, 6) AS brier, round(gap / greatest(weight, 1), 6) AS calibration_error,
round(greatest(0, (p + zz / (2 * pn)) / (1 + zz / pn) - 1.96 * sqrt((p * (1 - p) + zz / (4 * pn)) / pn) / (1 + zz / pn)), 6) AS precision_lower, round(least(1, (p + zz / (2 * pn)) / (1 + zz / pn) + 1.96 * sqrt((p * (1 - p) + zz / (4 * pn)) / pn) / (1 + zz / pn)), 6) AS precision_upper, ess < 30 AS insufficient FROM wp"""))
def q29_weighted_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weighted_metrics(examples(spark, sf_dir), ["segment"])


METRICS = CATALOGUE.sql["q29_weighted_benchmark"]
BETTER = METRICS.replace(DIMS, "better AS (SELECT * REPLACE (CASE WHEN truth THEN 'POSITIVE' ELSE predicted END AS predicted) FROM examples), " + DIMS.replace("FROM examples", "FROM better"))


@query(f"""WITH old AS ({METRICS}), new AS ({BETTER}), x AS (SELECT n.effective_n < 30 AS few, (SELECT coalesce(bool_or(effective_n < 30), false) FROM new WHERE dimension <> 'all') AS short, coalesce(n.precision_lower, 0) < 0.7 AS weak, coalesce(o.recall, 0) - coalesce(n.recall, 0) > 0.05 AS lost, n.abstention_rate - o.abstention_rate > 0.05 AS shy, n.brier - o.brier > 0.02 AS off
FROM new n, old o WHERE n.dimension = 'all' AND o.dimension = 'all'), y AS (SELECT few OR short AS thin, concat_ws(',', CASE WHEN few THEN 'INSUFFICIENT_EFFECTIVE_SAMPLE_SIZE' END, CASE WHEN weak THEN 'PRECISION_LOWER_BOUND' END, CASE WHEN lost THEN 'RECALL_REGRESSION' END, CASE WHEN shy THEN 'ABSTENTION_REGRESSION' END, CASE WHEN off THEN 'CALIBRATION_REGRESSION' END, CASE WHEN short THEN 'SEGMENT_INSUFFICIENT' END) AS reasons FROM x)
SELECT CASE WHEN thin THEN 'INSUFFICIENT_EVIDENCE' WHEN reasons <> '' THEN 'REJECT' ELSE 'PROMOTE' END AS decision, reasons FROM y""")
def q29b_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    better = rows.withColumn("predicted", F.when(c("truth"), "POSITIVE").otherwise(c("predicted")))
    return E.promotion_gate(E.weighted_metrics(rows, ["segment"]), E.weighted_metrics(better, ["segment"]))


@query()
def q30_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    return E.apply_isotonic(rows.select("key", "score"), E.isotonic(rows))


@query(sql(f"b AS (SELECT c_custkey, {HEX8.format(chr(39) + 'salt|policy|3|' + chr(39) + ' || c_custkey')} % 10000 AS bucket FROM customer)", query="SELECT c_custkey, bucket, CASE WHEN bucket < 1000 THEN 'PROTECTED' WHEN bucket < 3500 THEN 'TARGETED' ELSE 'NOT_SELECTED' END AS cohort, CASE WHEN bucket < 3500 THEN 3500 ELSE 6500 END AS inclusion_bp FROM b"))
def q31_cohort_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = L.cohort("salt", "policy", 3, "c_custkey", 1000, 2500)
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a")).select("c_custkey", "a.*")


@query("SELECT c_custkey, CASE WHEN u < 0.5 THEN 'control' WHEN u < 0.8 THEN 'wide' ELSE 'deep' END AS arm, round(u, 9) AS u FROM (SELECT c_custkey, CAST('0x' || substr(sha256('trial|' || c_custkey), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM customer)")
def q32_arm_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("trial|"), c("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.weighted_arm(key, [("control", 5), ("wide", 3), ("deep", 2)]).alias("arm"), F.round(hashing.unit(key), 9).alias("u"))


@query(f"SELECT c_custkey, CASE WHEN {HEX8.format(chr(39) + 'canary|' + chr(39) + ' || c_custkey')} % 10000 < 9000 THEN 'CONTROL' ELSE 'TREATMENT' END AS arm, round({HEX8.format(chr(39) + 'x|' + chr(39) + ' || c_custkey')} / 4294967295.0, 9) AS explore FROM customer")
def q32b_canary_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p: F.concat(F.lit(p), c("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.experiment_arm(key("canary|"), 9000).alias("arm"), F.round(hashing.closed_unit(key("x|")), 9).alias("explore"))


@query("""SELECT user_id, n, final, round(m, 9) AS mean, round(se, 9) AS se, round(m - 1.96 * se, 9) AS lower, round(m + 1.96 * se, 9) AS upper, CASE WHEN user_id % 50 = 0 THEN 'AUTO_STOP' WHEN n > 500 THEN 'AUTO_PAUSE' WHEN final < 20 THEN 'CONTINUE' WHEN m - 1.96 * se > 40 THEN 'GO' ELSE 'NO_GO' END AS decision FROM (
SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'view') AS final, coalesce(avg(value) FILTER (event_type <> 'view'), 0) AS m, CASE WHEN count(*) FILTER (event_type <> 'view') > 1 THEN sqrt(var_samp(value) FILTER (event_type <> 'view') / count(*) FILTER (event_type <> 'view')) ELSE 0 END AS se FROM events GROUP BY 1)""")
def q33_reward_ci_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", c("value").alias("reward"), (c("event_type") == "view").alias("provisional"))
    r = E.rewards(e, ["user_id"])
    return r.withColumn("decision", D.stop_decision(c("user_id") % 50 == 0, c("n") > 500, c("final"), 20, c("lower"), 40.0))


SAMPLES = """samples AS (SELECT event_id, event_id % 2 = 0 AS cand, event_type <> 'error' AS supported, event_id % 3 <> 0 AND event_type <> 'error' AS target_selected, 4000 + event_id % 5 * 1000 AS target_bp, 5000 AS behavior_bp, value AS reward, 1 + event_id % 3 AS provider_cost, event_id % 2 AS review_cost, event_id % 4 / 10.0 AS overlap, event_type AS segment FROM events),
ws AS (SELECT *, target_bp / CAST(behavior_bp AS DOUBLE) AS w, reward * (1 - overlap) / greatest(1, provider_cost + review_cost) AS v FROM samples WHERE supported AND target_selected),
pol AS (SELECT cand, sum(w * v) / sum(w) AS m, sum(w) ** 2 / sum(w * w) AS ess, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 AS var FROM ws GROUP BY 1),
seg AS (SELECT segment, cand, count(*) AS n, sum(w * v) / sum(w) AS m FROM ws GROUP BY 1, 2), segs AS (SELECT count(*) AS segments, count(*) FILTER (NOT coalesce(a.n >= 5 AND b.n >= 5 AND a.m >= 0.8 * b.m, false)) AS failed_segments FROM (SELECT * FROM seg WHERE cand) a FULL JOIN (SELECT * FROM seg WHERE NOT cand) b USING (segment)),
res AS (SELECT a.m AS cm, b.m AS bm, a.ess AS ce, b.ess AS be, a.m - 1.96 * sqrt(greatest(0, a.var) / greatest(1, a.ess)) AS lo, b.m + 1.96 * sqrt(greatest(0, b.var) / greatest(1, b.ess)) AS hi FROM pol a, pol b WHERE a.cand AND NOT b.cand)"""


@query(sql(SAMPLES, query="SELECT round(cm, 6) AS candidate_mean, round(bm, 6) AS baseline_mean, round(ce, 6) AS candidate_ess, round(be, 6) AS baseline_ess, round(lo, 6) AS candidate_lower, round(hi, 6) AS baseline_upper, 0 AS unsupported, segments, failed_segments, CASE WHEN ce < 30 OR be < 30 THEN 'ABSTAIN' WHEN lo > hi AND failed_segments = 0 THEN 'PASS' ELSE 'FAIL' END AS decision FROM res, segs"))
def q34_snips_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("event_id")
    ok = c("event_type") != "error"
    s = table(spark, sf_dir, "events").select(i, ok.alias("supported"), ((i % 3 != 0) & ok).alias("target_selected"), (4000 + i % 5 * 1000).alias("target_bp"), F.lit(5000).alias("behavior_bp"), c("value").alias("reward"), (1 + i % 3).alias("provider_cost"), (i % 2).alias("review_cost"), (i % 4 / 10.0).alias("overlap"), c("event_type").alias("segment"))
    return E.counterfactual(s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1"), "segment")


GUARD = """gr AS (SELECT run_id, max(ts) AS ts, count(*) AS n, count(*) FILTER (outcome <> 'COUNTRY_REJECTED') AS in_country, count(*) FILTER (outcome IN ('CONFIRMED', 'NEEDS_REVIEW')) AS trading, count(*) FILTER (outcome = 'CONFIRMED') AS verified, count(*) FILTER (NOT was_known) AS active, count(*) FILTER (outcome = 'NEEDS_REVIEW') AS review, count(*) FILTER (was_known) AS inactive FROM sightings GROUP BY 1),
gm AS (SELECT run_id, ts, n, m.metric, m.x, m.t, m.low FROM gr, LATERAL (SELECT * FROM (VALUES ('country_precision', in_country, 0.7, true), ('trading_precision', trading, 0.7, true), ('verified_yield', verified, 0.05, true), ('active_yield', active, 0.02, true), ('review_burden', review, 0.5, false), ('inactive_share', inactive, 0.5, false)) v(metric, x, t, low)) m),
gw AS (SELECT *, x / CAST(n AS DOUBLE) AS p, 3.8416 AS zz FROM gm),
gi AS (SELECT *, greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) AS lower, least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) AS upper FROM gw)"""


@query(sql(SIGHTINGS, GUARD, query="SELECT run_id, metric, x AS numerator, n AS denominator, round(lower, 9) AS lower, round(upper, 9) AS upper, CASE WHEN n < 30 OR (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600e6 > 480 THEN 'ABSTAIN' WHEN CASE WHEN low THEN lower >= t ELSE upper <= t END THEN 'PASS' ELSE 'FAIL' END AS status FROM gi"))
def q35_guardrails_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.guardrails(_guard_rows(spark, sf_dir), ["run_id"], _guard_age(), stale_hours=480.0)


def _guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.n_if
    return sightings(spark, sf_dir).groupBy("run_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n"), n("outcome <> 'COUNTRY_REJECTED'").alias("in_country"), n("outcome IN ('CONFIRMED', 'NEEDS_REVIEW')").alias("trading"), n("outcome = 'CONFIRMED'").alias("verified"), n("NOT was_known").alias("active"), n("outcome = 'NEEDS_REVIEW'").alias("review"), n("was_known").alias("inactive"))


def _guard_age():
    return (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("ts")) / 3600e6


@query(sql(SIGHTINGS, GUARD, query="SELECT run_id, CASE max(r) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'ABSTAIN' ELSE 'PASS' END AS readiness FROM (SELECT run_id, CASE WHEN n < 30 OR (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600e6 > 480 THEN 1 WHEN CASE WHEN low THEN lower >= t ELSE upper <= t END THEN 0 ELSE 2 END AS r FROM gi) GROUP BY run_id"))
def q35b_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.readiness(q35_guardrails_wilson(spark, sf_dir), ["run_id"])


@query(sql(SIGHTINGS, PAGES, EVIDENCE, query="SELECT neighborhood, config, round(s, 6) AS score FROM (SELECT *, CASE WHEN expected = 0 THEN CASE WHEN config = 'DATE' THEN 45 ELSE 50 END ELSE expected END + 20 * uncertainty AS s FROM evidence) QUALIFY row_number() OVER (PARTITION BY neighborhood ORDER BY round(s, 6) DESC, config) = 1"))
def q41_ucb_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.retrieval_evidence(_pages(spark, sf_dir), "2024-01-31").withColumn("ordinal", c("config"))
    return L.ucb_choice(ev, ["neighborhood"]).select("neighborhood", "config", "score")


CAND = """cand AS (SELECT neighborhood, 100 * avg(relevant_new) AS expected_value, 1 / sqrt(1 + count(*)) AS uncertainty, avg(new_ratio) AS coverage_gain, neighborhood % 2 = 0 AS has_proposal, avg(raw) AS quota, avg(coalesce(overlap, 0)) AS overlap, avg(known_ratio) AS known, neighborhood AS recent, CASE WHEN neighborhood = 3 THEN 'HARMFUL' WHEN neighborhood = 4 THEN 'PROBING' ELSE 'PRODUCTIVE' END AS state, 100.0 * neighborhood + 200 AS elapsed_minutes FROM observed GROUP BY neighborhood)"""
G01 = lambda x: f"greatest(0, least(1, {x}))"


@query(sql(SIGHTINGS, FIRSTS, RUNS_OF, OBSERVED, CAND, query=f"""SELECT neighborhood, state, floor(greatest(0, {G01('expected_value / 100')} * 0.25 + {G01('0.4 * uncertainty + 0.4 * coverage_gain + 0.2 * CAST(has_proposal AS INT)')} * 0.55 + 0.10 * CASE WHEN quota = 0 THEN 0.5 ELSE least(1, 10 * expected_value / quota) END - 0.10 * {G01('0.6 * overlap + 0.4 * known')} - 0.05 * {G01('0.2 * recent')}) * 10000 + 0.5) / 10000 AS score,
state IN ('UNEXPLORED', 'PROBING', 'UNKNOWN') OR uncertainty >= 0.5 AS exploration, concat_ws(',', CASE WHEN state = 'HARMFUL' THEN 'HARMFUL' END, CASE WHEN elapsed_minutes < 360 THEN 'COOLDOWN' END, CASE WHEN recent >= 5 THEN 'CONCENTRATION' END) AS blocked FROM cand"""))
def q42_frontier_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.coalesce("overlap", F.lit(0.0))
    n = c("neighborhood")
    g = _observed(spark, sf_dir).groupBy("neighborhood").agg((100 * F.avg("relevant_new")).alias("expected_value"), (1 / F.sqrt(1 + F.count("*"))).alias("uncertainty"), F.avg("new_ratio").alias("coverage_gain"), F.avg("raw").alias("quota"), F.avg(o).alias("overlap"), F.avg("known_ratio").alias("known"))
    g = g.withColumns({"has_proposal": n % 2 == 0, "recent": n, "state": F.when(n == 3, "HARMFUL").when(n == 4, "PROBING").otherwise("PRODUCTIVE"), "elapsed_minutes": 100.0 * n + 200})
    return L.frontier_scores(g, floor_active=True).select("neighborhood", "state", "score", "exploration", F.array_join(D.eligibility(), ",").alias("blocked"))


@query("""WITH g AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey AS k FROM customer)),
p AS (SELECT o_orderkey, k, o_custkey % 400 AS dedup, row_number() OVER (PARTITION BY k ORDER BY o_totalprice DESC, o_orderkey) AS depth, ((g - 7 % n) % n + n) % n AS turn FROM (SELECT o_orderkey, o_custkey, o_totalprice, c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey) JOIN g USING (k)),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dedup ORDER BY depth, turn) = 1) SELECT o_orderkey, k, dedup, depth, turn FROM o ORDER BY depth, turn LIMIT 60""")
def q43_fair_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    rows = o.select("o_orderkey", c("c_nationkey").alias("k"), (c("o_custkey") % 400).alias("dedup"), "o_totalprice")
    return L.fair_round_robin(rows, "k", [F.desc("o_totalprice"), F.asc("o_orderkey")], "dedup", 60, 7).select("o_orderkey", "k", "dedup", "depth", "turn")


PORTFOLIO = L.Portfolio(provider_budget=120, review_budget=60, cluster_cap=4, program_floors={"1-URGENT": 20, "5-LOW": 10}, action_caps={"P": 5}, search_floor=6, search_type="O", exploration_bp=1500)


@query()
def q44_best_first_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_first_portfolio(actions(spark, sf_dir), PORTFOLIO)


@query()
def q44b_contextual_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contextual_portfolio(actions(spark, sf_dir), c("expected_reward") / 1000 - c("provider_cost"), PORTFOLIO)


@query(sql(ACTIONS, query="""SELECT * FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY depth, program_id, action_type) AS n FROM (SELECT action_id, program_id, action_type, expected_reward, row_number() OVER (PARTITION BY program_id, action_type ORDER BY expected_reward DESC, action_id) AS depth FROM actions) WHERE depth <= 18),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS types, CAST([] AS VARCHAR[]) AS programs, false AS ok UNION ALL SELECT n, CASE WHEN ok THEN list_append(types, action_type) ELSE types END, CASE WHEN ok THEN list_append(programs, program_id) ELSE programs END, ok FROM (SELECT o.n, types, programs, action_type, program_id,
len(types) < 25 AND len(types) - len(list_filter(types, lambda t: t <> action_type)) < 12 AND len(programs) - len(list_filter(programs, lambda t: t <> program_id)) < 6 AS ok FROM r JOIN o ON o.n = r.n + 1))
SELECT action_id, program_id, action_type, expected_reward, CAST(len(types) AS BIGINT) AS place FROM r JOIN o USING (n) WHERE ok)"""))
def q44c_bounded_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).select("action_id", "program_id", "action_type", "expected_reward")
    return L.bounded_round_robin(a, "action_type", "program_id", [F.desc("expected_reward"), F.asc("action_id")], 12, 6, 25)


@query("""SELECT event_id, n, CASE WHEN n * 70 // 100 > (n - 1) * 70 // 100 THEN 'VIDEO' ELSE 'CHANNEL' END AS lane, CASE WHEN n * 70 // 100 > (n - 1) * 70 // 100 AND (n * 70 // 100) * 60 // 100 > (n * 70 // 100 - 1) * 60 // 100 THEN 'DATE' ELSE 'RELEVANCE' END AS ordering FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup')""")
def q44d_lane_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return L.lanes(e, [F.asc("ts"), F.asc("event_id")]).select("event_id", "n", "lane", "ordering")


@query(sql(ACTIONS, query="""WITH a AS (SELECT action_id, 'protected' AS lane FROM (SELECT * FROM actions WHERE action_type = 'P' ORDER BY priority DESC, action_id LIMIT 10)), b AS (SELECT action_id, 'operational' AS lane FROM (SELECT * FROM actions WHERE review_cost = 1 AND action_id NOT IN (SELECT action_id FROM a) ORDER BY priority DESC, action_id LIMIT 10)),
x AS (SELECT * FROM (SELECT * FROM actions WHERE provider_cost = 3 AND action_id NOT IN (SELECT action_id FROM a UNION ALL SELECT action_id FROM b)) QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY priority DESC, action_id) = 1) SELECT action_id AS item_id, lane FROM a UNION ALL SELECT action_id, lane FROM b UNION ALL SELECT action_id, 'active' FROM (SELECT * FROM x ORDER BY priority DESC, action_id LIMIT 10)""").replace("\nWITH a AS", ", a AS"))
def q44e_review_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).select(c("action_id").alias("item_id"), c("cluster_key").alias("cluster"), "priority", (c("action_type") == "P").alias("protected"), (c("review_cost") == 1).alias("operational"), (c("provider_cost") == 3).alias("active"))
    return L.review_lanes(a, {"protected": 10, "operational": 10, "active": 10})


@query("""SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) > 120 AS capped FROM events""")
def q54_rolling_24h_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a key has spent in the 24 hours before each event, against a cap."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.sum("value").over(w) > 120).alias("capped"))


CONT = """ct AS (SELECT neighborhood AS key, run_id AS page, count(*) AS n, count(DISTINCT creator_id) / CAST(count(*) AS DOUBLE) AS div, 1 - count(DISTINCT creator_id) / CAST(count(*) AS DOUBLE) AS dup, count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, count(*) FILTER (NOT was_known) AS new, count(*) FILTER (outcome = 'CONFIRMED' AND quality >= 55) / CAST(count(*) AS DOUBLE) AS qy, count(*) FILTER (has_community) / CAST(count(*) AS DOUBLE) AS cy, count(*) FILTER (NOT was_known) / CAST(count(*) AS DOUBLE) AS nov, count(*) FILTER (outcome <> 'COUNTRY_REJECTED') / CAST(count(*) AS DOUBLE) AS cp, count(*) FILTER (outcome = 'NON_TRADING') / CAST(count(*) AS DOUBLE) AS nt FROM sightings GROUP BY 1, 2),
cu AS (SELECT *, floor(greatest(0, least(1, 0.30 * qy + 0.25 * cy + 0.20 * nov + 0.15 * cp + 0.10 * div - 0.20 * dup - 0.20 * nt)) * 1e5 + 0.5) / 1e5 AS utility FROM ct),
cl AS (SELECT *, utility < 0.2 OR (confirmed = 0 AND new = 0) OR dup >= 0.8 OR cp < 0.5 AS low FROM cu), ci AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY page) AS island FROM cl),
cs AS (SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY page) AS streak FROM ci)"""


@query(sql(SIGHTINGS, CONT, query="SELECT key, page, utility, low, streak, CASE WHEN page % 9 = 8 THEN 'NO_NEXT_PAGE' WHEN page >= 100 THEN 'PAGE_CAP' WHEN n >= 200 THEN 'CREATOR_CAP' WHEN streak >= 2 THEN 'LOW_YIELD_STREAK' END AS stop FROM cs"))
def q55_streak_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d, k = F.count("*"), F.countDistinct("creator_id"), A.n_if
    g = sightings(spark, sf_dir).groupBy(c("neighborhood").alias("key"), c("run_id").alias("page")).agg(n.alias("n"), (d / n).alias("div"), (1 - d / n).alias("dup"), k("outcome = 'CONFIRMED'").alias("confirmed"), k("NOT was_known").alias("new"), (k("outcome = 'CONFIRMED' AND quality >= 55") / n).alias("qy"), (k("has_community") / n).alias("cy"), (k("NOT was_known") / n).alias("nov"), (k("outcome <> 'COUNTRY_REJECTED'") / n).alias("cp"), (k("outcome = 'NON_TRADING'") / n).alias("nt"))
    out = D.continuation(g)
    return out.select("key", "page", "utility", "low", "streak", D.should_stop(c("page") % 9 != 8, c("page"), 100, c("n"), 200, c("streak"), 2).alias("stop"))


LEDGER = """lg AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'ADMITTED' WHEN 'signup' THEN 'REVIEW' WHEN 'error' THEN 'WITHHELD' ELSE 'REVIEW' END AS result FROM events),
lp AS (SELECT *, row_number() OVER w AS expected_version, coalesce(lag(result) OVER w, 'OBSERVED') AS expected_prior FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(sql(LEDGER, query="""SELECT user_id, event_id, expected_version, expected_prior, result, CASE WHEN (expected_prior, result) IN (('OBSERVED', 'ADMITTED'), ('OBSERVED', 'REVIEW'), ('OBSERVED', 'WITHHELD'), ('REVIEW', 'ADMITTED'), ('REVIEW', 'WITHHELD'), ('ADMITTED', 'WITHHELD'), ('WITHHELD', 'REVIEW')) THEN '' ELSE 'INVALID_TRANSITION' END AS mismatch FROM lp"""))
def q61_admission_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(c("event_type") == "purchase", "ADMITTED").when(c("event_type") == "error", "WITHHELD").otherwise("REVIEW")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", r.alias("result"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("prior", F.coalesce(F.lag("result").over(w), F.lit("OBSERVED")))
    return D.replay(e, "user_id", "event_id", "prior", "result", D.ADMISSION, "OBSERVED").select("user_id", "event_id", "expected_version", "expected_prior", "result", "mismatch")


@query(sql(LEDGER, "st AS (SELECT user_id, arg_max(result, event_id) AS state, count(*) AS version FROM lg GROUP BY 1)", query="SELECT user_id, state AS replayed_state, version AS replayed_version, CASE WHEN user_id % 10 <> 0 THEN CASE WHEN user_id % 7 = 0 THEN 'ADMITTED' ELSE state END END AS stored_state, CASE WHEN user_id % 10 <> 0 THEN version END AS stored_version FROM st WHERE user_id % 10 = 0 OR (user_id % 7 = 0 AND state <> 'ADMITTED')"))
def q61b_projection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(c("event_type") == "purchase", "ADMITTED").when(c("event_type") == "error", "WITHHELD").otherwise("REVIEW")
    p = D.projection(table(spark, sf_dir, "events").withColumn("result", r), "user_id", "event_id", "result")
    stored = p.where("user_id % 10 <> 0").withColumn("state", F.when(c("user_id") % 7 == 0, "ADMITTED").otherwise(c("state")))
    return D.verify_projection(p, stored, "user_id")


@query("""WITH a AS (SELECT event_id % 3 AS action, event_id % 100 AS activity, event_type IN ('purchase', 'signup') AS resolved, event_type = 'purchase' AS accepted FROM events)
SELECT CAST(action AS VARCHAR) AS action, band, count(*) AS n, round(avg(CAST(resolved AS INT)), 9) AS resolved, round(avg(CAST(accepted AS INT)), 9) AS accepted, CASE WHEN min(count(*)) OVER () >= 20 THEN 'APPROVED' ELSE 'INSUFFICIENT' END AS status FROM (SELECT *, CASE WHEN activity >= 70 THEN 'HIGH' WHEN activity >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM a) GROUP BY 1, 2""")
def q61c_voi_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((c("event_id") % 3).cast("string").alias("action"), (c("event_id") % 100).alias("activity"), c("event_type").isin("purchase", "signup").alias("resolved"), (c("event_type") == "purchase").alias("accepted"))
    return E.voi_calibration(e)


PCAL = """pc AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 30) AS s FROM events GROUP BY 1), pw AS (SELECT *, s / CAST(n AS DOUBLE) AS p, 3.8416 AS zz FROM pc)"""


@query(sql(PCAL, query="SELECT event_type, n, s AS successes, floor(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) * 10000 + 0.5) AS lower_bp, floor(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)) * 10000 + 0.5) AS upper_bp, n >= 30 AS eligible FROM pw"))
def q61d_provider_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.provider_calibration(table(spark, sf_dir, "events").withColumn("success", c("value") < 30), ["event_type"])


@query("""WITH r AS (SELECT event_id // 500 AS id, round(avg(value), 2) AS precision, round(count(*) FILTER (event_type = 'view') * 100.0 / count(*), 2) AS recall, round(sum(value), 2) AS latency FROM events GROUP BY 1), e AS (SELECT arg_min(precision, id) AS p0, arg_max(precision, id) AS p1, arg_min(recall, id) AS r0, arg_max(recall, id) AS r1, arg_min(latency, id) AS l0, arg_max(latency, id) AS l1 FROM r)
SELECT 'precision' AS metric, p0 AS base, p1 AS now, round(p1 - p0, 6) AS delta, round(p1 - p0, 6) < -3 AS alert FROM e UNION ALL SELECT 'recall', r0, r1, round(r1 - r0, 6), round(r1 - r0, 6) < -3 FROM e UNION ALL SELECT 'latency', l0, l1, round(l1 - l0, 6), round(l1 - l0, 6) > 0.25 * l0 FROM e""")
def q61e_regression_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    runs = table(spark, sf_dir, "events").groupBy(F.floor(c("event_id") / 500).alias("id")).agg(F.round(F.avg("value"), 2).alias("precision"), F.round(A.n_if("event_type = 'view'") * 100.0 / n, 2).alias("recall"), F.round(F.sum("value"), 2).alias("latency"))
    return E.regression(runs, {"precision": -3.0, "recall": -3.0, "latency": 0.25}, "id")


@query("""SELECT user_id, final AS n, round(m, 9) AS mean_reward, v AS verified, round(greatest(0, (p + zz / (2 * final)) / (1 + zz / final) - 1.96 * sqrt((p * (1 - p) + zz / (4 * final)) / final) / (1 + zz / final)), 9) AS lower, round(least(1, (p + zz / (2 * final)) / (1 + zz / final) + 1.96 * sqrt((p * (1 - p) + zz / (4 * final)) / final) / (1 + zz / final)), 9) AS upper FROM (
SELECT user_id, count(*) AS final, avg(value) AS m, count(*) FILTER (event_type = 'purchase') AS v, count(*) FILTER (event_type = 'purchase') / CAST(count(*) AS DOUBLE) AS p, 3.8416 AS zz FROM events WHERE event_type <> 'error' GROUP BY 1)""")
def q61f_verified_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", c("value").alias("reward"), (c("event_type") == "purchase").alias("verified"), (c("event_type") == "error").alias("corrective"))
    return E.verified_rewards(e, ["user_id"])


@query("""WITH m AS (SELECT source, doc_id, lang FROM documents), n AS (SELECT source, lang, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT source, sum(n) AS votes FROM n GROUP BY 1)
SELECT source, lang, votes, round(n / CAST(votes AS DOUBLE), 9) AS share, round(n / CAST(votes AS DOUBLE) * (1 - 1 / CAST(1 + votes AS DOUBLE)), 9) AS confidence FROM n JOIN t USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def q61g_semantic_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unanimous_share(table(spark, sf_dir, "documents").select("source", "lang"), ["source"], "lang")


@query("""SELECT k, score, CASE WHEN score >= 75 THEN 'OWNED' WHEN score <= 0 THEN 'THIRD_PARTY' ELSE 'UNKNOWN' END AS ownership FROM (SELECT page_id % 60 AS k,
max(CASE page_id % 5 WHEN 0 THEN 90 WHEN 1 THEN 70 WHEN 2 THEN 65 WHEN 3 THEN 55 ELSE 40 END) + CASE WHEN count(DISTINCT CASE WHEN page_id % 5 = 2 THEN page_id END) >= 2 THEN 15 ELSE 0 END + CASE WHEN count(DISTINCT page_id % 5) >= 2 THEN 15 ELSE 0 END + max(CAST(page_id % 11 = 0 AS INT)) * 35 - max(CAST(page_id % 4 = 1 AS INT)) * 80 AS score FROM pages GROUP BY 1)""")
def q61h_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("page_id")
    s = F.when(i % 5 == 0, "ABOUT").when(i % 5 == 1, "CHANNEL_LINKS").when(i % 5 == 2, "VIDEO").when(i % 5 == 3, "SOCIAL").otherwise("WEBSITE")
    no = F.lit(False)
    rows = table(spark, sf_dir, "pages").select((i % 60).alias("k"), s.alias("surface"), no.alias("explicit"), i.alias("page"), (i % 4 == 1).alias("partner"), no.alias("canonical_domain"), (i % 11 == 0).alias("brand"), no.alias("social"))
    return D.ownership(rows, "k")


@query(sql(CREATORS, query="SELECT creator_id, least(100, greatest(0, least(35, 15 + CASE WHEN creator_id % 6 >= 4 THEN 20 WHEN creator_id % 6 >= 2 THEN 12 WHEN creator_id % 6 >= 1 THEN 5 ELSE 0 END - 10 * (creator_id % 2))) + CASE WHEN creator_id % 7 = 0 THEN 2 WHEN creator_id % 400 <= 30 THEN 25 WHEN creator_id % 400 <= 90 THEN 20 WHEN creator_id % 400 <= 365 THEN 12 ELSE 8 END + CASE WHEN creator_id % 3 = 0 THEN 25 WHEN creator_id % 3 = 1 THEN 15 ELSE 10 END + 12 + CASE WHEN status = 'CONFIRMED' THEN 3 ELSE 0 END) AS quality_score FROM creators"))
def q61i_creator_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("creator_id")
    q = D.creator_quality(i % 6, i % 2, F.when(i % 7 == 0, "DORMANT").otherwise("OTHER"), i % 400, F.when(i % 3 == 0, "ACTIVE").otherwise("NONE"), i % 3 == 1, c("status") == "CONFIRMED")
    return creators(spark, sf_dir).select("creator_id", q.alias("quality_score"))


@query(sql(SIGHTINGS, FIRSTS, query=f"SELECT run_id, {JR('avg(quality)', 1)} AS q FROM firsts GROUP BY run_id"))
def q61j_rounded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M05."""
    from .bindings import observations

    return observations(spark, sf_dir).groupBy("run_id").agg(numbers.js_round(F.avg("quality"), 1).alias("q"))
