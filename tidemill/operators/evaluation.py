"""Evaluation of decisions and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import Z, effective_size, js_round, ratio, wilson, wilson_proportion
from .lifecycle import gate, promotion, reasons
from .relational import by_dimension

c = F.col


def confusion(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """A35, A37. Confusion counts and percentages overall and by dimension; a share of nothing is 100.

    Needs truth (boolean) and predicted POSITIVE, NEGATIVE or UNCERTAIN.
    """
    cells = by_dimension(rows.withColumn("_all", F.lit("ALL")), ["_all", *dimensions])
    yes, no = c("predicted") == "POSITIVE", c("predicted") == "NEGATIVE"
    g = cells.groupBy(F.regexp_replace("dimension", "^_", "").alias("dimension"), "value").agg(F.count_if(yes & c("truth")).alias("tp"), F.count_if(yes & ~c("truth")).alias("fp"), F.count_if(no & ~c("truth")).alias("tn"), F.count_if(no & c("truth")).alias("fn"), F.count_if(~yes & ~no).alias("abstained"))
    pct = lambda a, b: F.when(b == 0, F.lit(100.0)).otherwise(js_round(100 * a / F.nullif(b, F.lit(0)), 2))
    out = g.withColumns({"precision": pct(c("tp"), c("tp") + c("fp")), "recall": pct(c("tp"), c("tp") + c("fn"))})
    both = c("precision") + c("recall")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(js_round(2 * c("precision") * c("recall") / both, 2)))


def reliability_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """A36. Mean score and share of positives in each of `bins` equal bins, empty ones too."""
    g = rows.groupBy(F.least(F.lit(bins - 1), F.floor(c("score") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("confidence"), F.round(F.avg(c("truth").cast("int")), 9).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(c("id").alias("bin"))
    return every.join(F.broadcast(g), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def weighted_metrics(rows: DataFrame, dimensions: list[str], least: float = 30.0) -> DataFrame:
    """A38, A39, A44. Propensity-weighted metrics overall and by dimension.

    Needs truth, predicted, score and inclusion_bp; an abstention counts as that and not as a miss.
    """
    cells = by_dimension(rows.withColumn("_all", F.lit("ALL")), ["_all", *dimensions])
    w = F.lit(10000.0) / c("inclusion_bp")
    cells = cells.withColumns({"w": w, "y": c("truth").cast("int"), "bin": F.least(F.lit(9), F.floor(c("score") * 10))})
    key = [F.regexp_replace("dimension", "^_", "").alias("dimension"), c("value")]
    yes, unsure = c("predicted") == "POSITIVE", c("predicted") == "UNCERTAIN"
    s = lambda cond: F.coalesce(F.sum(F.when(cond, c("w"))), F.lit(0.0))
    g = cells.groupBy(*key).agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.sum(c("w") * c("w")).alias("w2"), s(yes & c("truth")).alias("tp"), s(yes & ~c("truth")).alias("fp"), s(~yes & ~unsure & c("truth")).alias("fn"), s(~yes & ~unsure & ~c("truth")).alias("tn"), s(unsure).alias("abstain"), F.sum(c("w") * F.pow(c("score") - c("y"), F.lit(2))).alias("brier"), F.sum(F.when(yes, c("w"))).alias("pw"), F.sum(F.when(yes, c("w") * c("w"))).alias("pw2"))
    bins = cells.groupBy(*key, "bin").agg(F.sum("w").alias("bw"), F.sum(c("w") * c("score")).alias("bp"), F.sum(c("w") * c("y")).alias("bo"))
    ece = bins.groupBy("dimension", "value").agg(F.sum(F.abs(c("bp") - c("bo"))).alias("gap"))
    out = g.join(ece, ["dimension", "value"]).withColumn("ess", effective_size("weight", "w2"))
    precision = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp")))
    recall = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn")))
    out = out.withColumn("precision", precision).withColumn("_i", wilson_proportion("precision", effective_size(F.coalesce("pw", F.lit(0.0)), F.coalesce("pw2", F.lit(0.0)))))
    r = lambda x: F.round(x, 6)
    return out.select("dimension", "value", "n", r(c("ess")).alias("effective_n"), r(c("weight")).alias("weight"), r(precision).alias("precision"), r(recall).alias("recall"), r(ratio("fp", c("fp") + c("tn"))).alias("false_positive_rate"), r(ratio("abstain", "weight")).alias("abstention_rate"), r(ratio("brier", "weight")).alias("brier"), r(c("gap") / F.greatest(c("weight"), F.lit(1.0))).alias("calibration_error"), r(c("_i.lower")).alias("precision_lower"), r(c("_i.upper")).alias("precision_upper"), (c("ess") < least).alias("insufficient"))


def promotion_gate(baseline: DataFrame, candidate: DataFrame, *, least: float = 30.0, precision_lower: float = 0.7, recall_drop: float = 0.05, abstention_rise: float = 0.05, brier_rise: float = 0.02) -> DataFrame:
    """D12. The decision on a candidate, from weighted_metrics of both: one row."""
    b = baseline.where("dimension = 'all'").select(*[c(x).alias(f"b_{x}") for x in ("recall", "abstention_rate", "brier")])
    n = candidate.where("dimension = 'all'").crossJoin(F.broadcast(b))  # one row each
    segments = candidate.where("dimension <> 'all'").agg(F.coalesce(F.max(c("effective_n") < least), F.lit(False)).alias("_short"))
    n = n.crossJoin(F.broadcast(segments))
    few = c("effective_n") < least
    against = reasons((few, "INSUFFICIENT_EFFECTIVE_SAMPLE_SIZE"), (c("precision_lower").isNull() | (c("precision_lower") < precision_lower), "PRECISION_LOWER_BOUND"), (F.coalesce("b_recall", F.lit(0.0)) - F.coalesce("recall", F.lit(0.0)) > recall_drop, "RECALL_REGRESSION"), (c("abstention_rate") - c("b_abstention_rate") > abstention_rise, "ABSTENTION_REGRESSION"), (c("brier") - c("b_brier") > brier_rise, "CALIBRATION_REGRESSION"), (c("_short"), "SEGMENT_INSUFFICIENT"))
    return n.select(promotion(few | c("_short"), against).alias("decision"), F.array_join(against, ",").alias("reasons"))


def _pooled(blocks: list[list[float]], more) -> list[list[float]]:
    """Blocks (upper, weight, positive) in order, and more of them, with neighbours out of order pooled."""
    for block in more:
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] > blocks[-1][2] / blocks[-1][1]:
            high = blocks.pop()
            blocks[-1] = [high[0], blocks[-1][1] + high[1], blocks[-1][2] + high[2]]
    return blocks


def isotonic(rows: DataFrame) -> DataFrame:
    """M08. Blocks (upper, probability, weight) of weighted isotonic regression over scores.

    Weights and positives are summed by distinct score, then pooled within ranges of scores; only the blocks
    that are left of every range are pooled in one task, and their order decides nothing, since pooling is associative.
    """
    import pandas as pd

    w = F.lit(10000.0) / c("inclusion_bp")
    sums = rows.where("score IS NOT NULL").groupBy("score").agg(F.sum(w).alias("weight"), F.sum(F.when(c("truth"), w).otherwise(0.0)).alias("positive"))
    names = ["score", "weight", "positive"]

    def ranges(batches):
        blocks: list[list[float]] = []
        for pdf in batches:
            _pooled(blocks, pdf[names].itertuples(index=False))
        yield pd.DataFrame(blocks, columns=names).astype("float64")

    def whole(pdf):
        blocks = _pooled([], pdf.sort_values("score")[names].itertuples(index=False))
        return pd.DataFrame([(b[0], round(b[2] / b[1], 9), round(b[1], 6)) for b in blocks], columns=["upper", "probability", "weight"])

    parts = sums.repartitionByRange("score").sortWithinPartitions("score").mapInPandas(ranges, "score double, weight double, positive double")
    return parts.groupBy(F.lit(1).alias("one")).applyInPandas(whole, "upper double, probability double, weight double")


def apply_isotonic(rows: DataFrame, points: DataFrame, bins: int = 1024) -> DataFrame:
    """M08. Adds probability: that of the first block whose upper end is not below the score, the last beyond all; null for no score.

    Rows meet the blocks of their own of `bins` equal parts of the fitted scores, by an equality.
    """
    ends = points.agg(F.min("upper").alias("_first"), F.max("upper").alias("_last"))
    place = lambda x: F.when(c("_last") > c("_first"), F.floor((x - c("_first")) / (c("_last") - c("_first")) * bins)).otherwise(F.lit(0)).cast("long")
    low = F.lag("upper").over(Window.orderBy("upper"))  # blocks come from one task
    spans = points.withColumn("_low", low).crossJoin(F.broadcast(ends))
    spans = spans.select(F.coalesce("_low", F.lit(float("-inf"))).alias("_low"), "upper", "probability", F.explode(F.sequence(place(F.coalesce("_low", "upper")), place(c("upper")))).alias("_bin"))
    own = rows.crossJoin(F.broadcast(ends)).withColumn("_at", F.when(c("score").isNotNull(), F.greatest(c("_first"), F.least(c("_last"), c("score")))))
    own = own.withColumn("_bin", place(c("_at"))).drop("_first", "_last")
    hit = (own["_bin"] == spans["_bin"]) & (c("_at") > c("_low")) & (c("_at") <= c("upper"))
    return own.join(spans, hit, "left").select(*[own[x] for x in rows.columns], "probability")


def rewards(rows: DataFrame, key: list[str]) -> DataFrame:
    """A40. Count, final count, mean, standard error (0 for one) and interval of final rewards."""
    final = F.when(~c("provisional"), c("reward"))
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count(final).alias("final"), F.avg(final).alias("_m"), F.coalesce(F.var_samp(final), F.lit(0.0)).alias("_v"))
    se = F.when(c("final") > 1, F.sqrt(F.when(F.isnan("_v"), F.lit(0.0)).otherwise(c("_v")) / c("final"))).otherwise(F.lit(0.0))
    out = g.withColumn("mean", F.coalesce("_m", F.lit(0.0))).withColumn("se", se)
    return out.select(*key, "n", "final", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"), F.round(c("mean") - Z * c("se"), 9).alias("lower"), F.round(c("mean") + Z * c("se"), 9).alias("upper"))


def cached_candidates(rows: DataFrame, covered: DataFrame, key: list[str], *, least: int = 30, precision: float = 0.5, quality: float = 0.1, coverage: int = 1, quota: float = 10.0, review: float = 5.0) -> DataFrame:
    """A41, U04. Guardrails of candidates from cached observations; new coverage is what they cover and covered lacks."""
    g = rows.groupBy(*key).agg(F.sum("results").alias("results"), F.sum("relevant").alias("relevant"), F.sum("verified").alias("verified"), F.sum("quota_cost").alias("quota"), F.sum("review_cost").alias("review"))
    cells = rows.select(*key, F.explode("coverage_keys").alias("cell")).distinct().join(covered.select("cell").distinct(), "cell", "left_anti").groupBy(*key).agg(F.count("*").alias("new_coverage"))
    out = g.join(cells, key, "left").withColumn("new_coverage", F.coalesce("new_coverage", F.lit(0)))
    p = ratio("relevant", "results")
    radius = Z * F.sqrt(p * (1 - p) / F.greatest(F.lit(1), c("results")))
    why = gate((p - radius < precision, "PRECISION"), (ratio("verified", "results") < quality, "QUALITY"), (c("new_coverage") < coverage, "COVERAGE"), (ratio("quota", "verified") > quota, "QUOTA"), (c("review") > review * c("results"), "REVIEW"))
    out = out.withColumns({"precision": F.round(p, 9), "radius": F.round(radius, 9), "_g": why})
    return out.withColumn("decision", F.when(c("results") < least, "INSUFFICIENT").when(c("_g.passed"), "PASS").otherwise("FAIL")).withColumn("reasons", c("_g.reasons")).drop("_g")


def _policy(rows: DataFrame, key: list[str]) -> DataFrame:
    w = F.when(c("target_selected"), c("target_bp")).otherwise(0) / c("behavior_bp")
    v = c("reward") * (1 - c("overlap")) / F.greatest(F.lit(1.0), (c("provider_cost") + c("review_cost")).cast("double"))
    own = rows.where(c("supported") & (c("behavior_bp") > 0)).withColumns({"w": w, "v": v}).where("w > 0")
    g = own.groupBy(*key).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(c("w") * c("w")).alias("sw2"), F.sum(c("w") * c("v")).alias("swv"), F.sum(c("w") * c("v") * c("v")).alias("swvv"))
    mean = c("swv") / c("sw")
    return g.withColumns({"mean": mean, "ess": effective_size("sw", "sw2"), "_var": F.greatest(F.lit(0.0), c("swvv") / c("sw") - mean * mean)}).withColumn("se", F.sqrt(c("_var") / F.greatest(F.lit(1.0), c("ess"))))


def counterfactual(candidate: DataFrame, baseline: DataFrame, segment: str, least: float = 30.0) -> DataFrame:
    """A42, L15. Self-normalised estimates of two policies from logged samples, and the decision: one row."""
    a = _policy(candidate, []).select(*[F.coalesce(c(x), F.lit(0.0)).alias(f"c_{x}") for x in ("mean", "ess", "se")])
    b = _policy(baseline, []).select(*[F.coalesce(c(x), F.lit(0.0)).alias(f"b_{x}") for x in ("mean", "ess", "se")])
    bad = candidate.unionByName(baseline).agg(F.count_if(c("target_selected") & ~c("supported")).alias("unsupported"))
    x, y = _policy(candidate, [segment]), _policy(baseline, [segment])
    seg = x.select(segment, c("n").alias("cn"), c("mean").alias("cm")).join(y.select(segment, c("n").alias("bn"), c("mean").alias("bm")), segment, "full_outer")
    ok = F.coalesce((c("cn") >= 5) & (c("bn") >= 5) & (c("cm") >= 0.8 * c("bm")), F.lit(False))
    segs = seg.agg(F.count("*").alias("segments"), F.count_if(~ok).alias("failed_segments"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(bad)).crossJoin(F.broadcast(segs))  # one row each
    lower, upper = c("c_mean") - Z * c("c_se"), c("b_mean") + Z * c("b_se")
    abstain = (c("unsupported") > 0) | (c("c_ess") < least) | (c("b_ess") < least) | (c("segments") == 0)
    r = lambda v: F.round(v, 6)
    return one.select(r(c("c_mean")).alias("candidate_mean"), r(c("b_mean")).alias("baseline_mean"), r(c("c_ess")).alias("candidate_ess"), r(c("b_ess")).alias("baseline_ess"), r(lower).alias("candidate_lower"), r(upper).alias("baseline_upper"), "unsupported", "segments", "failed_segments", F.when(abstain, "ABSTAIN").when((lower > upper) & (c("failed_segments") == 0), "PASS").otherwise("FAIL").alias("decision"))


#: Guardrails (metric, numerator, denominator, threshold, whether it is a minimum).
GUARDRAILS = (("country_precision", "in_country", "n", 0.7, True), ("trading_precision", "trading", "n", 0.7, True), ("verified_yield", "verified", "n", 0.05, True), ("active_yield", "active", "n", 0.02, True), ("review_burden", "review", "n", 0.5, False), ("inactive_share", "inactive", "n", 0.5, False))


def guardrails(rows: DataFrame, key: list[str], age_hours: Column, least: int = 30, stale_hours: float = 48.0) -> DataFrame:
    """A43. Each guardrail's interval and status: the lower end must reach a minimum, the upper end stay below a maximum."""
    stacked = F.array(*[F.struct(F.lit(m).alias("metric"), c(num).cast("long").alias("numerator"), c(den).cast("long").alias("denominator"), F.lit(t).alias("threshold"), F.lit(low).alias("is_minimum")) for m, num, den, t, low in GUARDRAILS])
    out = rows.withColumn("_age", age_hours).select(*key, "_age", F.explode(stacked).alias("g")).select(*key, "_age", "g.*").withColumn("_w", wilson("numerator", "denominator"))
    good = F.when(c("is_minimum"), c("_w.lower") >= c("threshold")).otherwise(c("_w.upper") <= c("threshold"))
    status = F.when((c("denominator") < least) | (c("_age") > stale_hours), "ABSTAIN").when(good, "PASS").otherwise("FAIL")
    return out.select(*key, "metric", "numerator", "denominator", F.round("_w.lower", 9).alias("lower"), F.round("_w.upper", 9).alias("upper"), status.alias("status"))


def verified_rewards(rows: DataFrame, key: list[str]) -> DataFrame:
    """A62, A63. Mean reward and verified precision of final outcomes, corrections left out."""
    own = rows.where("NOT corrective")
    g = own.groupBy(*key).agg(F.count("*").alias("n"), F.avg("reward").alias("_m"), F.count_if(c("verified")).alias("verified"))
    out = g.withColumn("_w", wilson("verified", "n"))
    return out.select(*key, "n", F.round("_m", 9).alias("mean_reward"), "verified", F.round("_w.lower", 9).alias("lower"), F.round("_w.upper", 9).alias("upper"))


def voi_calibration(rows: DataFrame, least: int = 20) -> DataFrame:
    """A64. Outcome rates by action and activity band, approved when every group is large enough."""
    band = F.when(c("activity") >= 70, "HIGH").when(c("activity") >= 35, "MEDIUM").otherwise("LOW")
    g = rows.withColumn("band", band).groupBy("action", "band").agg(F.count("*").alias("n"), *[F.round(F.avg(c(x).cast("int")), 9).alias(x) for x in ("resolved", "accepted")])
    few = g.agg(F.min("n").alias("_few"))
    return g.crossJoin(F.broadcast(few)).withColumn("status", F.when(c("_few") >= least, "APPROVED").otherwise("INSUFFICIENT")).drop("_few")


def provider_calibration(rows: DataFrame, key: list[str], least: int = 30) -> DataFrame:
    """A65. Success interval in whole basis points."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(c("success")).alias("successes")).withColumn("_w", wilson("successes", "n"))
    return g.select(*key, "n", "successes", js_round(c("_w.lower") * 10000).alias("lower_bp"), js_round(c("_w.upper") * 10000).alias("upper_bp"), (c("n") >= least).alias("eligible"))


def regression(runs: DataFrame, metrics: dict[str, float], order: str) -> DataFrame:
    """A59. The newest run against the oldest: each metric's change and whether it is an alert.

    metrics: the change that alerts, a drop if negative (points), a rise if positive (share of the base).
    """
    names = list(metrics)
    ends = runs.agg(*[x for m in names for x in (F.min_by(m, order).cast("double").alias(f"a_{m}"), F.max_by(m, order).cast("double").alias(f"z_{m}"))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c(f"a_{m}").alias("base"), c(f"z_{m}").alias("now"), F.lit(float(t)).alias("limit")) for m, t in metrics.items()])
    out = ends.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.round(c("now") - c("base"), 6))
    alert = F.when(c("limit") < 0, c("delta") < c("limit")).otherwise(c("delta") > c("limit") * c("base"))
    return out.withColumn("alert", alert).drop("limit")
