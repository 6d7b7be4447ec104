"""Result-set analytics: funnels, replay, segments, neighborhoods, overlap, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, clamp01, expected_value, js_round, observed_value, ratio, wilson
from ..functions.text import subscribers
from .relational import by_dimension, latest

n_if = lambda c: F.count_if(c if isinstance(c, Column) else F.expr(c))


def query_funnel(sightings: DataFrame, key: list[str]) -> DataFrame:
    """A01. Funnel of each key over the first sighting of each creator, with its score.

    Needs creator_id, rank, outcome, was_known, persisted, has_community and quality.
    """
    raw = sightings.groupBy(*key).agg(F.count("*").alias("raw_results"))
    first = latest(sightings, [*key, "creator_id"], [F.asc("rank")])
    counts = first.groupBy(*key).agg(
        F.count("*").alias("distinct_creators"),
        n_if("persisted AND NOT was_known").alias("new_creators"),
        n_if("outcome = 'CONFIRMED'").alias("confirmed"),
        n_if("outcome = 'NEEDS_REVIEW'").alias("needs_review"),
        n_if("outcome = 'UNCERTAIN'").alias("uncertain"),
        n_if("outcome = 'NON_TRADING'").alias("non_trading"),
        n_if("outcome = 'COUNTRY_REJECTED'").alias("country_rejected"),
        n_if("outcome = 'CONFIRMED' AND quality >= 55").alias("quality_creators"),
        n_if("has_community").alias("community_creators"),
        js_round(F.coalesce(F.avg(F.when(F.col("persisted"), F.col("quality"))), F.lit(0.0))).alias("avg_quality"),
    )
    out = counts.join(raw, key).withColumn("evaluated", F.col("non_trading") + F.col("uncertain") + F.col("needs_review") + F.col("confirmed"))
    out = out.withColumns({
        "duplicates": F.greatest(F.lit(0), F.col("raw_results") - F.col("distinct_creators")),
        "novelty": ratio("new_creators", "distinct_creators"),
        "country_precision": ratio(F.col("distinct_creators") - F.col("country_rejected"), "distinct_creators"),
        "trading_precision": ratio("confirmed", "evaluated"),
        "quality_yield": ratio("quality_creators", "evaluated"),
        "community_yield": ratio("community_creators", "evaluated"),
    })
    return out.withColumn("score", js_round(100 * (0.30 * F.col("trading_precision") + 0.25 * F.col("novelty") + 0.20 * F.col("quality_yield") + 0.15 * F.col("country_precision") + 0.10 * F.col("community_yield"))))


def severely_contaminated() -> Column:
    """P10. Of funnel columns: many creators, nearly all rejected, nothing of quality."""
    contamination = ratio(F.col("country_rejected") + F.col("non_trading"), "distinct_creators")
    return (F.col("distinct_creators") >= 8) & (contamination >= 0.8) & (F.col("trading_precision") <= 0.1) & (F.col("quality_creators") == 0)


def query_collection(current: Column, runs: Column) -> Column:
    """D07. The collection that a query's funnel puts it in."""
    return F.when(severely_contaminated(), "REJECTED").when(F.col("score") >= 60, "PROVEN").when((F.col("score") < 25) & (runs >= 2), "REJECTED").when(current == "REJECTED", "REJECTED").otherwise("EXPERIMENTAL")


def replay_funnel(events: DataFrame, dimensions: list[str], event_key: str, corrective: Column) -> DataFrame:
    """A05. Totals and one row for each value of each dimension, of distinct events; late corrections stay counted."""
    once = latest(events, [event_key], [F.asc("recorded_at")]).withColumn("_corrective", corrective)
    rows = by_dimension(once.withColumn("_all", F.lit("ALL")), ["_all", *dimensions])
    return rows.groupBy(F.regexp_replace("dimension", "^_", "").alias("dimension"), "value").agg(F.count("*").alias("events"), n_if("outcome = 'CONFIRMED'").alias("confirmed"), n_if("outcome = 'COUNTRY_REJECTED'").alias("rejected"), n_if("_corrective").alias("corrections"))


def reconcile(expected: DataFrame, actual: DataFrame, key: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """A06. (key, metric, expected, actual, delta, within): within tolerance * max(1, |expected|)."""
    a = expected.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", "expected")
    b = actual.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", "actual")
    out = a.join(b, [*key, "metric"], "full_outer")
    delta = F.coalesce("actual", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0))
    return out.withColumn("delta", delta).withColumn("within", F.abs("delta") <= tolerance * F.greatest(F.lit(1.0), F.abs(F.coalesce("expected", F.lit(0.0)))))


def totals(runs: DataFrame, columns: list[str]) -> DataFrame:
    """A07. Sums with nulls as 0."""
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def lane_performance(sightings: DataFrame, key: list[str]) -> DataFrame:
    """A02. Distinct creators by outcome of each lane."""
    of = lambda cond, name: F.countDistinct(F.when(F.expr(cond), F.col("creator_id"))).alias(name)
    return sightings.groupBy(*key).agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("creator_id").alias("creators"), of("outcome = 'CONFIRMED'", "confirmed"), of("NOT was_known", "new"), of("outcome = 'CONFIRMED' AND quality >= 55", "quality"))


def dashboard_summary(creators: DataFrame, events: DataFrame) -> DataFrame:
    """A03, A60. Counts by condition beside a scalar of another table."""
    c = creators.agg(F.count("*").alias("total"), n_if("status = 'CONFIRMED'").alias("confirmed"), n_if("status = 'REVIEW'").alias("in_review"), n_if("quality >= 55").alias("quality"))
    return c.crossJoin(F.broadcast(events.agg(F.count("*").alias("events"))))


def provider_metrics(calls: DataFrame, key: list[str]) -> DataFrame:
    """A04. Calls, successes, timeouts, errors, average latency and cost."""
    return calls.groupBy(*key).agg(F.count("*").alias("calls"), n_if("status = 'SUCCESS'").alias("successes"), n_if("status = 'TIMEOUT'").alias("timeouts"), n_if("status = 'ERROR'").alias("errors"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.round(F.sum("cost"), 6).alias("cost"))


def segment_health(runs: DataFrame, dimensions: list[str]) -> DataFrame:
    """A09, J12. Health of each value of each dimension.

    Needs creator counts of runs: valuable, new_creators, distinct_creators, quota, overlap, source.
    """
    rows = by_dimension(runs, dimensions)
    g = rows.groupBy("dimension", "value").agg(F.count("*").alias("runs"), F.sum("quota").alias("quota"), F.sum("valuable").alias("valuable"), F.sum("new_creators").alias("new_creators"), F.sum("distinct_creators").alias("distinct_creators"), F.countDistinct("source").alias("sources"), F.avg("overlap").alias("_overlap"), F.sum(js_round(F.col("quota") * F.greatest(F.lit(0.0), 1 - F.col("overlap")))).alias("_under"))
    n, q = F.greatest(F.lit(1), F.col("runs")), F.greatest(F.lit(1), F.col("quota"))
    out = g.withColumns({"yield_per_1000": js_round(1000 * F.col("valuable") / q, 2), "saturation": clamp01(js_round("_overlap", 2)), "underexplored_pct": F.least(F.lit(100.0), js_round(100 * F.col("_under") / q, 1)), "diversity": F.least(F.lit(1.0), js_round(F.col("sources") / n, 2))})
    return out.withColumns({"expansion": js_round(1 - F.col("saturation"), 2), "coverage_gap": (F.col("valuable") == 0) | (F.col("underexplored_pct") < 15) | (F.col("runs") < 3)}).drop("_overlap", "_under")


def run_overlap(observations: DataFrame, key: str = "neighborhood", history: int = 5) -> DataFrame:
    """U02, U03, W08. Jaccard of each run with the one before of its key, and the share of it that the last `history` runs had; null without history.

    By joins on creators: no run's set is gathered in one row.
    """
    runs = observations.select(key, "run_id").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("run_id")))
    own = observations.select(key, "run_id", "creator_id").distinct().join(runs, [key, "run_id"])
    size = own.groupBy(key, "run_id", "_i").agg(F.count("*").alias("n"))
    place = Window.partitionBy(key, "creator_id").orderBy("_i")
    seen = own.withColumn("_last", F.lag("_i").over(place))
    both = seen.groupBy(key, "run_id").agg(n_if(F.col("_last") == F.col("_i") - 1).alias("shared"), n_if(F.col("_last") >= F.col("_i") - history).alias("recent"))
    out = size.join(both, [key, "run_id"])
    w = Window.partitionBy(key).orderBy("_i")
    before = F.lag("n").over(w)
    return out.select(key, "run_id", "n", js_round(F.when(before.isNotNull(), ratio("shared", F.col("n") + before - F.col("shared"))), 3).alias("jaccard"), js_round(F.when(before.isNotNull(), ratio("recent", "n")), 3).alias("overlap"))


def neighborhood_observations(sightings: DataFrame, overlap: DataFrame) -> DataFrame:
    """A10, A11. Counts and ratios of each neighborhood's run, clamped so that subsets do not exceed their sets."""
    raw = sightings.groupBy("neighborhood", "run_id").agg(F.count("*").alias("raw"))
    first = latest(sightings, ["neighborhood", "run_id", "creator_id"], [F.asc("rank")])
    c = first.groupBy("neighborhood", "run_id").agg(F.count("*").alias("distinct"), n_if("NOT was_known").alias("new"), n_if("was_known").alias("known"), n_if("outcome = 'CONFIRMED'").alias("relevant"), n_if("outcome = 'CONFIRMED' AND quality >= 55").alias("quality"), n_if("NOT was_known AND outcome = 'CONFIRMED'").alias("_rn"), n_if("NOT was_known AND outcome = 'CONFIRMED' AND quality >= 55").alias("_qn"))
    d = F.greatest(F.lit(1), F.col("distinct"))
    out = c.join(raw, ["neighborhood", "run_id"]).join(overlap.select("neighborhood", "run_id", "jaccard", "overlap"), ["neighborhood", "run_id"], "left")
    rn, qn = clamp("_rn", 0, "new"), clamp("_qn", 0, "new")
    return out.select("neighborhood", "run_id", "raw", "distinct", "new", "known", "relevant", "quality", ratio(F.greatest(F.lit(0), F.col("raw") - F.col("distinct")), F.greatest(F.lit(1), F.col("raw"))).alias("duplicate_ratio"), (F.col("known") / d).alias("known_ratio"), (F.col("new") / d).alias("new_ratio"), (rn / d).alias("relevant_new"), (qn / d).alias("quality_new"), "jaccard", "overlap")


def marginal_values(obs: DataFrame, quota: Column, last: int = 20) -> DataFrame:
    """A14, A15, M12, W07. Each observation's own value and what the `last` ones before it of its neighborhood led to expect."""
    w = Window.partitionBy("neighborhood").orderBy("run_id").rowsBetween(-last, -1)
    o = F.coalesce("overlap", F.lit(0.0))
    out = obs.withColumns({"prior_n": F.count("*").over(w), "prior_relevant": F.avg("relevant_new").over(w), "prior_quality": F.avg("quality_new").over(w), "prior_overlap": F.avg(o).over(w)})
    own = observed_value("relevant_new", "quality_new", "new_ratio", "quality_new", F.greatest(F.lit(0.0), 1 - o), F.lit(0.0), quota, F.lit(0.0), o)
    return out.withColumn("observed_value", own).withColumn("expected_value", expected_value("prior_n", F.coalesce("prior_relevant", F.lit(0.0)), F.coalesce("prior_quality", F.lit(0.0)), F.coalesce("prior_overlap", F.lit(0.0)), quota))


def trend(obs: DataFrame) -> DataFrame:
    """W09. First and last yield of each neighborhood, and whether it saturates (three observations at least)."""
    g = obs.groupBy("neighborhood").agg(F.count("*").alias("n"), F.min_by("relevant_new", "run_id").alias("earliest"), F.max_by("relevant_new", "run_id").alias("latest"), F.max_by("overlap", "run_id").alias("latest_overlap"), F.sum("relevant_new").alias("total_yield"), F.avg("relevant_new").alias("avg_relevant"), F.avg("quality_new").alias("avg_quality"), F.avg("known_ratio").alias("avg_known"), F.avg(F.coalesce("overlap", F.lit(0.0))).alias("avg_overlap"))
    flag = (F.col("n") >= 3) & (F.col("latest") < 0.5 * F.col("earliest")) & (F.col("latest") < 0.15) & (F.col("latest_overlap") > 0.7)
    return g.withColumn("saturating", F.coalesce(flag, F.lit(False)))


def size_band(n) -> Column:
    """A12. Band of an audience."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n.isNull() | (n < 0), "UNKNOWN").when(n < 10_000, "MICRO_<10K").when(n < 100_000, "MID_10K_100K").when(n < 500_000, "LARGE_100K_500K").otherwise("MAJOR_500K+")


def size_bands(rows: DataFrame, key: str, text: str, order: list[Column]) -> DataFrame:
    """A12, T15. Distinct creators of each band, by each one's newest audience text."""
    own = latest(rows, [key], order).withColumn("band", size_band(subscribers(text)))
    return own.groupBy("band").agg(F.count("*").alias("creators"))


def retrieval_evidence(pages: DataFrame, as_of, quota_default: float = 100.0) -> DataFrame:
    """A16. Evidence of each neighborhood and configuration: pages to runs to averages, with the newest week's runs.

    Needs neighborhood, config, run_id, page, ts, distinct, confirmed, quality, duplicate_ratio, known, quota.
    """
    run = pages.groupBy("neighborhood", "config", "run_id").agg(*[F.sum(c).alias(c) for c in ("distinct", "confirmed", "quality", "known", "quota")], F.avg("duplicate_ratio").alias("dup"), F.max("ts").alias("ts"), F.count("*").alias("pages"))
    recent = F.col("ts") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    g = run.groupBy("neighborhood", "config").agg(F.count("*").alias("runs"), js_round(F.avg(ratio("confirmed", "distinct")), 3).alias("relevant"), js_round(F.avg(ratio("quality", "distinct")), 3).alias("quality"), js_round(F.avg("dup"), 3).alias("duplicate"), js_round(F.avg(ratio("known", "distinct")), 3).alias("known"), F.avg("quota").alias("_quota"), n_if(recent).alias("recent_runs"), F.sum("pages").alias("pages"))
    out = g.withColumn("uncertainty", js_round(1 / F.sqrt(1 + F.col("runs")), 3)).withColumn("observed", js_round(clamp(50 * F.col("relevant") + 50 * F.col("quality") - 20 * F.col("duplicate") - 10 * F.col("known"), 0, 100), 1))
    return out.withColumn("expected", js_round(clamp(F.col("observed") * (1 - 0.3 * F.col("uncertainty")), 0, 100), 1)).withColumn("quota", F.round(F.coalesce("_quota", F.lit(quota_default)), 6)).drop("_quota")


def arm_comparison(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """A17. Yields of arms side by side, per 1000 units of quota."""
    g = rows.groupBy(arm).agg(F.count("*").alias("runs"), F.sum("quota").alias("quota"), F.sum("new").alias("new"), F.sum("relevant").alias("relevant"))
    return g.withColumns({"new_per_1000": js_round(1000 * ratio("new", "quota"), 2), "relevant_per_1000": js_round(1000 * ratio("relevant", "quota"), 2)})


def frontier_diagnostics(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """A18. Counts and quota of each value of each dimension, in one pass over grouping sets."""
    return by_dimension(rows, dimensions).groupBy("dimension", "value").agg(F.count("*").alias("rows"), F.sum("quota").alias("quota"))


def exploration_status(rows: DataFrame, day: Column, floor: float = 0.2, ceiling: float = 0.3) -> DataFrame:
    """A19, R16. Share of exploration in each quota day, and whether floor or ceiling is active."""
    g = rows.groupBy(day.alias("quota_day")).agg(F.sum("quota").alias("quota"), F.sum(F.when(F.col("exploration"), F.col("quota")).otherwise(0)).alias("exploration_quota"))
    return g.withColumn("ratio", F.round(ratio("exploration_quota", "quota"), 6)).withColumns({"floor_active": F.col("ratio") < floor, "ceiling_active": F.col("ratio") >= ceiling})


def coverage_replay(events: DataFrame, outcome_key: str, cell: str) -> DataFrame:
    """A27. Each cell's counters over distinct outcomes; order does not matter."""
    once = latest(events, [outcome_key], [F.asc("ts")])
    return once.groupBy(cell).agg(F.count("*").alias("observations"), F.sum("distinct_results").alias("distinct_results"), F.sum("new_creators").alias("new_creators"), F.sum("duplicate_results").alias("duplicate_results"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def source_independence(docs: DataFrame, key: str, family: str, doc: str, excluded: Column) -> DataFrame:
    """A28, A29. Independent families of a key's documents (an unknown family is the document itself), and the documents left out."""
    own = F.coalesce(family, F.concat(F.lit("doc:"), F.col(doc).cast("string")))
    rows = docs.withColumn("_out", excluded).withColumn("_family", own)
    return rows.groupBy(key).agg(F.countDistinct(F.when(~F.col("_out"), F.col("_family"))).alias("independent_families"), n_if("NOT _out").alias("documents"), n_if("_out").alias("excluded"))


def evidence_coverage(docs: DataFrame, key: str, as_of, expected: int) -> DataFrame:
    """A30, A53. Documents by type, languages, oldest and newest, cumulative freshness, and whether enough."""
    age = F.datediff(F.lit(as_of).cast("timestamp"), F.col("observed_at"))
    out = docs.withColumn("_age", age).groupBy(key).agg(F.count("*").alias("documents"), F.countDistinct("type").alias("types"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"), *[n_if(F.col("_age") <= d).alias(f"within_{d}") for d in (30, 90, 365, 730)])
    return out.withColumn("complete", F.col("documents") >= expected)


def creator_focus(mass: DataFrame, as_of_age: Column) -> DataFrame:
    """A31, D40. Mean over families of each creator's decayed masses per topic, with a lower bound of the first topic.

    Needs creator, family, topic, mass, confidence. Inside a family weights are confidence * exp(-age / 730), normalised.
    """
    w = F.col("confidence") * F.exp(-F.greatest(as_of_age, F.lit(0.0)) / 730)
    fam = mass.withColumn("_w", w).groupBy("creator", "family", "topic").agg(F.sum(F.col("_w") * F.col("mass")).alias("m"))
    fam = fam.withColumn("m", ratio("m", F.sum("m").over(Window.partitionBy("creator", "family"))))
    families = fam.groupBy("creator").agg(F.countDistinct("family").alias("families"))
    topic = fam.groupBy("creator", "topic").agg(F.sum("m").alias("m")).join(families, "creator").withColumn("mass", F.round(F.col("m") / F.col("families"), 9))
    return topic.withColumn("lower", F.round(F.greatest(F.lit(0.0), F.col("mass") - F.least(F.lit(0.25), 0.35 / F.sqrt(F.greatest(F.lit(1), F.col("families"))))), 9)).drop("m")


def osint_evidence(rows: DataFrame, as_of, stale_days: int = 180) -> DataFrame:
    """A32. Evidence of each concept, country, language and script, with why it is not eligible."""
    own = F.coalesce(F.nullif(F.lower(F.trim("correlation")), F.lit("")), F.col("source_id").cast("string"))
    g = rows.groupBy("concept", "country", "language", "script").agg(F.countDistinct(own).alias("sources"), F.round(F.avg(F.col("confidence") * F.col("reliability") * F.col("validity")), 9).alias("strength"), F.max("observed_at").alias("newest"), F.countDistinct("observed_script").alias("_scripts"))
    stale = F.datediff(F.lit(as_of).cast("timestamp"), F.col("newest")) > stale_days
    reasons = F.array_compact(F.array(F.when(F.col("sources") < 2, F.lit("INSUFFICIENT_SOURCES")), F.when(F.col("strength") < 0.55, F.lit("WEAK_EVIDENCE")), F.when(stale, F.lit("STALE")), F.when(F.col("_scripts") > 1, F.lit("SCRIPT_CONFLICT"))))
    return g.withColumn("reasons", F.array_join(reasons, ",")).withColumn("eligible", F.col("reasons") == "").drop("_scripts")


def trust(runs: DataFrame, key: list[str], least: int = 20) -> DataFrame:
    """A33, A34. Trust metrics of cohorts of completed runs, with an interval and a status."""
    g = runs.groupBy(*key).agg(F.count("*").alias("runs"), F.sum("distinct_creators").alias("distinct_creators"), F.sum("new_creators").alias("new_creators"), F.sum("relevant_new").alias("relevant_new"), F.sum("quota").alias("quota"), n_if("failed").alias("failures"), F.round(F.avg("execution_ms"), 6).alias("avg_execution_ms"))
    p, fail, useful = ratio("relevant_new", "new_creators"), ratio("failures", "runs"), ratio("relevant_new", "runs")
    status = F.when(F.col("runs") < least, "INSUFFICIENT_EVIDENCE").when((fail >= 0.2) | (p < 0.1), "DEGRADED").when((fail >= 0.1) | (useful < 0.2), "WATCH").otherwise("HEALTHY")
    out = g.withColumns({"precision": F.round(p, 9), "failure_rate": F.round(fail, 9), "relevant_per_run": F.round(useful, 9), "cost_per_useful": F.round(F.when(F.col("relevant_new") > 0, F.col("quota") / F.col("relevant_new")), 9), "status": status, "_w": wilson("relevant_new", "new_creators")})
    return out.withColumns({"precision_lower": F.round(F.col("_w.lower"), 9), "precision_upper": F.round(F.col("_w.upper"), 9)}).drop("_w")


def capture_recapture(rows: DataFrame, group: list[str], lane: str, member: str) -> DataFrame:
    """A48, A68. Unseen members by Lincoln-Petersen, mean over pairs of lanes that share members; uncertainty 1 / sqrt(seen).

    Pairs are of a member's lanes and then of lane sizes, so work grows with members, not their squares.
    """
    m = rows.select(*group, lane, member).distinct()
    sizes = m.groupBy(*group, lane).agg(F.count("*").alias("n"))
    seen = m.groupBy(*group).agg(F.countDistinct(member).alias("seen"))
    a, b = m.withColumnRenamed(lane, "a"), m.withColumnRenamed(lane, "b")
    shared = a.join(b, [*group, member]).where("a < b").groupBy(*group, "a", "b").agg(F.count("*").alias("both"))
    pairs = shared.join(sizes.select(*group, F.col(lane).alias("a"), F.col("n").alias("na")), [*group, "a"]).join(sizes.select(*group, F.col(lane).alias("b"), F.col("n").alias("nb")), [*group, "b"])
    unseen = F.greatest(F.lit(0.0), F.col("na") * F.col("nb") / F.col("both") - (F.col("na") + F.col("nb") - F.col("both")))
    est = pairs.groupBy(*group).agg(F.round(F.avg(unseen), 6).alias("unseen"))
    return seen.join(est, group, "left").select(*group, "seen", F.coalesce("unseen", F.lit(0.0)).alias("unseen"), F.round(1 / F.sqrt(F.greatest(F.lit(1), F.col("seen"))), 9).alias("uncertainty"))


def ecosystem_overlap(sets: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """A49. Weighted sum over components of the largest Jaccard with any earlier set of the same component.

    sets has key, component and member; keys are ordered. Pairs are of keys that share a member.
    """
    m = sets.select(key, "component", "member").distinct()
    size = m.groupBy(key, "component").agg(F.count("*").alias("n"))
    own, other = m, m.select(F.col(key).alias("_other"), "component", "member")
    both = own.join(other, ["component", "member"]).where(F.col("_other") < F.col(key)).groupBy(key, "component", "_other").agg(F.count("*").alias("both"))
    j = both.join(size, [key, "component"]).join(size.select(F.col(key).alias("_other"), "component", F.col("n").alias("m")), ["_other", "component"]).withColumn("j", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    top = j.groupBy(key, "component").agg(F.max("j").alias("j"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("component")]
    every = m.select(key).distinct()
    total = top.groupBy(key).agg(F.sum(weight * F.col("j")).alias("overlap"))
    value = F.coalesce("overlap", F.lit(0.0))
    return every.join(total, key, "left").select(key, F.round(F.when(value > 1 - 1e-12, F.lit(1.0)).otherwise(value), 9).alias("overlap"))


def backlog_windows(jobs: DataFrame, as_of, windows: list[tuple[str, int]]) -> DataFrame:
    """A50, J11. Arrivals, completions and oldest waiting of jobs in each window, by conditional sums in one pass."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ts")) / 60e6
    cols = [x for name, minutes in windows for x in (n_if(age <= minutes).alias(f"arrived_{name}"), n_if((age <= minutes) & (F.col("status") == "DONE")).alias(f"done_{name}"))]
    return jobs.agg(*cols, n_if("status = 'WAITING'").alias("waiting"), F.min(F.when(F.col("status") == "WAITING", F.col("ts"))).alias("oldest_waiting"))


def latency_validation(calls: DataFrame, key: list[str], value: str, budget: float) -> DataFrame:
    """A46, A47. Medians and tails, exact, and whether the tail is within budget."""
    g = calls.groupBy(*key).agg(F.count("*").alias("n"), F.expr(f"round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {value}), 6)").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    return g.withColumn("status", F.when(F.col("p95") <= budget, "PASS").otherwise("LATENCY_BUDGET_EXCEEDED"))


def coverage_rollup(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """M20. Counts at every level of a hierarchy; a level left open is '*'."""
    out = rows.rollup(*dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.select(*[F.coalesce(F.col(d).cast("string"), F.lit("*")).alias(d) for d in dimensions], "n", "level")


def page_rollup(pages: DataFrame, key: list[str], ratios: list[str]) -> DataFrame:
    """A61, A21. Runs from pages: sums, and ratios weighted by distinct results."""
    d = F.sum("distinct_results")
    return pages.groupBy(*key).agg(F.sum("raw_results").alias("raw_results"), d.alias("distinct_results"), *[F.round(F.coalesce(F.try_divide(F.sum(F.col(r) * F.col("distinct_results")), F.nullif(d, F.lit(0))), F.lit(0.0)), 9).alias(r) for r in ratios])


def native_projection(rows: DataFrame, key: str) -> DataFrame:
    """A51, A52. Locale evidence of a key: the dominant locale (most, then first by name), ratios, eligibility and confidence.

    Needs status NATIVE, BOOTSTRAP or TRANSLATED, locale, quality, switched, structured, community.
    """
    locale = rows.groupBy(key, "locale").agg(F.count("*").alias("n"))
    top = latest(locale, [key], [F.desc("n"), F.asc("locale")]).select(key, F.col("locale").alias("dominant_locale"))
    g = rows.groupBy(key).agg(n_if("status = 'NATIVE'").alias("native"), n_if("status = 'NATIVE' AND quality").alias("native_quality"), F.max(F.col("status") == "BOOTSTRAP").alias("bootstrap"), F.max("structured").alias("structured"), F.avg(F.col("switched").cast("int")).alias("_switched"), F.countDistinct("community").alias("communities"))
    status = F.when(F.col("native") > 0, "NATIVE").when(F.col("bootstrap"), "BOOTSTRAP").otherwise("TRANSLATED")
    nq = F.col("native_quality")
    conf = 0.2 + F.when(F.col("structured"), 0.3).otherwise(0.0) + F.when(F.col("native") >= 1, 0.2).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * nq) + F.least(F.lit(0.1), 0.05 * F.col("communities"))
    capped = F.when((nq <= 1) & ~F.col("structured") & (status != "BOOTSTRAP"), F.least(F.lit(0.45), conf)).otherwise(conf)
    out = g.withColumns({"status": status, "code_switched": F.col("_switched") > 0.3, "eligible": ((F.col("native") >= 1) & ((nq >= 2) | F.col("structured"))) | F.col("bootstrap"), "confidence": F.round(F.least(F.lit(0.95), capped), 9)})
    return out.join(top, key).drop("_switched")


def status_costs(rows: DataFrame, key: list[str], cost: str) -> DataFrame:
    """A55. Count and cost by status."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), F.round(F.sum(cost), 2).alias("cost"))


def surfaces(rows: DataFrame, key: str, members: list[str]) -> DataFrame:
    """A54, A57, A58. Each key's distinct members as a sorted list and as one string."""
    return rows.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(m).cast("string"))), ",").alias(m) for m in members], F.count("*").alias("rows"))


def bundle_availability(rows: DataFrame, key: list[str], available: Column) -> DataFrame:
    """A56, A73. Availability of each key in basis points, rounded down."""
    return rows.groupBy(*key).agg(F.count("*").alias("total"), n_if(available).alias("available")).withColumn("availability_bp", F.floor(10000 * F.col("available") / F.col("total")))


def quota_projection(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """A70. Each key's used units within 0 .. limit, and what remains."""
    used = usage.groupBy("key_id").agg(F.sum("units").alias("units"))
    u = F.greatest(F.lit(0), F.least(F.col("limit"), F.coalesce("units", F.lit(0))))
    return keys.join(used, "key_id", "left").select("key_id", "limit", u.alias("used"), (F.col("limit") - u).alias("remaining"))


def drift(current: DataFrame, baseline: DataFrame, key: str, value: str, least: int = 10, effect: float = 0.1) -> DataFrame:
    """A66. Change of a mean between two windows: INSUFFICIENT, OBSERVE, AUDIT (down) or REACTIVATION (up)."""
    g = lambda d, s: d.groupBy(key).agg(F.count("*").alias(f"n_{s}"), F.avg(value).alias(f"mean_{s}"))
    out = g(current, "now").join(g(baseline, "base"), key, "full_outer").withColumn("effect", F.round(F.col("mean_now") - F.col("mean_base"), 9))
    n = F.least(F.coalesce("n_now", F.lit(0)), F.coalesce("n_base", F.lit(0)))
    return out.select(key, F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_base", F.lit(0)).alias("n_base"), "effect", F.when(n < least, "INSUFFICIENT").when(F.abs("effect") < effect, "OBSERVE").when(F.col("effect") < 0, "AUDIT").otherwise("REACTIVATION").alias("decision"))


def coverage_opportunity(rows: DataFrame) -> DataFrame:
    """A67. Score of a cell per unit of cost, and whether it is saturated."""
    score = (F.col("unique_yield") + F.col("confirm_rate") + F.col("uncertainty") + F.least(F.lit(1.0), F.col("days_since") / 90)) / F.greatest(F.lit(1.0), F.col("cost"))
    return rows.withColumn("score", F.round(score, 9)).withColumn("saturated", (F.col("n") >= 30) & (F.col("unique_yield") < 0.05) & (F.col("uncertainty") < 0.1))

