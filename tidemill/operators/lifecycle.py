"""Classification and decision tables: ordered rules as one expression each (D, P10-P22, K06-K10)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, clamp01, js_round, ratio
from .relational import latest


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def rules(*pairs: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    return reduce(lambda w, p: w.when(p[0], p[1]), pairs[1:], F.when(pairs[0][0], pairs[0][1])).otherwise(otherwise)


def c(name: str) -> Column:
    return F.col(name)


def triage(high: Column, market: Column, hard: Column, soft: Column, stale: Column, applicable: Column, non_latin: Column) -> Column:
    """D01. Disposition and reason of a search candidate from the signal families that it shows."""
    some = lambda a: F.size(a) > 0
    out = lambda d, r: F.struct(F.lit(d).alias("disposition"), F.lit(r).alias("reason"))
    plausible, withheld = "PLAUSIBLE", "WITHHOLD"
    return (
        F.when(~applicable, out("NOT_APPLICABLE", "NON_INITIAL_RESULT"))
        .when(stale, out(withheld, "STALE_DOCUMENT"))
        .when(some(hard) & some(high), out(withheld, "CONFLICTING_DOMAINS"))
        .when(some(hard), out(withheld, "EXPLICIT_OTHER_DOMAIN"))
        .when(some(high), out(plausible, "HIGH_SPECIFICITY_SIGNAL"))
        .when((F.size(F.array_distinct(market)) >= 2) & ~some(soft), out(plausible, "CORROBORATED_MARKET_CONTEXT"))
        .when(some(market) | some(soft), out(withheld, "AMBIGUOUS_CONTEXT"))
        .when(non_latin, out(plausible, "CONSERVATIVE_PASS"))
        .otherwise(out(withheld, "NO_EXPLICIT_SIGNAL"))
    )


def evidence_weight(matches: Column, weight: Column, cap: Column, reliability: Column, confidence: Column) -> Column:
    """D02. min(cap, matches * weight) * reliability * confidence."""
    return F.least(cap, matches * weight) * reliability * confidence


def assemble(evidence: DataFrame, key: str) -> DataFrame:
    """D03, D06. A key's positive and negative weights, sources, and its primary category: two points a match, ties to the first listed."""
    g = evidence.groupBy(key).agg(
        F.round(F.coalesce(F.sum(F.when(c("polarity") == "POSITIVE", c("weight"))), F.lit(0.0)), 9).alias("positive"),
        F.round(F.coalesce(F.sum(F.when(c("polarity") == "NEGATIVE", c("weight"))), F.lit(0.0)), 9).alias("negative"),
        F.countDistinct("source").alias("sources"),
        F.count("*").alias("items"),
    )
    points = evidence.where("polarity = 'POSITIVE'").groupBy(key, "category").agg(F.sum(2 * c("matches")).alias("points"), F.min("category_order").alias("place"))
    top = latest(points, [key], [F.desc("points"), F.asc("place")]).select(key, c("category").alias("primary_category"))
    return g.join(top, key, "left")


def staged(df: DataFrame, least_documents: int = 1) -> DataFrame:
    """D04. Five gates: availability, candidate, corroboration, contradiction, lifecycle."""
    p, n = c("positive"), c("negative")
    out = df.withColumns({
        "availability": F.when(c("items") >= least_documents, "PASS").otherwise("FAIL"),
        "candidate": F.when(p > 0, "PASS").otherwise("FAIL"),
        "corroboration": F.when(c("sources") >= 2, "PASS").otherwise("FAIL"),
        "contradiction": F.when((n >= 25) & ((p == 0) | (n > 1.5 * p)), "FAIL").when(n >= 25, "MIXED").otherwise("PASS"),
    })
    return out.withColumn("lifecycle", rules((c("contradiction") == "FAIL", "REJECT"), ((c("candidate") == "PASS") & (c("corroboration") == "PASS") & (c("contradiction") == "PASS"), "CONFIRM"), otherwise="UNCERTAIN"))


def decision(df: DataFrame, calibrate) -> DataFrame:
    """D05. Decision and score from staged weights."""
    p, n = c("positive"), c("negative")
    raw = clamp(50 + p - n, 0, 100)
    prob = calibrate(raw)
    confirm = (c("lifecycle") == "CONFIRM") & (p >= F.when(c("strong"), 15).otherwise(20)) & (raw >= 65)
    reject = (c("lifecycle") == "REJECT") & (n >= 25) & ((p == 0) | (n > 1.5 * p))
    return df.withColumn("raw", F.round(raw, 9)).withColumn("decision", rules((confirm, "CONFIRMED"), (reject, "REJECTED"), otherwise="UNCERTAIN")).withColumn("score", F.when(confirm, F.greatest(F.lit(82.0), prob)).when(reject, F.least(F.lit(22.0), prob)).otherwise(clamp(prob, 23, 79)))


def frontier_state() -> Column:
    """D09. Of n, mv, rel, qual, known, overlap, saturating, total_yield, efficiency."""
    rel, qual, known, lap = c("rel"), c("qual"), c("known"), c("overlap")
    tired = c("saturating") | ((lap >= 0.75) & (rel < 0.05))
    return rules(
        (c("n") == 0, "UNEXPLORED"),
        (c("n") < 3, "PROBING"),
        ((c("mv") == 0) & (rel == 0) & (qual == 0) & (known < 0.1) & (lap > 0.8), "HARMFUL"),
        (tired & ((c("total_yield") > 0) | (c("efficiency") > 0)), "MAINTENANCE"),
        (tired & (lap >= 0.85) & (rel < 0.02), "SATURATED"),
        (tired, "SATURATING"),
        ((rel >= 0.15) | (qual >= 0.10) | (c("mv") >= 15) | (c("efficiency") >= 1), "PRODUCTIVE"),
        otherwise="PARTIALLY_OBSERVED",
    )


def trial_outcome() -> Column:
    """D10. Of distinct, rel, qual, cov, quota, known, overlap_before, overlap_after."""
    rel, qual = c("rel"), c("qual")
    return rules((c("distinct") == 0, "NOISY"), ((rel > 0) & (qual > 0), "PRODUCTIVE"), ((rel > 0) | (c("cov") >= 0.2), "PROMISING"), (F.greatest("overlap_before", "overlap_after") >= 0.8, "SATURATED"), ((c("quota") >= 100) & (rel == 0) & (c("known") < 0.1), "HARMFUL"), otherwise="UNCERTAIN")


def term_lifecycle() -> Column:
    """D08. Of executions, term_yield, is_brand, creators, communities, evidence: the state; PROVEN and SEARCH_TRIAL may be searched."""
    brand = rules((c("evidence") >= 1, "OBSERVED"), otherwise="CANDIDATE")
    multi = (c("creators") >= 3) & (c("communities") >= 2)
    return (
        F.when((c("executions") >= 5) & (c("term_yield") < 0.08), "DEMOTED")
        .when(c("is_brand"), brand)
        .when((c("executions") >= 3) & (c("term_yield") >= 0.28), "PROVEN")
        .when(multi & (c("evidence") >= 5), "SEARCH_TRIAL")
        .when(multi, "MULTI_CREATOR_VALIDATED")
        .when(c("evidence") >= 1, "OBSERVED")
        .otherwise("CANDIDATE")
    )


def continuation(df: DataFrame) -> DataFrame:
    """D19, W10. Utility of each page, whether it is low, and the run of low ones that ends there.

    Needs key, page, and the ratios qy, cy, nov, cp, div, dup, nt, and confirmed and new.
    """
    u = js_round(clamp01(0.30 * c("qy") + 0.25 * c("cy") + 0.20 * c("nov") + 0.15 * c("cp") + 0.10 * c("div") - 0.20 * c("dup") - 0.20 * c("nt")), 5)
    out = df.withColumn("utility", u).withColumn("low", (c("utility") < 0.2) | ((c("confirmed") == 0) & (c("new") == 0)) | (c("dup") >= 0.8) | (c("cp") < 0.5))
    w = Window.partitionBy("key").orderBy("page")
    out = out.withColumn("_island", F.sum((~c("low")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(c("low").cast("int")).over(Window.partitionBy("key", "_island").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("streak", streak).drop("_island")


def should_stop(has_next: Column, page: Column, most_pages: int, creators: Column, most_creators: int, streak: Column, most_streak: int) -> Column:
    """D19. Why paging stops; null to go on."""
    return F.when(~has_next, "NO_NEXT_PAGE").when(page >= most_pages, "PAGE_CAP").when(creators >= most_creators, "CREATOR_CAP").when(streak >= most_streak, "LOW_YIELD_STREAK")


def eligibility(cooldown_minutes: float = 360.0) -> Column:
    """P16. Why a neighborhood may not be chosen; empty if it may. Of state, overlap, known, elapsed_minutes, recent."""
    return reasons((c("state") == "HARMFUL", "HARMFUL"), ((c("state") == "SATURATED") & (c("overlap") >= 0.85) & (c("known") >= 0.85), "SATURATED"), (c("elapsed_minutes") < cooldown_minutes, "COOLDOWN"), (c("recent") >= 5, "CONCENTRATION"))


def retrieval_policy() -> Column:
    """P17. (eligible, depth, date_allowed) of state, saturating and dup."""
    bad = (c("state") == "HARMFUL") | c("saturating")
    return F.struct((~bad).alias("eligible"), F.when(bad | (c("dup") >= 0.7), 1).otherwise(3).alias("depth"), (~bad).alias("date_allowed"))


def trial_gate(cap: float = 500.0) -> Column:
    """P18. The first reason that a trial may not start, or ALLOWED. Of killed, pending, expired, state, duplicate, spent, quota."""
    return rules((c("killed"), "KILL_SWITCH"), (~c("pending"), "NOT_PENDING"), (c("expired"), "EXPIRED"), (c("state") == "HARMFUL", "HARMFUL"), (c("duplicate"), "DUPLICATE"), (c("spent") + c("quota") > cap, "DAILY_CAP"), otherwise="ALLOWED")


def reactivation() -> Column:
    """P19. (reactivate, reasons) of status, validation, manual, new_links, activity and age_days (null: never checked).

    Only a failed scan can be taken up again, unless it ended in a completed decision; then any one reason does.
    """
    none = lambda why: F.struct(F.lit(False).alias("reactivate"), F.array(F.lit(why)).alias("reasons"))
    why = reasons(
        (c("manual"), "OPERATOR_NOMINATED_RECHECK"),
        (c("new_links") > 0, "NEWLY_OBSERVED_EXTERNAL_LINKS"),
        (c("activity").isin("VERY_ACTIVE", "ACTIVE"), "HIGH_CREATOR_ACTIVITY"),
        (c("age_days") >= 30, "COMMUNITY_FRESHNESS_INTERVAL_EXPIRED"),
        (c("age_days").isNull(), "NO_PRIOR_CHECK_TIMESTAMP"),
    )
    some = F.struct(F.lit(True).alias("reactivate"), why.alias("reasons"))
    decided = (c("status") == "FAILED_PERMANENT") & F.coalesce(c("validation") == "COMPLETED", F.lit(False))
    return (
        F.when(~F.coalesce(c("status").isin("FAILED", "FAILED_PERMANENT"), F.lit(False)), none("SCAN_STATUS_NOT_RECOVERABLE_FAILURE"))
        .when(decided, none("SEMANTIC_TERMINAL_EVIDENCE_PRESERVED"))
        .when(F.size(why) == 0, none("NO_REACTIVATION_TRIGGER_MATCHED"))
        .otherwise(some)
    )


#: Classes of terms with their use, specificity and ambiguity, where they are governed and where not.
TERM_CLASSES = (
    (("INSTRUMENT", "PLATFORM", "BROKER", "PROPFIRM"), ("STANDALONE", 95, 5), ("MODIFIER_ONLY", 62, 48)),
    (("METHOD", "STRATEGY"), ("STANDALONE", 82, 18), ("MODIFIER_ONLY", 58, 52)),
    (("MARKET", "SESSION", "TEMPORAL", "GEOGRAPHIC"), ("MODIFIER_ONLY", 42, 72), ("MODIFIER_ONLY", 42, 72)),
    (("FORMAT", "TOPIC", "ENTITY", "NEIGHBORHOOD", "COVERAGE", "LEARNED"), ("MODIFIER_ONLY", 45, 65), ("MODIFIER_ONLY", 45, 65)),
)


def specificity() -> Column:
    """P22. (eligibility, specificity, ambiguity) of a term of kind, governed, proven, validated and sources."""
    row = lambda use, spec, amb: F.struct(F.lit(use).alias("eligibility"), F.lit(spec).alias("specificity"), F.lit(amb).alias("ambiguity"))
    kind = F.upper("kind")
    proven = (kind == "CONCEPT") & c("governed") & c("proven") & c("validated") & (c("sources") >= 2)
    out = F.when(proven, row("STANDALONE", 80, 20))
    for kinds, governed, other in TERM_CLASSES:
        out = out.when(kind.isin(*kinds) & c("governed"), row(*governed)).when(kind.isin(*kinds), row(*other))
    return out.otherwise(row("INELIGIBLE", 20, 80))


#: States of a catalog entry and those that may follow; likewise of an admission, a review and an investigation.
CATALOG = {"CANDIDATE": ("ELIGIBLE", "INVALID"), "ELIGIBLE": ("PROVEN", "STALE", "HARMFUL", "INVALID"), "PROVEN": ("STALE", "SATURATED", "HARMFUL", "INVALID"), "STALE": ("ELIGIBLE", "INVALID"), "SATURATED": ("ELIGIBLE", "STALE", "INVALID"), "HARMFUL": ("ELIGIBLE", "INVALID")}
ADMISSION = {"OBSERVED": ("ADMITTED", "REVIEW", "WITHHELD"), "REVIEW": ("ADMITTED", "WITHHELD"), "ADMITTED": ("WITHHELD",), "WITHHELD": ("REVIEW",)}
REVIEW = {"PENDING": ("APPROVED", "REJECTED"), "REJECTED": ("PENDING",)}
INVESTIGATION = {"ACTIVE": ("COMPLETED", "SUPERSEDED", "OPERATIONALLY_BLOCKED"), "OPERATIONALLY_BLOCKED": ("ACTIVE",)}


def transition_valid(source: Column, target: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """D13, D16, D31, D32. Whether target may follow source."""
    return reduce(lambda a, b: a | b, [(source == s) & target.isin(*t) for s, t in table.items()])


def replay(events: DataFrame, key: str, sequence: str, prior: str, result: str, table: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """D13, D33. Each event of a ledger with what was expected before it and whether it fits: version, prior state, transition."""
    w = Window.partitionBy(key).orderBy(sequence)
    out = events.withColumn("expected_version", F.row_number().over(w)).withColumn("expected_prior", F.coalesce(F.lag(result).over(w), F.lit(start)))
    bad = reasons((c(prior) != c("expected_prior"), "PRIOR_MISMATCH"), (~transition_valid(c("expected_prior"), c(result), table), "INVALID_TRANSITION"))
    return out.withColumn("mismatch", F.array_join(bad, ","))


def projection(events: DataFrame, key: str, sequence: str, result: str) -> DataFrame:
    """The state that a ledger leaves each key in, and how many events did it."""
    return events.groupBy(key).agg(F.max_by(result, sequence).alias("state"), F.count("*").alias("version"))


def verify_projection(replayed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """D33. Keys whose stored state or version is not the replayed one, or that either side lacks."""
    a, b = replayed.select(key, c("state").alias("replayed_state"), c("version").alias("replayed_version")), stored.select(key, c("state").alias("stored_state"), c("version").alias("stored_version"))
    return a.join(b, key, "full_outer").where(~(c("replayed_state").eqNullSafe(c("stored_state")) & c("replayed_version").eqNullSafe(c("stored_version"))))


def sleep(predicates: list[str], least_yield: float = 0.05) -> Column:
    """D17. Sleep only if every predicate holds, the yield is small, its upper bound below what it costs, and no probe is due.

    Of the predicates, marginal_yield, upper_bound, threshold and probe_due.
    """
    stable = (c("marginal_yield") < least_yield) & (c("upper_bound") < c("threshold")) & ~c("probe_due")
    return reduce(lambda a, b: a & b, [F.coalesce(c(p), F.lit(False)) for p in predicates], F.coalesce(stable, F.lit(False)))


def burst(current: Column, baseline: Column) -> Column:
    """D18. At least 3 sources now, at least twice as many as before."""
    return (current >= 3) & (current / F.greatest(F.lit(1), baseline) >= 2)


def readiness(metrics: DataFrame, key: list[str]) -> DataFrame:
    """D15. The worst status of each key: FAIL, then ABSTAIN, then PASS."""
    rank = F.when(c("status") == "FAIL", 2).when(c("status") == "ABSTAIN", 1).otherwise(0)
    g = metrics.groupBy(*key).agg(F.max(rank).alias("_r"))
    return g.withColumn("readiness", F.when(c("_r") == 2, "FAIL").when(c("_r") == 1, "ABSTAIN").otherwise("PASS")).drop("_r")


def stop_decision(harm: Column, over_budget: Column, n: Column, least: int, lower: Column, threshold: float) -> Column:
    """D11."""
    return rules((harm, "AUTO_STOP"), (over_budget, "AUTO_PAUSE"), (n < least, "CONTINUE"), (lower > threshold, "GO"), otherwise="NO_GO")


def admission() -> Column:
    """D14, D27. Of documents, families, recent, supported, alternative, lower, trade, label, degraded."""
    gated = (c("documents") < 2) | (c("families") < 2) | ~c("recent") | ~c("supported")
    return rules(
        (gated, "DEFER"),
        ((c("alternative") >= 0.8) & (c("trade") < 0.2) & (c("label") == "NON_TRADING"), "WITHHOLD"),
        ((c("lower") >= 0.7) & (c("trade") >= 0.7) & (c("alternative") < 0.6) & (c("label") == "CONFIRMED"), "ADMIT"),
        (c("trade") >= 0.35, "REVIEW"),
        (c("degraded") & (c("documents") >= 10) & (c("families") >= 3) & (c("trade") < 0.05), "WITHHOLD"),
        otherwise="DEFER",
    )


def resolution(matches: DataFrame, key: str) -> DataFrame:
    """D20. What an identity's matches (entity, family, source, approved, native) say: its one approved entity, if independent sources agree.

    Several approved entities are a conflict; one is exact by a native identifier, or proposed with two families and two sources.
    """
    approved = F.when(c("approved"), c("entity"))
    g = matches.groupBy(key).agg(F.countDistinct(approved).alias("entities"), F.countDistinct("family").alias("families"), F.countDistinct("source").alias("sources"), F.min(approved).alias("entity"), F.max("native").alias("_native"))
    one = c("entities") == 1
    kind = rules((c("entities") > 1, "ABSTAIN_CONFLICT"), (c("_native") & one, "EXACT_NATIVE"), (one & (c("families") >= 2) & (c("sources") >= 2), "PROPOSE_LINK"), otherwise="ABSTAIN_INSUFFICIENT")
    return g.select(key, "families", "sources", kind.alias("disposition"), F.when(one, c("entity")).alias("entity"))


def family_identity(*columns: str) -> Column:
    """D21. The first known of a document's identities, with its kind."""
    return F.coalesce(*[F.when(c(x).isNotNull(), F.concat(F.lit(f"{x}:"), c(x).cast("string"))) for x in columns])


def retry_directive(transient: Column, attempts: Column, age_hours: Column, now: Column, retry_at: Column) -> Column:
    """D23, R03, R22. (action, run_after): transient failures wait min(900 s, 30 * 2^(n - 1)) or as told, for 6 hours."""
    seconds = F.least(F.lit(900.0), 30 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))
    again = F.coalesce(retry_at, now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    return F.when(age_hours >= 6, F.struct(F.lit("FAILED").alias("action"), F.lit(None).cast("timestamp").alias("run_after"))).when(transient, F.struct(F.lit("RETRY").alias("action"), again.alias("run_after"))).otherwise(F.struct(F.lit("FAILED").alias("action"), F.lit(None).cast("timestamp").alias("run_after")))


def staged_backoff(attempts: Column) -> Column:
    """R22. Seconds: 30 * 2^n, between 30 and 3600."""
    return F.least(F.lit(3600.0), F.greatest(F.lit(30.0), 30 * F.pow(F.lit(2.0), attempts)))


def assertion_error(schema_ok: Column, confidence: Column, spans_ok: Column, citations: Column) -> Column:
    """D25. The first fault of a bounded assertion; null if sound."""
    return F.when(~schema_ok, "SCHEMA").when(~confidence.between(0, 1), "CONFIDENCE").when(~spans_ok, "SPAN").when(citations < 1, "CITATION")


def gate(*pairs: tuple[Column, str]) -> Column:
    """D12, D26, D47. (passed, reasons): passed when nothing holds against."""
    why = reasons(*pairs)
    return F.struct((F.size(why) == 0).alias("passed"), F.array_join(why, ",").alias("reasons"))


def promotion(insufficient: Column, against: Column) -> Column:
    """D12. INSUFFICIENT_EVIDENCE before REJECT before PROMOTE."""
    return rules((insufficient, "INSUFFICIENT_EVIDENCE"), (F.size(against) > 0, "REJECT"), otherwise="PROMOTE")


def project_concept(concepts: DataFrame, events: DataFrame) -> DataFrame:
    """D24. Where each concept (concept) stands after all events (seq, kind, source, target, split_from) in order: concept, canonical.

    A merge or a correction of what a concept stands for moves it to their target; a split gives it back its own name. Of
    events with one seq, the one with the least target moves a concept. Every event depends on those before it, so one task
    reads them once, in order, and holds the concepts by where they stand; the smaller of two sets that meet is moved.
    """
    split = F.coalesce(c("kind") == "SPLIT", F.lit(False))
    moves = events.select(F.lit(1).alias("turn"), "seq", split.alias("split"), F.when(split, c("split_from")).otherwise(c("source")).alias("current"), "target").where("seq > -1 AND current IS NOT NULL AND target IS NOT NULL")
    names = concepts.select(F.lit(0).alias("turn"), F.lit(None).cast(moves.schema["seq"].dataType).alias("seq"), F.lit(False).alias("split"), c("concept").alias("current"), c("concept").alias("target"))
    rows = names.unionByName(moves)
    kind = rows.schema["current"].dataType.simpleString()

    def run(batches):
        stands, times, pending, last, schema = {}, {}, [], None, None

        def settle():
            for to, group in pending:
                held = stands.get(to)
                if held is None:
                    stands[to] = group
                elif len(held) < len(group):
                    group |= held
                    stands[to] = group
                else:
                    held |= group
            pending.clear()

        for b in batches:
            schema = b.schema
            for turn, seq, splits, current, target in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not turn:
                    times[current] = times.get(current, 0) + 1
                    if current is not None:
                        stands[current] = {current}
                    continue
                if seq != last:
                    settle()
                    last = seq
                if not splits:
                    group = stands.pop(current, None)
                    if group:
                        pending.append((target, group))
                elif target in stands.get(current, ()):
                    stands[current].remove(target)
                    pending.append((target, {target}))
        settle()
        found = [(concept, to) for to, group in stands.items() for concept in group for _ in range(times[concept])]
        found += [(None, None)] * times.get(None, 0)
        for k in range(0, len(found), 10_000):
            own, to = zip(*found[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, schema.field("current").type), pa.array(to, schema.field("target").type)], names=["concept", "canonical"])

    out = rows.repartition(1).sortWithinPartitions("turn", "seq", "target").mapInArrow(run, f"concept {kind}, canonical {rows.schema['target'].dataType.simpleString()}")
    return out.withColumn("concept", c("concept").cast(concepts.schema["concept"].dataType))


def best_first(df: DataFrame, key: list[str], score: Column, ordinal: str) -> DataFrame:
    """K09, L09, K07. The highest score of each key, the first listed of equals."""
    return latest(df.withColumn("_score", score), key, [F.desc("_score"), F.asc(ordinal)]).drop("_score")


def community_rank(usable: Column, ownership: Column, status: Column, order: dict[str, int]) -> Column:
    """K10. Usable first, then ownership, then how far validation came."""
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[status]
    return usable.cast("int") * 10_000 + ownership * 1_000 + F.coalesce(place, F.lit(0))


def ownership(df: DataFrame, key: str) -> DataFrame:
    """T25, K05. Ownership score of a community link from all its sightings, and what it infers.

    Needs surface, explicit, page, partner, canonical_domain, brand, social.
    """
    base = F.max(F.when(c("surface") == "ABOUT", 90).when(c("surface") == "CHANNEL_LINKS", 70 + F.when(c("explicit"), 10).otherwise(0)).when(c("surface") == "VIDEO", 65).when(c("surface") == "SOCIAL", 55).when(c("surface") == "WEBSITE", 40).otherwise(0))
    plus = lambda name, n: F.max(c(name).cast("int")) * n
    videos = F.countDistinct(F.when(c("surface") == "VIDEO", c("page")))
    g = df.groupBy(key).agg((base + F.when(videos >= 2, 15).otherwise(0) + F.when(F.countDistinct("surface") >= 2, 15).otherwise(0) + plus("canonical_domain", 55) + plus("brand", 35) + plus("social", 20) - plus("partner", 80)).alias("score"))
    return g.withColumn("ownership", rules((c("score") >= 75, "OWNED"), (c("score") <= 0, "THIRD_PARTY"), otherwise="UNKNOWN"))


def country(evidence: DataFrame, key: str, excluded: list[str]) -> DataFrame:
    """T17, D44. The country of a key from prioritised evidence.

    Only the lowest priority present decides. Its best confidence names the country; a tie is a conflict, at most 49.
    """
    first = Window.partitionBy(key)
    own = evidence.withColumn("_p", F.min("priority").over(first)).where(c("priority") == c("_p"))
    best = own.groupBy(key, "country", "priority").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy(key)
    best = best.withColumn("_top", F.max("confidence").over(w)).where(c("confidence") == c("_top")).withColumn("_n", F.count("*").over(w))
    one = latest(best, [key], [F.asc("country")])
    conf = F.when(c("_n") > 1, F.least(F.lit(49), c("confidence"))).otherwise(c("confidence"))
    status = rules((c("country").isin(excluded) & (c("_n") == 1), "REJECTED"), (c("_n") > 1, "UNCERTAIN"), (c("confidence") >= 85, "CONFIRMED"), (c("confidence") >= 60, "LIKELY"), otherwise="UNCERTAIN")
    return one.select(key, "country", "priority", status.alias("status"), F.when(status == "REJECTED", F.lit(100)).otherwise(conf).alias("confidence"), (c("_n") > 1).alias("conflict"))


def creator_quality(technical: Column, hype: Column, activity: Column, age: Column, community: Column, has_invite: Column, confirmed: Column) -> Column:
    """T13. Quality from education, freshness, community and format, at most 100."""
    education = clamp(15 + F.when(technical >= 4, 20).when(technical >= 2, 12).when(technical >= 1, 5).otherwise(0) - 10 * hype, 0, 35)
    fresh = F.when(activity == "VERY_ACTIVE", 25).when(activity == "ACTIVE", 22).when(activity == "OCCASIONAL", 14).when(activity == "DORMANT", 2).when(age <= 30, 25).when(age <= 90, 20).when(age <= 365, 12).otherwise(8)
    social = F.when(community == "ACTIVE", 25).when(community == "LOW_VOLUME", 20).when(has_invite, 15).otherwise(10)
    return F.least(F.lit(100.0), education + fresh + social + 12 + F.when(confirmed, 3).otherwise(0))


def review_eligibility() -> Column:
    """D29. Ordered rules on a review candidate: country, terminal, operational, investigating, degraded, then evidence."""
    return rules((c("country_rejected"), "COUNTRY"), (c("terminal"), "TERMINAL"), (c("operational_failure"), "OPERATIONAL"), (c("investigating"), "INVESTIGATING"), (c("degraded"), "DEGRADED"), (c("documents") < 1, "NO_EVIDENCE"), otherwise="ELIGIBLE")


#: The corpus that an admission state is shown in, and why; all others are withheld.
CORPUS = {
    "ADMITTED_CONFIRMED": ("CONFIRMED", "CONFIRMED_CORPUS"),
    "ADMITTED_REVIEW": ("REVIEW", "REVIEW_CORPUS"),
    "WITHHELD_INVESTIGATING": ("INVESTIGATING", "INVESTIGATION_IN_PROGRESS"),
    "NOT_EVALUATED": ("DISCOVERY_CANDIDATES", "CANDIDATE_NOT_ADMITTED"),
    "LEGACY_VISIBLE": ("DISCOVERY_CANDIDATES", "CANDIDATE_NOT_ADMITTED"),
}


def corpus_of(state: Column) -> Column:
    """D30. (corpus, reason)."""
    pair = lambda v: F.struct(F.lit(v[0]).alias("corpus"), F.lit(v[1]).alias("reason"))
    known = reduce(lambda w, kv: w.when(state == kv[0], pair(kv[1])), CORPUS.items(), F.when(F.lit(False), pair(("", ""))))
    return known.otherwise(pair(("WITHHELD", "WITHHELD_BY_ADMISSION_POLICY")))


def false_negative() -> Column:
    """D34. The first stage that lost a positive."""
    return rules((~c("retrieved"), "RETRIEVAL"), (c("provider_failed"), "PROVIDER"), (c("documents") < 1, "EVIDENCE"), (~c("semantic"), "SEMANTIC"), (c("families") < 2, "CORROBORATION"), (c("score") < c("threshold"), "SCORE"), otherwise="POLICY")


def query_authority() -> Column:
    """D35. The first reason that a query may not run by itself, or that it may.

    Of collection, shaped, policy (null: none), current_policy, eligibility, atoms, stale_atoms, anchor, template, primary_type, explicit.
    """
    allowed = lambda name: F.coalesce(c(name).isin("STANDALONE", "ANCHOR_ONLY"), F.lit(False))
    some = c("atoms") > 0
    lone = (c("template") == "SINGLE_ATOM") & (F.upper("primary_type") == "METHOD") & ~c("explicit")
    return rules(
        (c("collection") == "REJECTED", "QUERY_ALREADY_REJECTED"),
        (~c("shaped"), "CURRENT_RETRIEVAL_SHAPE_FAILED"),
        (c("policy").isNull(), "CURRENT_RETRIEVAL_PROVENANCE_MISSING"),
        (c("policy") != c("current_policy"), "STALE_RETRIEVAL_POLICY_VERSION"),
        (~allowed("eligibility"), "PRIMARY_ATOM_NOT_AUTHORIZED_FOR_RETRIEVAL"),
        (some & (c("stale_atoms") > 0), "ATOM_POLICY_PROVENANCE_STALE"),
        (some & ~allowed("anchor"), "QUERY_ANCHOR_NOT_CURRENTLY_AUTHORIZED"),
        (some & F.coalesce(lone, F.lit(False)), "STANDALONE_METHOD_REQUIRES_CONCRETE_TRADING_ANCHOR"),
        (~some & ~F.coalesce(c("template").isin("SINGLE_ATOM", "ORGANIC_STANDALONE"), F.lit(False)), "COMPOUND_QUERY_ATOM_PROVENANCE_MISSING"),
        otherwise="CURRENT_RETRIEVAL_POLICY_SATISFIED",
    )


def _says(x, pattern: str) -> Column:
    return F.coalesce(x.rlike(pattern), F.lit(False))


def provider_error(name: Column, status: Column, message: Column) -> Column:
    """D36. (class, retryable) of a failed provider call; what is not known is transient."""
    kind = lambda v, again: F.struct(F.lit(v).alias("class"), F.lit(again).alias("retryable"))
    code = lambda *v: F.coalesce(status.isin(*v), F.lit(False))
    return (
        F.when(F.coalesce(name == "AbortError", F.lit(False)), kind("CANCELLED", True))
        .when(code(429) | _says(message, "(?i)429|RESOURCE_EXHAUSTED|rate.?limit|quota"), kind("RATE_LIMIT", True))
        .when(code(408, 500, 502, 503, 504) | _says(message, "(?i)ECONNRESET|ETIMEDOUT|high demand|temporar"), kind("TRANSIENT", True))
        .when(code(400, 404, 422), kind("PERMANENT_INPUT", False))
        .otherwise(kind("TRANSIENT", True))
    )


def crawler_failure(status: Column, message: Column) -> Column:
    """D46. Class of a failed page visit."""
    code = lambda *v: F.coalesce(status.isin(*v), F.lit(False))
    number = lambda v: rf"(^|[^0-9A-Za-z_]){v}([^0-9A-Za-z_]|$)"
    return rules(
        (code(429) | _says(message, f"(?i){number(429)}|too many requests|rate.?limit"), "RATE_LIMITED"),
        (code(401, 403) | _says(message, f"(?i){number(403)}|{number(401)}|request blocked|access denied|forbidden|captcha|bot protection|cloudflare"), "BLOCKED"),
        (code(408, 425, 500, 502, 503, 504) | _says(message, "(?i)timeout|timed out|econnreset|econnrefused|eai_again|enotfound|network|navigation.*failed|browser.*closed|target.*closed"), "TRANSIENT"),
        otherwise="OTHER",
    )


def crawler_delay(kind: Column, retries: Column) -> Column:
    """D46. Milliseconds before another visit: doubled with each, at most 8 s after a rate limit and 4 s after other failures; null for no other."""
    doubled = lambda base, most: F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), retries)))
    return F.when(kind == "RATE_LIMITED", doubled(1000, 8000)).when(kind.isin("BLOCKED", "TRANSIENT"), doubled(500, 4000))


#: Fixed value: what a failure says that is about running and not about evidence.
OPERATIONAL = "(?i)(provider|timeout|rate.?limit|quota|cooldown|transient|temporar|econn|eai_again|429|503|502|504|credentials|cancel)"


def backlog_diagnosis() -> Column:
    """D39. What a waiting job waits for. Of status, locked_by, locked_at, investigation, deadline_at, step, failure, run_after, runnable, now."""
    sure = lambda x: F.coalesce(x, F.lit(False))
    return rules(
        (sure(c("status") == "RUNNING") | (c("locked_by").isNotNull() & c("locked_at").isNotNull()), "ACTIVE_LEASE"),
        (sure((c("investigation") == "ACTIVE") & (c("deadline_at") <= c("now"))), "INVESTIGATION_DEADLINE_RISK"),
        (sure(c("step") == "RETRYING") & _says(c("failure"), OPERATIONAL), "OPERATIONAL_RETRY"),
        (sure((c("status") == "PENDING") & (c("run_after") > c("now"))), "PROVIDER_BACKOFF"),
        (sure((c("status") == "PENDING") & c("runnable")), "RUNNABLE_WAITING"),
        otherwise="UNKNOWN",
    )


def uncertain_lifecycle() -> Column:
    """D37. (scan_status, trading_status, enqueue) of wants_review, authority, status and family: review only for an ambiguity that serving may ask about."""
    row = lambda scan, trade, again: F.struct(F.lit(scan).alias("scan_status"), F.lit(trade).alias("trading_status"), F.lit(again).alias("enqueue"))
    ask = c("wants_review") & c("authority") & (c("status") == "ELIGIBLE") & (c("family") == "HUMAN_AMBIGUITY")
    return F.when(F.coalesce(ask, F.lit(False)), row("NEEDS_REVIEW", "NEEDS_REVIEW", False)).otherwise(row("ENRICHMENT_PENDING", "UNCERTAIN", True))


#: Actions that close gaps, what they resolve, their provider and review costs and milliseconds, and whether there is an adapter.
GAP_ACTIONS = (
    ("HYDRATE_CHANNEL_ABOUT", ("CHANNEL_METADATA_MISSING",), 1, 0, 1500, True),
    ("FETCH_RECENT_VIDEO_SAMPLE", ("RECENT_DOCUMENT_COVERAGE_INSUFFICIENT", "INDEPENDENCE_MISSING"), 101, 0, 3000, True),
    ("FETCH_TEMPORAL_VIDEO_SAMPLE", ("TEMPORAL_COVERAGE_INSUFFICIENT",), 202, 0, 6000, False),
    ("FETCH_VIDEO_DESCRIPTIONS", ("TRADING_HYPOTHESIS_AMBIGUOUS", "ALTERNATIVE_FOCUS_AMBIGUOUS"), 1, 0, 2500, True),
    ("FETCH_PLAYLIST_SAMPLE", ("RECENT_DOCUMENT_COVERAGE_INSUFFICIENT",), 100, 0, 4000, True),
    ("FETCH_TRANSCRIPT_EXCERPT", ("TRADING_HYPOTHESIS_AMBIGUOUS", "LANGUAGE_LOW_CONFIDENCE"), 1, 0, 4000, False),
    ("RESOLVE_LANGUAGE", ("LANGUAGE_UNSUPPORTED", "LANGUAGE_LOW_CONFIDENCE"), 0, 0, 2000, False),
    ("RESOLVE_ENTITY", ("IDENTITY_UNRESOLVED",), 0, 0, 2000, False),
    ("CLASSIFY_DOCUMENTS", ("TRADING_HYPOTHESIS_AMBIGUOUS",), 0, 0, 1000, False),
    ("ASSESS_CREATOR_FOCUS", ("ALTERNATIVE_FOCUS_AMBIGUOUS",), 0, 0, 1000, False),
    ("RETRY_PROVIDER", ("PROVIDER_TRANSIENT_FAILURE",), 0, 0, 3000, False),
    ("WAIT_FOR_QUOTA", ("QUOTA_DEFERRED",), 0, 0, 0, True),
    ("PREPARE_HUMAN_REVIEW", ("REVIEW_JUDGMENT_REQUIRED",), 0, 1, 0, True),
)
#: Fixed value: the utility of any action before its costs.
GAP_BENEFIT = 10 * 0.5 + 8 * 0.4 + 12 * 1 + 2 * 0.5 + 5 * 0.5 - 4 * 0.1


def gap_action() -> Column:
    """D42, L21. (action, score): the most useful feasible action that closes one of `gaps`; equals by name, null if none is feasible.

    Of gaps, provider_left, case_left, milliseconds_left and review_left.
    """
    ways = []
    for name, closes, provider, review, took, adapter in GAP_ACTIONS:
        score = GAP_BENEFIT - 0.025 * provider - 25 * review - 0.0002 * took
        fits = F.arrays_overlap("gaps", F.array(*map(F.lit, closes))) & (c("provider_left") >= provider) & (c("case_left") >= provider) & (c("milliseconds_left") >= took) & (c("review_left") >= review)
        ways.append(F.when(fits & F.lit(adapter), F.struct(F.lit(-score).alias("loss"), F.lit(name).alias("action"))))
    best = F.array_min(F.array_compact(F.array(*ways)))
    return F.when(best.isNotNull(), F.struct(best["action"].alias("action"), F.round(-best["loss"], 6).alias("score")))


def vitality(score: Column, days: Column) -> Column:
    """D43. (band, recheck_days, priority) of an activity score (null: 50) and the days since the last upload (null: none)."""
    s, d = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(score.cast("double"), F.lit(50.0)))), F.greatest(F.lit(0.0), F.coalesce(days.cast("double"), F.lit(float("inf"))))
    row = lambda band, again, plus: F.struct(F.lit(band).alias("band"), F.lit(again).alias("recheck_days"), F.lit(plus).alias("priority"))
    return F.when((s >= 70) & (d <= 90), row("HIGH", 14, 10)).when((s >= 35) & (d <= 365), row("MEDIUM", 30, 5)).otherwise(row("LOW", 90, 0))


#: Upper ends of raw confidence and what they are worth.
SEMANTIC_BINS = ((49, 35), (64, 50), (79, 64), (89, 75), (100, 84))


def semantic_confidence(raw: Column) -> Column:
    """D41. A model's confidence as the calibration has it; what is no number counts as 0."""
    x = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(raw.cast("double"), F.lit(0.0)), F.lit(0.0))))
    return reduce(lambda w, b: w.when(x <= b[0], b[1]), SEMANTIC_BINS[1:], F.when(x <= SEMANTIC_BINS[0][0], SEMANTIC_BINS[0][1]))


def invite_outcome(http: Column, relevant: Column) -> Column:
    """D45. What a checked invite is."""
    return rules((http == 404, "EXPIRED"), (http == 429, "RETRY"), (http >= 500, "RETRY"), (~relevant, "IRRELEVANT"), otherwise="VALID")


def rate_pressure(decision: Column, degraded: Column, documents: Column, families: Column, supported: Column, recent: Column, trade: Column) -> Column:
    """D27. A deferred candidate is withheld under pressure only if well evidenced and hopeless."""
    return F.when((decision == "DEFER") & degraded & (documents >= 10) & (families >= 3) & supported & recent & (trade < 0.05), "WITHHOLD").otherwise(decision)


def unanimous_share(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each key's most common value, its share, and a confidence lowered where votes are few."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("_n"))
    total = n.groupBy(*key).agg(F.sum("_n").alias("votes"))
    top = latest(n, key, [F.desc("_n"), F.asc(value)]).join(total, key)
    share = ratio("_n", "votes")
    return top.withColumn("share", F.round(share, 9)).withColumn("confidence", F.round(share * (1 - 1 / (1 + c("votes"))), 9)).drop("_n")
