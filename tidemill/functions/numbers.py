"""Rounding, ratios, intervals and decay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of all intervals here.
Z = 1.96


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def js_round(x, digits: int = 0) -> Column:
    """Halves round up, also below zero: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / scale


def clamp(x, low, high) -> Column:
    return F.greatest(col(low).cast("double"), F.least(col(high).cast("double"), col(x).cast("double")))


def clamp01(x) -> Column:
    return clamp(x, 0.0, 1.0)


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b.isNull() | (b == 0), F.lit(0.0)).otherwise(a / b)


def wilson_proportion(p, n, z: float = Z) -> Column:
    """(lower, upper) of a proportion p of an effective total n; null without p or total."""
    p, n = col(p).cast("double"), col(n).cast("double")
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / d
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - margin).alias("lower"), F.least(F.lit(1.0), centre + margin).alias("upper")))


def wilson(successes, total, z: float = Z) -> Column:
    return wilson_proportion(col(successes).cast("double") / F.nullif(col(total).cast("double"), F.lit(0.0)), total, z)


def effective_size(sum_w, sum_w2) -> Column:
    """Kish's effective sample size."""
    return F.when(col(sum_w2) > 0, col(sum_w) * col(sum_w) / col(sum_w2)).otherwise(F.lit(0.0))


def propensity_weight(basis_points) -> Column:
    """10000 / bp, null unless 0 < bp <= 10000."""
    bp = col(basis_points)
    return F.when((bp > 0) & (bp <= 10000), 10000.0 / bp)


def age_days(then, now) -> Column:
    """M03."""
    return (F.unix_micros(col(now)) - F.unix_micros(col(then))) / 86_400_000_000.0


def half_life(age, days: float = 90.0) -> Column:
    """0.5 ^ (age / days); ages below 0 count as 0."""
    return F.pow(F.lit(0.5), F.greatest(col(age), F.lit(0.0)) / days)


def exponential(age, days: float = 730.0) -> Column:
    return F.exp(-F.greatest(col(age), F.lit(0.0)) / days)


def calibrate_decision(n) -> Column:
    """Piecewise map of a raw score 0-100 to a rounded probability in percent."""
    n = col(n)
    return js_round(F.when(n < 25, 0.8 * n).when(n < 50, 20 + 0.9 * (n - 25)).when(n < 65, 43 + 0.8 * (n - 50)).when(n < 80, 55 + 1.4 * (n - 65)).otherwise(F.least(F.lit(96.0), 76 + n - 80)))


def observed_value(relevant, quality, coverage, information, frontier, uncertainty, quota, review, redundancy) -> Column:
    """Marginal value of a neighborhood from what was observed, one decimal."""
    part = lambda w, x: F.least(F.lit(100.0), w * col(x))
    total = part(25, relevant) + part(35, quality) + part(20, coverage) + part(15, information) + part(20, frontier) + part(10, uncertainty) - 5 * col(quota) / 100 - 8 * col(review) - 30 * col(redundancy)
    return js_round(F.greatest(F.lit(0.0), total), 1)


def expected_value(n, relevant, quality, overlap, quota) -> Column:
    """Expected marginal value from the averages of n earlier observations; 0 without any."""
    r, q, o = col(relevant), col(quality), col(overlap)
    return F.when(col(n) == 0, F.lit(0.0)).otherwise(observed_value(2 * r, 1.5 * q, r, q, F.greatest(F.lit(0.0), 1 - o), F.lit(0.0), quota, F.lit(0.0), o))


def utility(benefits: dict[str, float], costs: dict[str, float], violated: list[Column]) -> Column:
    """Weighted benefits less weighted costs; null if any constraint is violated."""
    total = reduce(lambda a, b: a + b, [w * F.col(c) for c, w in benefits.items()]) - reduce(lambda a, b: a + b, [w * F.col(c) for c, w in costs.items()])
    bad = reduce(lambda a, b: a | b, [F.coalesce(v, F.lit(False)) for v in violated], F.lit(False))
    return F.when(~bad, total)


def frontier_score(gains: list, cost) -> Column:
    """Sum of gains per unit of cost."""
    return reduce(lambda a, b: a + b, [col(g) for g in gains]) / F.greatest(F.lit(1.0), col(cost).cast("double"))


def action_utility(weights: dict[str, float]) -> Column:
    """Weighted gains less weighted costs and risk of a discovery action."""
    risk = F.least(F.lit(1.0), F.col("depth") / 3 + F.when(F.col("families") < 2, 0.3).otherwise(0.0))
    gain = sum(weights[k] * F.col(k) for k in ("incremental", "information", "coverage", "uncertainty")) + weights["freshness"] * F.greatest(F.lit(0.0), F.coalesce("freshness", F.lit(0.0)))
    return gain - weights["provider_cost"] * F.col("provider_cost") - weights["review_cost"] * F.col("review_cost") - weights["overlap"] * F.col("overlap") - weights["risk"] * risk


def planner_utility(incremental, coverage, novelty, uncertainty, provider_cost, review_cost) -> Column:
    """4i + 2c + 2n + u - 0.01p - 0.5r, six decimals."""
    return js_round(4 * col(incremental) + 2 * col(coverage) + 2 * col(novelty) + col(uncertainty) - 0.01 * col(provider_cost) - 0.5 * col(review_cost), 6)


def creator_frontier(recency_days, uploads, evidence, authority, community, uncertainty) -> Column:
    """Frontier score and disposition of a creator."""
    d, e = col(recency_days), col(evidence)
    recency = F.when(d <= 30, 1.0).when(d <= 90, 0.75).when(d <= 180, 0.4).when(d <= 365, 0.15).otherwise(0.0)
    enough = F.when(e >= 2, 1.0).when(e >= 1, 0.45).otherwise(0.0)
    score = js_round(0.25 * recency + 0.2 * clamp01(col(uploads) / 8) + 0.25 * enough + 0.1 * col(authority) + 0.1 * col(community) + 0.1 * col(uncertainty), 4)
    return F.struct(score.alias("score"), F.when(score >= 0.65, "PRIORITIZE").when(score >= 0.3, "EXPLORE").otherwise("DEFER").alias("disposition"))


#: Reward of each outcome of a review.
OUTCOME_REWARDS = {"HUMAN_ACCEPTED": 1.0, "ADMITTED": 0.6, "UNRESOLVED": 0.0, "WITHHELD": -0.35, "HUMAN_REJECTED": -1.0}


def outcome_reward(outcome, randomized, propensity) -> Column:
    """Reward of an outcome, and whether it may be learned from."""
    table = F.create_map(*[F.lit(x) for kv in OUTCOME_REWARDS.items() for x in kv])
    p = col(propensity)
    return F.struct(F.coalesce(table[col(outcome)], F.lit(0.0)).alias("reward"), F.coalesce(col(randomized) | ((p > 0) & (p <= 1)), F.lit(False)).alias("eligible"))


def capacity(batch, target_depth, depth) -> Column:
    """How many jobs may be added: a batch, or what room the queue has, never below 0."""
    whole = lambda x: F.greatest(F.lit(0), F.floor(x)).cast("long")
    return F.least(whole(col(batch)), whole(col(target_depth) - col(depth)))
