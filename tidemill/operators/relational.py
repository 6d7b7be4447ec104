"""Filters, joins, set operations, windows and limits (P, J, K, U, W)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import collapse


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """W04, J04, U05, U06. The first row of each key in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth_of_key", F.row_number().over(w)).where("_nth_of_key = 1").drop("_nth_of_key")


def per_key(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """K08, S13. The first k rows of each key, numbered in place."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def operator_visible(creators: DataFrame, excluded: DataFrame, statuses: list[str]) -> DataFrame:
    """P01, P20, J09. Rows of the statuses whose normalised country is on no exclusion."""
    names = excluded.select(collapse("country").alias("_country"))
    return creators.where(F.col("status").isin(statuses)).withColumn("_country", collapse("country")).join(names, "_country", "left_anti").drop("_country")


def listing_filter(*, search: str | None = None, columns: tuple[str, ...] = (), low_audience: bool = False, audience: str = "audience", **equal: str) -> Column:
    """P02. A conjunction of what is asked: equalities other than ALL, a search over columns, and no low audiences unless asked."""
    parts = [F.col(k) == v for k, v in equal.items() if v not in (None, "ALL")]
    if search:
        parts.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{search}%") for c in columns]))
    if not low_audience:
        parts.append(F.coalesce(F.col(audience) != "SKIP", F.lit(True)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def serving_scope(mode: str, assigned: Column, projected: Column, legacy: Column) -> Column:
    """P03. Which of two predicates serves a row: the old one when OFF, by assignment when CANARY, the new one when ACTIVE."""
    return {"OFF": legacy, "ACTIVE": projected, "CANARY": (assigned & projected) | (~assigned & legacy)}[mode]


def complement(predicate: Column) -> Column:
    """P04. The rows that a predicate leaves out, those it is unknown for too."""
    return ~F.coalesce(predicate, F.lit(False))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """K01. One page in a total order, with the total of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def cooled_down(queries: DataFrame, runs: DataFrame, as_of, minutes: int = 360) -> DataFrame:
    """P06. Queries whose normalised text did not run in the window."""
    recent = runs.where(F.col("ran_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))).select(collapse("text").alias("_text")).distinct()
    return queries.withColumn("_text", collapse("text")).join(recent, "_text", "left_anti").drop("_text")


def limit_repeats(queries: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """P07. Queries whose primary term ran fewer than `most` times in runs."""
    used = runs.groupBy("primary_term").agg(F.count("*").alias("_used"))
    return queries.join(used, "primary_term", "left").where(F.coalesce("_used", F.lit(0)) < most).drop("_used")


def rotate_intent(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """P08. Queries of other intents than the newest run's, unless there is no other."""
    last = runs.agg(F.max_by("intent", F.struct("ran_at", "run_id")).alias("_last"))
    other = queries.join(F.broadcast(last), F.coalesce(F.col("intent") != F.col("_last"), F.lit(True)))
    return queries.join(F.broadcast(other.agg(F.count("*").alias("_n"), F.max("_last").alias("_last"))), F.lit(True)).where((F.col("_n") == 0) | F.col("_last").isNull() | (F.col("intent") != F.col("_last"))).drop("_n", "_last")


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tie: str) -> DataFrame:
    """J06. Adds the value of the newest right row of the key at or before the left row's time.

    Both sides in one sorted run per key, so no pairs are made; a key's rows are one window partition.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = right.select(key, F.col(value).alias("_v"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.withColumn("asof", F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w)["_v"])
    return out.where("_side = 1").drop("_v", "_t", "_side", "_tie").withColumnRenamed("asof", f"asof_{value}")


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, until, value: str) -> DataFrame:
    """J07. Adds the value of the first right row of the key at or after the left row's time and before `until`.

    The run of a key goes backwards: a frame from the current row to the end would be read again for every row.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"))
    b = right.where(F.col(right_time) < F.lit(until).cast("timestamp")).select(key, F.col(value).alias("_v"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.withColumn("_next", F.last(F.when(F.col("_side") == 1, F.struct("_v")), ignorenulls=True).over(w)["_v"])
    return out.where("_side = 0").drop("_v", "_t", "_side").withColumnRenamed("_next", f"next_{value}")


def jaccard(a: Column, b: Column) -> Column:
    """U02. 0 for two empty sets."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """U03. Share of a that b has; 0 for an empty a."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def by_precedence(df: DataFrame, key: list[str], outcome: str, precedence: dict[str, int], order: str) -> DataFrame:
    """U07. The row of each key with the highest precedence, the later of equals."""
    rank = F.create_map(*[F.lit(x) for kv in precedence.items() for x in kv])[F.col(outcome)]
    return latest(df.withColumn("_rank", F.coalesce(rank, F.lit(-1))), key, [F.desc("_rank"), F.desc(order)]).drop("_rank")


def keepers(df: DataFrame, key: list[str], order: list[Column], row_id: str) -> DataFrame:
    """W02, U09. Adds keeper_id, the first row of each key, and is_keeper."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("keeper_id", F.first(row_id).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("is_keeper", F.col("keeper_id") == F.col(row_id))


def merge_observations(df: DataFrame, key: str, lists: list[str], best: str) -> DataFrame:
    """U08. One row per canonical key: its lists' distinct union, sorted, how many there were, and the highest of best."""
    return df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists], F.count("*").alias("observations"), F.max(best).alias(best))


def disjoint_queues(df: DataFrame, first: list[Column], n: int, second: list[Column], m: int, key: str) -> DataFrame:
    """K03. n rows in one order, and m others in another."""
    a = df.orderBy(*first).limit(n).withColumn("queue", F.lit(1))
    b = df.join(F.broadcast(a.select(key)), key, "left_anti").orderBy(*second).limit(m).withColumn("queue", F.lit(2))
    return a.unionByName(b.select(a.columns))


def next_request(queue: DataFrame, as_of, starved_ms: int = 2000) -> DataFrame:
    """K04, R01. The head of a queue: manual, then starved, then priority, then age."""
    waited = (F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis("enqueued_at")) >= starved_ms
    return queue.orderBy(F.desc("manual"), F.desc(waited), F.desc("priority"), F.asc("sequence")).limit(1)


def first_free_slot(used: DataFrame, slots: int, slot: str = "slot") -> DataFrame:
    """J16. The lowest of 1 .. slots that is not used; null when all are."""
    every = used.sparkSession.range(1, slots + 1).select(F.col("id").alias(slot))
    return every.join(used.select(slot).distinct(), slot, "left_anti").agg(F.min(slot).alias("free_slot"))


def overlaps(df: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """J20. Rows whose half-open interval overlaps an earlier-starting one of the key, by a running maximum of ends: no pairs."""
    w = Window.partitionBy(key).orderBy(start, row_id).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(w)).where(F.col(start) < F.col("_reach")).drop("_reach")


def scoped(rows: DataFrame, rules: DataFrame, scope: str) -> DataFrame:
    """J17. Rows with the rules of their scope and those of all scopes (null): two equi-joins, not an OR."""
    wide = rules.where(F.col(scope).isNull()).drop(scope)
    return rows.join(rules.where(F.col(scope).isNotNull()), scope).unionByName(rows.join(F.broadcast(wide), F.lit(True)))


def by_dimension(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """J12, A09. A row for each dimension of each row: (dimension, value), nulls left out; columns of these names are replaced."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    keep = [c for c in df.columns if c not in ("dimension", "value")]
    return df.select(*keep, F.explode(pairs).alias("_d")).select(*keep, "_d.dimension", "_d.value").where("value IS NOT NULL")


def running_choice(selected: Column, order: Window) -> Column:
    """W06. 1, 2, ... over the chosen rows only."""
    return F.when(selected, F.sum(selected.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def apportion(df: DataFrame, group: list[str], weight: str, total: str, key: str) -> DataFrame:
    """A13, W01. Whole shares of a total by largest remainder: floors, then one more by fraction, then key."""
    w = Window.partitionBy(*group)
    sum_w = F.sum(weight).over(w)
    share = F.when((sum_w > 0) & (F.col(total) > 0), F.col(total) * F.col(weight) / sum_w).otherwise(F.lit(0.0))
    out = df.withColumn("_share", share).withColumn("_base", F.floor("_share"))
    out = out.withColumn("_left", F.when(F.col("_share") + F.lit(0) >= 0, F.col(total)) - F.sum("_base").over(w)).withColumn("_some", F.sum("_share").over(w) > 0)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_share") - F.col("_base"), 9)), key))
    out = out.withColumn("allocated", F.when(F.col("_some"), F.col("_base") + (rank <= F.col("_left")).cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.drop("_share", "_base", "_left", "_some")
