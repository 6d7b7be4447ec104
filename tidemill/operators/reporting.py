"""Reports and table changes of the operator views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import rules
from .relational import by_dimension, latest

c = F.col


def report_line(creator, decision, score, positives, negatives) -> Column:
    """S20. One line of an evidence report."""
    return F.format_string("%s: %s (%.0f) - %s for, %s against", c(creator), c(decision), c(score).cast("double"), F.coalesce(F.nullif(F.array_join(positives, ", "), F.lit("")), F.lit("nothing")), F.coalesce(F.nullif(F.array_join(negatives, ", "), F.lit("")), F.lit("nothing")))


def is_quality(outcome, score, least: int = 55) -> Column:
    """P11. Confirmed and of that score at least."""
    return F.coalesce((c(outcome) == "CONFIRMED") & (c(score) >= least), F.lit(False))


def stale_document(kind, published, as_of, most_days: int = 730) -> Column:
    """P12. A video older than that; 0 days switches it off."""
    if most_days == 0:
        return F.lit(False)
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(c(published))) / 86_400_000_000
    return F.coalesce((c(kind) == "VIDEO") & (age > most_days), F.lit(False))


def safe_payload(payload, most_bytes: int = 20_000, banned: str = r"(?i)token|secret|password|authorization|cookie") -> Column:
    """P15. A map payload that is small and has no key of a banned kind."""
    return F.coalesce((F.octet_length(F.to_json(payload)) <= most_bytes) & ~F.exists(F.map_keys(payload), lambda k: k.rlike(banned)), F.lit(False))


#: States that nothing follows.
TERMINAL = ("COMPLETED", "REJECTED", "FAILED", "DUPLICATE", "EXCLUDED")


def is_terminal(state) -> Column:
    """P21."""
    return F.coalesce(c(state).isin(*TERMINAL), F.lit(False))


def record(df: DataFrame, defaults: dict[str, object], payload: str | None = None, schema: str | None = None) -> DataFrame:
    """P23. Rows as records: nulls of named columns replaced, a JSON column parsed, broken JSON as null."""
    out = df.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in defaults.items()})
    return out.withColumn(payload, F.from_json(payload, schema)) if payload and schema else out


def with_aggregate(rows: DataFrame, other: DataFrame, key: list[str], **aggregates: Column) -> DataFrame:
    """J02, J05, J13. Rows with aggregates of another table by key: aggregated first, then joined, never per row."""
    return rows.join(other.groupBy(*key).agg(*[v.alias(k) for k, v in aggregates.items()]), key, "left")


def latest_of_all(rows: DataFrame, key: str, tables: dict[str, tuple[DataFrame, list[Column], str]]) -> DataFrame:
    """J01, J03, J04, L11. Rows with the newest value of each of several tables: one window each, then equi-joins on the key."""
    for name, (df, order, value) in tables.items():
        rows = rows.join(latest(df, [key], order).select(key, c(value).alias(name)), key, "left")
    return rows


def having(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """J08, J18. Rows whose key the other table has, each once."""
    return rows.join(other.select(key), key, "left_semi")


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """J10. Rows beside a table of one row."""
    return rows.crossJoin(F.broadcast(one.limit(1)))


def with_previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """J19. Rows with the value of the page before, by a window and not a self-join."""
    return rows.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def update_from(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J21. target with columns replaced where changes (one per key) have the key, nulls in changes too."""
    new = changes.select(key, F.lit(True).alias("_hit"), *[c(x).alias(f"_{x}") for x in columns])
    out = target.join(new, key, "left")
    return out.select(*[F.when(c("_hit"), c(f"_{x}")).otherwise(c(x)).alias(x) if x in columns else c(x) for x in target.columns])


def delete_using(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """J21. target without the keys of gone."""
    return target.join(gone.select(key), key, "left_anti")


def admission_baseline(rows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """A45, A72. Counts of every report in one pass: (dimension, value, n, positive). groups: name -> column; array columns count each element."""
    kinds = dict(rows.dtypes)
    pairs = [_pairs(name, col, kinds[col].startswith("array")) for name, col in groups.items()]
    out = rows.select("positive", F.explode(F.flatten(F.array(*pairs))).alias("p")).select("positive", c("p.d").alias("dimension"), c("p.v").alias("value"))
    return out.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if("positive").alias("positive"))


def _pairs(name: str, col: str, many: bool) -> Column:
    one = lambda v: F.struct(F.lit(name).alias("d"), v.cast("string").alias("v"))
    return F.transform(F.coalesce(c(col), F.array()), one) if many else F.array(one(c(col)))


def visible_counterfactual(rows: DataFrame, key: str, order: list[Column], weight: Column) -> DataFrame:
    """A71, A44. Weighted share of what a policy would withhold of the newest visible row of each key, positives and others apart."""
    now = latest(rows, [key], order).where("visible").withColumn("_w", weight)
    return now.groupBy("truth").agg(F.count("*").alias("n"), F.round(F.sum("_w"), 6).alias("weight"), F.round(F.sum(F.when(c("withheld"), c("_w")).otherwise(0.0)) / F.sum("_w"), 9).alias("withheld_share"))


def counted_latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """W03, W05. The newest row of each key with how many there were."""
    n = F.count("*").over(Window.partitionBy(key))
    return latest(rows.withColumn("observations", n), [key], order)


def by_deadline(rows: DataFrame, deadline: str, tie: str, n: int) -> DataFrame:
    """K02. The first n by deadline, those without one last."""
    return rows.orderBy(F.asc_nulls_last(deadline), tie).limit(n)


def ranked_surfaces(rows: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """K06. Surfaces of each key by score, equals in their listed order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), place)))


def together(*frames: DataFrame) -> DataFrame:
    """U01. All rows of frames of different columns, by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def canonical_country(x, aliases: dict[str, str]) -> Column:
    """T16. The country that a name or alias stands for; an unknown name as it is."""
    key = F.lower(F.trim(c(x)))
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in (kv[0].lower(), kv[1])])
    return F.coalesce(table[key], F.initcap(key))


def external_identity(url, hosts: dict[str, str]) -> Column:
    """D22. What an address identifies: the kind of its host, a website, or nothing."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c(url), r"^https?://([^/?#:]+)", 1)), r"^(www|m)\.", "")
    kind = reduce(lambda w, kv: w.when((host == kv[0]) | host.endswith("." + kv[0]), kv[1]), hosts.items(), F.when(host == "", "NONE"))
    return kind.otherwise("WEBSITE")


def organic_queries(rows: DataFrame, least: int, known: DataFrame) -> DataFrame:
    """D28. New query texts with enough support, the best supported of each, known ones left out."""
    own = latest(rows.where(c("support") >= least), ["text"], [F.desc("support"), F.asc("source")])
    return own.join(known.select("text"), "text", "left_anti")


def episodes(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """R11. Sessions: events of a key no further apart than a gap."""
    g = events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return g.select(key, c("s.start").alias("started_at"), "events")


def lease(locks: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """R17. Which request gets each lock: the first, if the lock is free or its lease is over."""
    first = latest(requests, ["lock"], [F.asc("requested_at"), F.asc("owner")])
    at = F.lit(as_of).cast("timestamp")
    out = first.join(locks.select("lock", c("owner").alias("_holder"), "until"), "lock", "left")
    free = c("until").isNull() | (c("until") <= at) | (c("_holder") == c("owner"))
    return out.select("lock", "owner", F.when(free, "ACQUIRED").otherwise("HELD").alias("result"))


def trace(events: DataFrame, key: str) -> DataFrame:
    """R23. Progress of each session: stages seen, the last of them, counts and whether it ended."""
    return events.groupBy(key).agg(F.countDistinct("stage").alias("stages"), F.max_by("stage", F.struct("ts", "event_id")).alias("last_stage"), F.count("*").alias("events"), F.max(c("stage").isin("purchase", "error")).alias("ended"))


def stage_summary(rows: DataFrame, dimensions: list[str], ready: Column) -> DataFrame:
    """A72. Ready and not ready rows of each value of each dimension."""
    return by_dimension(rows.withColumn("_ready", ready), dimensions).groupBy("dimension", "value").agg(F.count_if("_ready").alias("ready"), F.count_if(~c("_ready")).alias("waiting"))


def lock_state(until, as_of) -> Column:
    """R17. FREE, HELD or EXPIRED at a time."""
    at = F.lit(as_of).cast("timestamp")
    return rules((c(until).isNull(), "FREE"), (c(until) > at, "HELD"), otherwise="EXPIRED")


def projected(ledger: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """R19. What an insert trigger would keep of each key: the last value that is not null of each column."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ledger.select(key, *[F.last(x, ignorenulls=True).over(w).alias(x) for x in columns], F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))).alias("_n"))
    return out.where("_n = 1").drop("_n")
