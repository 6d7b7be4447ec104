"""Graphs of relationships with validity, and lineage."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .relational import latest

c = F.col


def active_edges(edges: DataFrame, as_of) -> DataFrame:
    """G01. Edges valid and observed at a time, the newest of each (from, to, family), retracted ones gone."""
    at = F.lit(as_of).cast("timestamp")
    known = edges.where((c("valid_from") <= at) & (c("valid_until").isNull() | (c("valid_until") > at)) & (F.coalesce("observed_at", "valid_from") <= at))
    return latest(known, ["from_id", "to_id", "family"], [F.desc("observed_at"), F.asc("edge_id")]).where("assertion = 'ASSERTED'")


def _arcs(good: DataFrame, fan_out: int, hub: int) -> DataFrame:
    """What each entity expands to, in its order (place): a hub's first edges by confidence, else its first targets by id."""
    degree = good.groupBy("from_id").agg(F.count("*").alias("degree"))
    hubs, rest = degree.where(c("degree") > hub).select("from_id"), degree.where(c("degree") <= hub).select("from_id")
    facts = [F.countDistinct("family").alias("families"), F.max("confidence_bp").alias("confidence"), F.max("valid_from").alias("newest")]
    first = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("from_id").orderBy(*order))).where(c("place") <= fan_out)
    plain = first(good.join(rest, "from_id", "left_semi").groupBy("from_id", "to_id").agg(*facts), "to_id")
    capped = first(good.join(hubs, "from_id", "left_semi"), F.desc("confidence_bp"), "to_id")
    capped = capped.groupBy("from_id", "to_id").agg(F.min("place").alias("place"), F.lit(1).cast("long").alias("families"), F.max("confidence_bp").alias("confidence"), F.max("valid_from").alias("newest"))
    return plain.withColumn("hub", F.lit(False)).unionByName(capped.withColumn("hub", F.lit(True)))


def bounded_frontier(seeds: DataFrame, active: DataFrame, as_of, *, least_bp: int = 8000, depth: int = 2, fan_out: int = 10, hub: int = 100, component: int = 100, fresh_days: int = 365, families: int = 1) -> DataFrame:
    """G02. Entities within `depth` of seeds: entity_id, parent_id, depth, path, families, score, disposition.

    Level by level, in order of path: the first way to an entity counts, and only ELIGIBLE ones go on, so a level after
    the first has at most `component` of them. A hub (more than `hub` edges) gives HUB_CAPPED targets only, and the last hub that
    reaches an entity has it. Once `component` entities are found, others are COMPONENT_CAPPED. Only eligible ones score.
    Each level is written in the shared folder. Ids are ordered by their bytes.
    """
    spark = seeds.sparkSession
    base = f"{shared_folder(spark)}/frontier-{uuid.uuid4().hex}"
    old = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(fresh_days))
    start = seeds.select(c("entity_id").alias("from_id")).distinct()
    known = start.select(c("from_id").alias("to_id"))
    arcs = _arcs(active.where(c("confidence_bp") >= least_bp), fan_out, hub)
    level = start.withColumn("path", F.array("from_id"))
    found, hit = [], []
    for d in range(1, depth + 1):
        step = arcs.join(level, "from_id").join(known, "to_id", "left_anti")
        step = step.withColumns({"depth": F.lit(d), "path": F.concat("path", F.array("to_id")), "way": F.struct("path", "place")})
        step.write.parquet(f"{base}/{d}/steps")
        step = spark.read.schema(step.schema).parquet(f"{base}/{d}/steps")
        hit.append(step.where("hub"))
        first = step
        count = 0
        if found:
            first = step.join(found[-1].select("to_id"), "to_id", "left_anti")
            count = found[-1].count()
        first = latest(first, ["to_id"], [F.asc("way")])
        early = first.orderBy("way").limit(max(0, component - count)).select("to_id", F.lit(True).alias("early"))
        kind = F.when(c("hub"), "HUB_CAPPED").when(c("newest") < old, "STALE").when(c("families") < families, "INSUFFICIENT_INDEPENDENCE").when(c("early").isNull(), "COMPONENT_CAPPED").otherwise("ELIGIBLE")
        first = first.join(early, "to_id", "left").withColumn("disposition", kind).drop("early")
        first.write.parquet(f"{base}/{d}/found")
        paths = [f"{base}/{k}/found" for k in range(1, d + 1)]
        found.append(spark.read.schema(first.schema).parquet(*paths))
        level = found[-1].where((c("depth") == d) & (c("disposition") == "ELIGIBLE")).select(c("to_id").alias("from_id"), "path")
    hubs = latest(reduce(DataFrame.unionByName, hit), ["to_id"], [F.desc("depth"), F.desc("way")])
    taken = hubs.select("to_id", F.struct(c("from_id"), c("depth"), c("path")).alias("h"))
    out = found[-1].join(taken, "to_id", "left")
    own = lambda x: F.coalesce(c(f"h.{x}"), c(x)).alias(x)
    last = F.when(c("h").isNotNull(), "HUB_CAPPED").otherwise(c("disposition"))
    score = F.when(last == "ELIGIBLE", F.floor(c("confidence") / c("depth") + 0.5)).otherwise(0).cast("long")
    return out.select(c("to_id").alias("entity_id"), own("from_id").alias("parent_id"), own("depth"), F.array_join(own("path"), ">").alias("path"), F.when(c("h").isNotNull(), 1).otherwise(c("families")).cast("long").alias("families"), last.alias("disposition"), score.alias("score"))


def closure(links: DataFrame, most: int | None = None) -> DataFrame:
    """G04, G03. (ancestor, descendant, depth) of a parent table, by joining paths to links; no pair twice.

    Goes on until a level adds nothing, or for `most` levels if given. A pair (x, x) is a cycle. Each level is
    written in the shared folder, so plans do not grow with depth.
    """
    spark = links.sparkSession
    at = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    fresh = links.select(c("parent").alias("ancestor"), c("child").alias("descendant")).distinct().withColumn("depth", F.lit(1))
    paths = []
    for d in count(1):
        paths.append(f"{at}/{d}")
        fresh.write.parquet(paths[-1])
        step, last, out = (spark.read.schema(fresh.schema).parquet(*x) for x in (paths[:1], paths[-1:], paths))
        if d == most or last.isEmpty():
            return out
        step = step.select(c("ancestor").alias("_mid"), "descendant")
        longer = last.select("ancestor", c("descendant").alias("_mid")).join(step, "_mid").select("ancestor", "descendant").distinct().alias("l")
        seen = [c(f"l.{x}").eqNullSafe(c(f"o.{x}")) for x in ("ancestor", "descendant")]
        fresh = longer.join(out.alias("o"), seen, "left_anti").withColumn("depth", F.lit(d + 1))


def cyclic(links: DataFrame, most: int | None = None) -> DataFrame:
    """G03. Nodes that reach themselves, by at most `most` links if given."""
    return closure(links, most).where("ancestor = descendant").select(c("ancestor").alias("node")).distinct()


def resolve_lineage(children: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """G05. A child's parent if just one candidate matches its key, else AMBIGUOUS or UNRESOLVED."""
    g = candidates.groupBy(key).agg(F.countDistinct("parent").alias("_n"), F.min("parent").alias("_p"))
    out = children.join(g, key, "left")
    return out.withColumn("parent", F.when(c("_n") == 1, c("_p"))).withColumn("resolution", F.when(c("_n") == 1, "RESOLVED").when(c("_n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")).drop("_n", "_p")


def sealed(frontier: DataFrame, key: list[str]) -> DataFrame:
    """G06, U10. A digest of a snapshot that does not depend on row order: count, and sum and xor of 60 bits of sha256 of each row.

    A row is its values by column name, as strings, each ended by U+001F, null as U+0000.
    """
    row = F.concat(*[F.concat(F.coalesce(c(x).cast("string"), F.lit("\0")), F.lit("\x1f")) for x in sorted(frontier.columns)])
    g = frontier.withColumn("_h", F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("long"))
    g = g.groupBy(*key) if key else g.groupBy()
    return g.agg(F.count("*").alias("rows"), F.sum(c("_h").cast("decimal(38,0)")).cast("string").alias("digest"), F.bit_xor("_h").alias("parity"))
