"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch

#: Rows of one key, and links of a round, that are never worth dealing apart.
LIGHT, FEW = 500, 20_000


def dealt_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed on key, where keyed is a written table with one row a key and n, the rows of that key.

    A key with more rows than the mean of a task, total / shuffle partitions, is joined where its rows are,
    against a broadcast of such keys; there are fewer of them than shuffle partitions. The rest is shuffled.
    """
    total, top = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(LIGHT, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy, rest = keyed.where(F.col("n") > most).drop("n"), keyed.drop("n")
    if top <= most:
        return rows.join(rest, key, how)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _lowest(edges: DataFrame) -> DataFrame:
    """(a, lowest, n): each node's smallest neighbour and the number of its edges."""
    return edges.groupBy("a").agg(F.min("b").alias("lowest"), F.count("*").alias("n"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of any direction -> (node, root): every linked node and the smallest node it reaches.

    Self links and repeats do no harm; no links give no rows. Each round is two aggregations that
    combine before the shuffle and two joins that deal a hub's edges over tasks, so no node's neighbours meet in one group.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = materialise(edges, "links")
    state = _state(edges)
    while state[0]:
        with scratch() as keep:
            many = state[0] > FEW
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = _lowest(both).withColumn("lowest", F.least("a", "lowest"))
            large = dealt_join(both, keep(materialise(low, "lowest")), "a") if many else both.join(low, "a")
            large = large.where("b > a").select(F.col("b").alias("a"), F.col("lowest").alias("b")).where("a > b").distinct()
            if many:
                large = keep(materialise(large, "large"))
                joined = dealt_join(large, keep(materialise(_lowest(large), "lowest")), "a")
            else:
                joined = large.join(_lowest(large), "a")
            small = joined.select(F.explode(F.array(F.struct("a", F.col("lowest").alias("b")), F.struct(F.col("b").alias("a"), F.col("lowest").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
            last, edges = edges, materialise(small, "links")
            discard(last)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
