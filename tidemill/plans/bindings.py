"""The driver tables as the engine's entities, and the same expressions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: The outcome that each event type stands for.
OUTCOMES = {"purchase": "CONFIRMED", "signup": "NEEDS_REVIEW", "view": "UNCERTAIN", "click": "NON_TRADING", "error": "COUNTRY_REJECTED"}
EPOCH = "2024-01-01 00:00:00"


def creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """creator_id, name, country, region, segment, quality, status."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    status = F.when(F.col("c_custkey") % 5 == 0, "REVIEW").when(F.col("c_custkey") % 5 == 4, "REJECTED").otherwise("CONFIRMED")
    return out.select(F.col("c_custkey").alias("creator_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.pmod(F.abs(F.floor("c_acctbal")), F.lit(101)).alias("quality"), status.alias("status"))


CREATORS = """creators AS (
  SELECT c_custkey AS creator_id, c_name AS name, n_name AS country, r_name AS region, c_mktsegment AS segment,
         abs(CAST(floor(c_acctbal) AS BIGINT)) % 101 AS quality,
         CASE c_custkey % 5 WHEN 0 THEN 'REVIEW' WHEN 4 THEN 'REJECTED' ELSE 'CONFIRMED' END AS status
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def outcome(c: str = "event_type") -> Column:
    return F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])[F.col(c)]


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, creator_id, run_id, rank, page, was_known, persisted, outcome, quality, has_community."""
    e = table(spark, sf_dir, "events")
    sizes = e.agg(F.countDistinct("user_id").alias("u"), F.count("*").alias("n")).crossJoin(table(spark, sf_dir, "customer").agg(F.count("*").alias("c")))
    e = e.crossJoin(F.broadcast(sizes))  # one row
    e = e.withColumn("creator_id", (F.col("user_id") + F.col("u") * F.floor(F.col("event_id") * 10 / F.col("n"))) % F.col("c"))
    e = e.withColumn("run_id", F.floor((F.unix_micros("ts") / 1e6 - F.unix_micros(F.lit(EPOCH).cast("timestamp")) / 1e6) / 21600))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    known = F.min("run_id").over(Window.partitionBy("creator_id")) < F.col("run_id")
    e = e.withColumns({"rank": rank, "was_known": known, "outcome": outcome(), "quality": F.least(F.lit(100), F.floor("value"))})
    e = e.withColumns({"page": (F.floor((F.col("rank") - 1) / 10) + 1).cast("long"), "persisted": F.col("outcome") != "COUNTRY_REJECTED", "has_community": F.col("event_id") % 4 == 0, "neighborhood": F.pmod("run_id", F.lit(5))})
    return e.select("event_id", "ts", "user_id", "value", "creator_id", "run_id", "neighborhood", "rank", "page", "was_known", "persisted", "outcome", "quality", "has_community", "props")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items())
SIGHTINGS = f"""sizes AS (
  SELECT count(DISTINCT user_id) AS u, count(*) AS n, (SELECT count(*) FROM customer) AS c FROM events
), bound AS (
  SELECT events.*, (user_id + u * CAST(floor(event_id * 10 / n) AS BIGINT)) % c AS creator_id,
         CAST(floor((epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '{EPOCH}') / 1e6) / 21600) AS BIGINT) AS run_id FROM events, sizes
), sighted AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS rank, min(run_id) OVER (PARTITION BY creator_id) < run_id AS was_known,
         CASE event_type {_CASES} END AS outcome, least(100, CAST(floor(value) AS BIGINT)) AS quality FROM bound
), sightings AS (
  SELECT event_id, ts, user_id, value, creator_id, run_id, run_id % 5 AS neighborhood, rank, CAST(floor((rank - 1) / 10) + 1 AS BIGINT) AS page, was_known,
         outcome <> 'COUNTRY_REJECTED' AS persisted, outcome, quality, event_id % 4 = 0 AS has_community, props FROM sighted
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sighting of each creator in each run."""
    from ..operators.relational import latest

    return latest(sightings(spark, sf_dir), ["run_id", "creator_id"], [F.asc("rank")])


FIRSTS = """firsts AS (
  SELECT * FROM sightings QUALIFY row_number() OVER (PARTITION BY run_id, creator_id ORDER BY rank) = 1
)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled decisions: key, truth, predicted, score, inclusion_bp, segment."""
    from ..functions.hashing import bucket

    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    score = (F.col("doc_id") * 37 % 101) / 100.0
    predicted = F.when(score >= 0.6, "POSITIVE").when(score <= 0.3, "NEGATIVE").otherwise("UNCERTAIN")
    bp = F.lit(2500) * (1 + bucket(F.concat(F.lit("inclusion|"), F.col("doc_id").cast("string")), 4))
    return d.select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("truth"), predicted.alias("predicted"), F.least(F.lit(1.0), score).alias("score"), bp.cast("int").alias("inclusion_bp"), F.col("lang").alias("segment"), "toxic")


HEX8 = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT)"
EXAMPLES = f"""examples AS (
  SELECT doc_id AS key, quality = 1 AS truth, CASE WHEN doc_id * 37 % 101 / 100.0 >= 0.6 THEN 'POSITIVE' WHEN doc_id * 37 % 101 / 100.0 <= 0.3 THEN 'NEGATIVE' ELSE 'UNCERTAIN' END AS predicted,
         CAST(least(1.0, doc_id * 37 % 101 / 100.0) AS DOUBLE) AS score, 2500 * (1 + {HEX8.format("'inclusion|' || doc_id")} % 4) AS inclusion_bp, lang AS segment, toxic
  FROM documents JOIN labels USING (doc_id)
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, family, confidence_bp, valid_from, valid_until, observed_at, assertion."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return e.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("from_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("to_id"),
        F.col("l_returnflag").alias("family"),
        (F.lit(8000) + F.col("l_linenumber") * 200).alias("confidence_bp"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("valid_until"),
        F.col("l_shipdate").alias("observed_at"),
        F.when(F.col("l_linestatus") == "O", "ASSERTED").otherwise(F.when(F.col("l_quantity") > 45, "RETRACTED").otherwise("ASSERTED")).alias("assertion"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("edge_id"),
    )


EDGES = """edges AS (
  SELECT 'S' || l_suppkey AS from_id, 'P' || l_partkey AS to_id, l_returnflag AS family, 8000 + l_linenumber * 200 AS confidence_bp, o_orderdate AS valid_from,
         CASE WHEN l_linenumber % 3 = 0 THEN o_orderdate + INTERVAL 900 DAY END AS valid_until, l_shipdate AS observed_at,
         CASE WHEN l_linestatus = 'O' THEN 'ASSERTED' WHEN l_quantity > 45 THEN 'RETRACTED' ELSE 'ASSERTED' END AS assertion,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio actions of orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("action_id"), F.col("o_orderpriority").alias("program_id"), F.col("o_orderstatus").alias("action_type"), (F.col("o_custkey") % 7).cast("double").alias("priority"), F.col("o_totalprice").alias("expected_reward"), (1 + F.col("o_custkey") % 3).cast("long").alias("provider_cost"), (F.col("o_custkey") % 2).cast("long").alias("review_cost"), F.col("o_custkey") % 50, F.col("o_orderdate").alias("created_at")).withColumnRenamed("(o_custkey % 50)", "cluster_key")


ACTIONS = """actions AS (
  SELECT o_orderkey AS action_id, o_orderpriority AS program_id, o_orderstatus AS action_type, CAST(o_custkey % 7 AS DOUBLE) AS priority, o_totalprice AS expected_reward,
         1 + o_custkey % 3 AS provider_cost, o_custkey % 2 AS review_cost, o_custkey % 50 AS cluster_key, o_orderdate AS created_at FROM orders
)"""


def sql(*parts: str, query: str) -> str:
    """A WITH statement of bound entities and one query."""
    return f"WITH {', '.join(parts)}\n{query}" if parts else query
