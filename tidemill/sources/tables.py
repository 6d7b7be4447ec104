"""Reading tables and records, and writing as ledgers and upserts do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S01. A table of a folder; filters and columns reach the Parquet scan. Times without a zone are read as UTC."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in found.schema):
        return found
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """S02. Rows of one key, by a predicate that the scan can use."""
    return df.where(F.col(key) == F.lit(value))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S10. JSON records under a given schema; malformed ones give nulls, not a failure."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def imported(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """S09. Any source that Spark reads, as a frame to write as Parquet."""
    return spark.read.format(kind).options(**options).load(path)


def insert_new(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """S05, S07. What an insert that ignores known keys appends: the first row of each key that target lacks."""
    fresh = rows.join(target.select(*key), key, "left_anti")
    return latest(fresh, key, order)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """S06. target after rows (one per key) are merged in. Rules by column: last, coalesce, greatest, least, union."""
    old, new = target.alias("o"), rows.alias("n")
    both = old.join(new, key, "full_outer")

    def merged(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        rule = rules.get(c, "last")
        if rule == "coalesce":
            return F.coalesce(a, b)
        if rule in ("greatest", "least"):
            return F.greatest(a, b) if rule == "greatest" else F.least(a, b)
        if rule == "union":
            return F.array_distinct(F.concat(F.coalesce(a, F.array().cast(target.schema[c].dataType)), F.coalesce(b, F.array().cast(target.schema[c].dataType))))
        return F.coalesce(b, a)

    return both.select(*key, *[merged(c).alias(c) for c in target.columns if c not in key])


def retention(rows: DataFrame, as_of, keep_days: int = 365) -> DataFrame:
    """S08. Adds disposition RETAINED, EXPIRED or DELETED, and nulls the excerpt of all but the retained; keys stay."""
    expired = F.col("observed_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(keep_days))
    out = rows.withColumn("disposition", F.when(F.col("deleted"), "DELETED").when(expired, "EXPIRED").otherwise("RETAINED"))
    return out.withColumn("excerpt", F.when(F.col("disposition") == "RETAINED", F.col("excerpt")))


def append_audit(events: DataFrame, path: str) -> None:
    """S18. Append to a ledger that nothing rewrites."""
    events.write.mode("append").parquet(path)


def audit(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """S18, P24. The newest events, 1 to 500 of them."""
    return spark.read.parquet(path).orderBy(F.desc("at"), F.desc("event_id")).limit(max(1, min(500, n)))


def outbox_pending(outbox: DataFrame, completed: DataFrame, as_of, stale_minutes: int = 15) -> DataFrame:
    """S19, R14. Outbox rows with no completion, with whether they are stale."""
    left = outbox.join(completed.select("observation_key"), "observation_key", "left_anti")
    return left.withColumn("stale", F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(stale_minutes)))


def data_quality(df: DataFrame, unique: list[str], not_null: list[str]) -> DataFrame:
    """Violations of the constraints that a ledger relies on: (check, violations)."""
    copies = df.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(f"unique({','.join(unique)})").alias("check"), "violations")
    nulls = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).unpivot([], not_null, "check", "violations")
    return copies.unionByName(nulls.select(F.concat(F.lit("not_null("), "check", F.lit(")")).alias("check"), "violations"))


def numbered_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """W11. revision: 1, 2, ... of each key in order."""
    return df.withColumn("revision", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
