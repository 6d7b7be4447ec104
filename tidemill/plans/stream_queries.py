"""Queries that run as streams over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import jobs as J
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def s01_stream_dedup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = J.event_stream(spark, sf_dir)
    return J.drained(J.windowed_counts(e.unionByName(e.where("event_id % 5 = 0")), "event_id"))


@query("""WITH i AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
a AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS attempts FROM i)
SELECT user_id AS job, event_id AS seq, CASE WHEN event_type = 'error' THEN attempts ELSE 0 END AS attempts, CASE WHEN event_type <> 'error' THEN 'DONE' WHEN attempts >= 5 THEN 'FAILED' ELSE 'RETRY' END AS action, CASE WHEN event_type <> 'error' OR attempts >= 5 THEN 0.0 ELSE least(900.0, 30.0 * pow(2, attempts - 1)) END AS delay_s FROM a""")
def s02_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = J.event_stream(spark, sf_dir).select(c("user_id").alias("job"), c("event_id").alias("seq"), "event_type")
    return J.drained(J.retries(e))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, day, n, value <= 60 AS granted, CASE WHEN value <= 60 THEN value ELSE CAST(0 AS DOUBLE) END AS used FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, day, n, before + value <= 60, before + CASE WHEN before + value <= 60 THEN value ELSE CAST(0 AS DOUBLE) END FROM (SELECT e.*, CASE WHEN e.day = r.day THEN r.used ELSE CAST(0 AS DOUBLE) END AS before FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS key_id, event_id AS seq, granted, round(used, 6) AS used FROM r""")
def s03_quota_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = J.event_stream(spark, sf_dir).select(c("user_id").alias("key_id"), c("event_id").alias("seq"), F.to_date("ts").cast("string").alias("day"), c("value").alias("units"))
    return J.drained(J.quota_grants(e, 60.0))


@query()
def s04_request_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = J.event_stream(spark, sf_dir).select(c("user_id").cast("string").alias("provider"), c("event_id").alias("seq"), (F.unix_micros("ts") / 1000).alias("at_ms"), (c("event_type") == "error").alias("limited"))
    return J.drained(J.request_pace(e))


@query()
def s05_cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("event_type") == "error", "LIMIT").when(c("event_id") % 97 == 0, "DAILY").otherwise("SUCCESS")
    e = J.event_stream(spark, sf_dir).select(c("user_id").cast("string").alias("provider"), c("event_id").alias("seq"), (F.unix_micros("ts") / 1000).alias("at_ms"), kind.alias("kind"))
    return J.drained(J.cooldowns(e))


@query("""WITH j AS (SELECT user_id AS job_key, min(event_id) AS seq FROM events GROUP BY 1) SELECT job_key, CASE WHEN job_key % 3 = 0 THEN 'INSERTED' WHEN job_key % 3 = 1 THEN 'REOPENED' ELSE 'UNCHANGED' END AS effect FROM j""")
def s06_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("user_id").alias("job_key"), c("event_id").alias("seq"))
    target = e.where("job_key % 3 <> 0").select("job_key", F.when(c("job_key") % 3 == 1, "DONE").otherwise("RUNNING").alias("status")).distinct()
    return J.enqueued(target, e)


@query("""SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE""")
def s07_stale_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", c("ts").alias("locked_at"), F.when(c("event_type") == "view", "RUNNING").otherwise("QUEUED").alias("status"))
    return J.stale_locks(e, "2024-01-15").select("event_id")


@query("""SELECT event_id AS candidate_id FROM events WHERE epoch_us(ts) / 1e6 + least(3600.0, greatest(30.0, 30.0 * pow(2, event_id % 9))) <= epoch_us(TIMESTAMP '2024-01-15') / 1e6""")
def s08_due_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(c("event_id").alias("candidate_id"), c("ts").alias("last_attempt"), (c("event_id") % 9).alias("attempts"))
    return J.due_candidates(e, "2024-01-15").select("candidate_id")
