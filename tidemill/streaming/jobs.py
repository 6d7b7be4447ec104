"""Streams of job and request events.

State is kept per key by applyInPandasWithState, so it survives restarts in the query's checkpoint. Within a
micro-batch a key's rows are handled in order of `seq`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.days import QUOTA_ZONE
from ..session import shared_folder

Rows = Iterator[pd.DataFrame]


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream, times as UTC."""
    from ..sources.tables import table

    schema = table(spark, sf_dir, name).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and return what its sink holds; files and checkpoint are in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """R09, R12, R13. Distinct events by window and type; a window is emitted once the watermark has passed it."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    g = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


def _each(rows: Rows) -> Iterator[dict]:
    whole = pd.concat(list(rows))
    yield from whole.sort_values("seq").to_dict("records")


def _attempts(key: tuple, rows: Rows, state: GroupState) -> Rows:
    (attempts,) = state.get if state.exists else (0,)
    out = []
    for r in _each(rows):
        if r["event_type"] == "error":
            attempts += 1
            done = attempts >= 5
            out.append((key[0], r["seq"], attempts, "FAILED" if done else "RETRY", 0.0 if done else min(900.0, 30.0 * 2 ** (attempts - 1))))
        else:
            attempts = 0
            out.append((key[0], r["seq"], 0, "DONE", 0.0))
    state.update((attempts,))
    yield pd.DataFrame(out, columns=["job", "seq", "attempts", "action", "delay_s"])


def retries(events: DataFrame) -> DataFrame:
    """R03, D23. What each job event leads to: errors in a row back off and fail at the fifth, anything else completes. Needs job, seq, event_type."""
    return events.groupBy("job").applyInPandasWithState(_attempts, "job long, seq long, attempts int, action string, delay_s double", "attempts int", "append", GroupStateTimeout.NoTimeout)


def _quota(limit: float):
    def run(key: tuple, rows: Rows, state: GroupState) -> Rows:
        day, used = state.get if state.exists else ("", 0.0)
        out = []
        for r in _each(rows):
            if r["day"] != day:
                day, used = r["day"], 0.0
            granted = used + r["units"] <= limit
            used += r["units"] if granted else 0.0
            out.append((key[0], r["seq"], granted, round(used, 6)))
        state.update((day, used))
        yield pd.DataFrame(out, columns=["key_id", "seq", "granted", "used"])

    return run


def quota_grants(requests: DataFrame, limit: float) -> DataFrame:
    """R07, R08, R16. Whether each request fits its key's budget of the day; refused ones use nothing. Needs key_id, seq, day, units."""
    return requests.groupBy("key_id").applyInPandasWithState(_quota(limit), "key_id long, seq long, granted boolean, used double", "day string, used double", "append", GroupStateTimeout.NoTimeout)


def _pace(spacing: float, window: float, recover: int):
    def run(key: tuple, rows: Rows, state: GroupState) -> Rows:
        gap, free, hot_until, streak = state.get if state.exists else (spacing, 0.0, 0.0, 0)
        out = []
        for r in _each(rows):
            start = max(r["at_ms"], free)
            out.append((key[0], r["seq"], start, gap))
            if r["limited"]:
                gap, hot_until, streak = min(gap * 2, 64 * spacing), start + window, 0
            else:
                streak += 1
                if streak >= recover and start >= hot_until:
                    gap, streak = max(spacing, gap / 2), 0
            free = start + gap
        state.update((gap, free, hot_until, streak))
        yield pd.DataFrame(out, columns=["provider", "seq", "start_ms", "gap_ms"])

    return run


def request_pace(requests: DataFrame, spacing_ms: float = 250.0, window_ms: float = 60_000.0, recover: int = 4) -> DataFrame:
    """R05. When each request may start: at least a gap apart; the gap doubles when limited and halves after 4 successes past the pressure window.

    Needs provider, seq, at_ms, limited.
    """
    return requests.groupBy("provider").applyInPandasWithState(_pace(spacing_ms, window_ms, recover), "provider string, seq long, start_ms double, gap_ms double", "gap double, free double, hot double, streak int", "append", GroupStateTimeout.NoTimeout)


def next_reset_ms(ms: float) -> float:
    """The next midnight of the quota zone."""
    zone = ZoneInfo(QUOTA_ZONE)
    day = datetime.fromtimestamp(ms / 1000, zone).date() + timedelta(days=1)
    return datetime(day.year, day.month, day.day, tzinfo=zone).timestamp() * 1000


def _cooldown(quarantine: float, pause: float):
    def run(key: tuple, rows: Rows, state: GroupState) -> Rows:
        until, first = state.get if state.exists else (0.0, -1.0)
        out = []
        for r in _each(rows):
            at = r["at_ms"]
            if r["kind"] == "DAILY":
                until, mode = next_reset_ms(at), "UNTIL_RESET"
            elif r["kind"] == "LIMIT":
                again = first >= 0 and at - first <= pause
                until, mode = at + (pause if again else quarantine), "PAUSED" if again else "QUARANTINED"
                first = first if again else at
            elif at >= until:
                until, first, mode = 0.0, -1.0, "OPEN"
            else:
                mode = "COOLING"
            out.append((key[0], r["seq"], mode, until))
        state.update((until, first))
        yield pd.DataFrame(out, columns=["provider", "seq", "mode", "until_ms"])

    return run


def cooldowns(signals: DataFrame, quarantine_ms: float = 60_000.0, pause_ms: float = 900_000.0) -> DataFrame:
    """R06, R21. Each provider's cooldown: a daily limit lasts to the next reset, a first limit quarantines, a second one soon after pauses; success past it clears.

    Needs provider, seq, at_ms and kind DAILY, LIMIT or SUCCESS.
    """
    return signals.groupBy("provider").applyInPandasWithState(_cooldown(quarantine_ms, pause_ms), "provider string, seq long, mode string, until_ms double", "until double, first double", "append", GroupStateTimeout.NoTimeout)


def enqueued(target: DataFrame, jobs: DataFrame) -> DataFrame:
    """R02. What enqueueing does to each job key: new ones open, finished ones reopen, the rest stay."""
    from ..operators.relational import latest

    now = latest(jobs, ["job_key"], [F.asc("seq")]).select("job_key", "seq")
    out = now.join(target.select("job_key", F.col("status").alias("_was")), "job_key", "left")
    return out.select("job_key", F.when(F.col("_was").isNull(), "INSERTED").when(F.col("_was").isin("DONE", "FAILED"), "REOPENED").otherwise("UNCHANGED").alias("effect"))


def stale_locks(jobs: DataFrame, as_of, minutes: int = 15) -> DataFrame:
    """R04. Running jobs whose lock is older than that, to be queued again."""
    return jobs.where((F.col("status") == "RUNNING") & (F.col("locked_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))))


def due_candidates(staged: DataFrame, as_of) -> DataFrame:
    """R15, R22. Staged candidates whose backoff is over, oldest first."""
    from ..operators.lifecycle import staged_backoff

    due = F.unix_micros("last_attempt") / 1e6 + staged_backoff(F.col("attempts"))
    return staged.where(due <= F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6).orderBy("last_attempt", "candidate_id")
