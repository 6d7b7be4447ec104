from collections import defaultdict

from pyspark.sql import functions as F

from tidemill.plans import stream_queries as Q
from tidemill.streaming import jobs as J

DATA = "/root/testdata/sf0.001"
c = F.col


def events(spark):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").collect()]


def test_quota_against_loop(spark):
    used, day, want = defaultdict(float), {}, {}
    for e in events(spark):
        k, d = e["user_id"], e["ts"].date()
        if day.get(k) != d:
            day[k], used[k] = d, 0.0
        ok = used[k] + e["value"] <= 60.0
        used[k] += e["value"] if ok else 0.0
        want[e["event_id"]] = (ok, round(used[k], 6))
    got = {r.seq: (r.granted, r.used) for r in Q.s03_quota_state(spark, DATA).collect()}
    assert got == want and {True, False} == {g for g, _ in got.values()}


def test_pace(spark):
    rows = [("p", i, 0.0, i == 1) for i in range(8)]
    src = spark.createDataFrame(rows, "provider string, seq long, at_ms double, limited boolean")
    state_free = [r for r in _run(spark, src, J.request_pace, window_ms=500.0)]
    starts = [r.start_ms for r in sorted(state_free, key=lambda r: r.seq)]
    assert starts[:4] == [0.0, 250.0, 750.0, 1250.0] and all(b > a for a, b in zip(starts, starts[1:]))
    gaps = [r.gap_ms for r in sorted(state_free, key=lambda r: r.seq)]
    assert max(gaps) == 500.0 and gaps[-1] == 250.0


def test_cooldown(spark):
    day = 86_400_000.0
    rows = [("p", 1, 0.0, "LIMIT"), ("p", 2, 1000.0, "SUCCESS"), ("p", 3, 2000.0, "LIMIT"), ("p", 4, 2 * day, "SUCCESS"), ("p", 5, 2 * day + 1, "DAILY"), ("p", 6, 2 * day + 2, "SUCCESS")]
    src = spark.createDataFrame(rows, "provider string, seq long, at_ms double, kind string")
    got = sorted(_run(spark, src, J.cooldowns), key=lambda r: r.seq)
    assert [r.mode for r in got] == ["QUARANTINED", "COOLING", "PAUSED", "OPEN", "UNTIL_RESET", "COOLING"]
    assert got[4].until_ms == J.next_reset_ms(2 * day + 1)


def test_windows_drop_repeats_and_wait_for_the_watermark(spark):
    got = Q.s01_stream_dedup_windows(spark, DATA)
    last = spark.read.parquet(f"{DATA}/events.parquet").agg(F.max("ts")).first()[0]
    assert got.agg(F.max("window_start")).first()[0] < last
    assert got.agg(F.sum("n")).first()[0] <= 1000


def _run(spark, rows, op, **params):
    """An operator over a stream of the rows."""
    import tempfile

    at = tempfile.mkdtemp()
    rows.coalesce(1).write.mode("overwrite").parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    return J.drained(op(stream, **params)).collect()
