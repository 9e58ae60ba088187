import math
import random

import pytest
from pyspark.sql import functions as F

from labelspark.stage import Stages
from labelspark.streaming import monitor, ratelimit


def simulate(rows, limit, window_ms):
    """The limiter, request by request."""
    open_until, count, out = {}, {}, {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        if key not in open_until or open_until[key] < at:
            open_until[key], count[key] = at + window_ms, 0
        count[key] += 1
        denied = count[key] > limit
        n, bad, start, retry = out.get((key, at), (0, 0, None, None))
        retry = math.ceil((open_until[key] - at) / 1000) if denied else retry
        out[key, at] = (n + 1, bad + denied, open_until[key] - window_ms, retry)
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "key string, at long").select("key", "at", F.timestamp_millis("at").alias("ts"))


@pytest.mark.parametrize("window,chunk,fan", [(1000, 1, 2), (1000, 3, 3), (977, 64, 64), (10, 2, 2), (10, 1, 5)])
def test_rate_limit_audit_equals_simulation(spark, monkeypatch, window, chunk, fan):
    """Also with a history of many levels, a hot key, and more chunks than a task composes at once."""
    rng = random.Random(3)
    monkeypatch.setattr(ratelimit, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(ratelimit, "FAN", fan)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", rng.randrange(-3_000, 20_000)) for _ in range(700)]
    # exact ends of windows, repeated moments, long gaps
    rows += [("edge", t) for t in (0, window, window + 1, 2 * window + 1, 2 * window + 2, 10**6, 10**6, 10**6, 10**6 + window)]
    with Stages(spark) as stages:
        got = {(r.key, r.at_ms): (r.requests, r.denied, r.window_ms, r.retry_after)
               for r in ratelimit.audit(requests(spark, rows), "key", "ts", 2, window, stages).collect()}
    assert got == simulate(rows, 2, window)


def test_rate_limit_audit_in_tiny_arrow_batches(spark, monkeypatch):
    """Groups go on from one Arrow batch to the next."""
    monkeypatch.setattr(ratelimit, "CHUNK_WINDOWS", 2)
    monkeypatch.setattr(ratelimit, "FAN", 4)
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(0, 30_000)) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.key, r.at_ms): (r.requests, r.denied, r.window_ms, r.retry_after)
               for r in ratelimit.audit(requests(spark, rows), "key", "ts", 1, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == simulate(rows, 1, 100)


def test_rate_limit_audit_of_nothing(spark):
    assert ratelimit.audit(requests(spark, [(None, 5)]), "key", "ts", 1, 100).collect() == []


def into_memory(df, checkpoint, mode, table):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    writer.format("memory").queryName(table).start().awaitTermination()


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def limited(spark, tmp_path, lots, limit, window, delay):
    """The stream's rows as the simulation has them; the last lot moves event time past all others."""
    source = None
    for lot in [*lots, [("end", 10**8)], [("end", 2 * 10**8)]]:
        write(requests(spark, lot), tmp_path / "in")
        source = spark.readStream.schema(requests(spark, lot).schema).parquet(str(tmp_path / "in"))
        # each run goes on from the stored state
        monitor.run_available(ratelimit.audit_stream(source, "key", "ts", limit, window, delay), str(tmp_path / "cp"), str(tmp_path / "out"))
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != "end"]
    assert all(r.requests == r.allowed + r.denied for r in rows)
    out = {(r.key, r.at_ms): (r.requests, r.denied, r.window_ms, r.retry_after) for r in rows}
    assert len(out) == len(rows)
    return out


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(0, 5_000)) for _ in range(120)]
    # the lots overlap in time by less than the delay
    lots = [[r for i, r in enumerate(rows) if (r[1] + 700 * (i % 2)) // 2500 == n] for n in range(3)]
    got = limited(spark, tmp_path, [lot for lot in lots if lot], 2, 700, "1 second")
    batch = {(r.key, r.at_ms): (r.requests, r.denied, r.window_ms, r.retry_after)
             for r in ratelimit.audit(requests(spark, rows), "key", "ts", 2, 700).collect()}
    assert got == batch == simulate(rows, 2, 700)


def test_monitor_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(5), rng.choice(["running", "success", "failed", "partial"]), 1_700_000_000 + 40_000 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, provider_id int, status string, s long").withColumn("started_at", F.timestamp_seconds("s"))
    write(df, tmp_path / "in")
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    into_memory(monitor.live_status(source), tmp_path / "cp1", "complete", "live")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, monitor.live_status(df).collect()))
    into_memory(monitor.daily_counts(source), tmp_path / "cp2", "update", "daily")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, monitor.daily_counts(df).collect()))


def test_stale_jobs(spark, tmp_path):
    rows = [(1, "running", 0), (2, "running", 0), (2, "success", 60), (3, "running", 500), (4, "success", 900)]
    df = spark.createDataFrame(rows, "id long, status string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
    for lot in ("s <= 60", "s = 500", "s = 900"):
        write(df.filter(lot), tmp_path / "in")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    into_memory(monitor.stale_stream(source), tmp_path / "cp", "append", "stale")
    got = sorted((r.id, r.status, r.log_message) for r in spark.table("stale").collect())
    assert got == [(1, "failed", "Timeout nach 2 Min."), (3, "failed", "Timeout nach 2 Min.")]
    table = df.withColumnsRenamed({"ts": "started_at"}).withColumn("log_message", F.lit(None).cast("string"))
    as_of = F.timestamp_seconds(F.lit(1_000_120))
    assert [r.id for r in monitor.fail_stale(table, as_of).filter("status = 'failed'").collect()] == []
    as_of = F.timestamp_seconds(F.lit(1_000_121))
    assert [r.id for r in monitor.fail_stale(table, as_of).filter("status = 'failed'").orderBy("id").collect()] == [1, 2]


def test_rate_limit_stream_in_tiny_arrow_batches(spark, tmp_path):
    """Requests count in time order, however many Arrow batches they come in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(k, 10**6 + at) for k, at in [("a", 5000), ("a", 5001), ("a", 0), ("a", 1), ("a", 5000), ("a", 5999), ("a", 6001), ("b", 7)] * 2]
        got = limited(spark, tmp_path, [rows], 1, 6000, "10 seconds")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == simulate(rows, 1, 6000)


def test_stale_stream_remembers_ends_and_fails_once(spark, tmp_path):
    rows = [(1, "success", 5), (1, "running", 0), (2, "running", 0), (2, "running", 50), (3, "running", 40), (3, "running", 0), (3, "success", 110),
            (4, "running", 0), (9, "success", 5000), (4, "running", 0), (9, "success", 9000)]
    df = spark.createDataFrame(rows, "id long, status string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
    for row in rows[:8] + [rows[8], rows[10]]:  # one row for each micro-batch, ends before starts among them
        write(df.filter((F.col("id") == row[0]) & (F.col("status") == row[1]) & (F.col("s") == row[2])).limit(1), tmp_path / "in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    into_memory(monitor.stale_stream(source, delay="200 seconds"), tmp_path / "cp", "append", "stale_once")
    assert sorted(r.id for r in spark.table("stale_once").collect()) == [2, 4]
