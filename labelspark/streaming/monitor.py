"""Job monitoring.  The aggregates are the same for a table and for a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from labelspark import constants as C


def live_status(jobs: DataFrame) -> DataFrame:
    """Per supplier: jobs by status and the newest status.  On a stream, write in update mode."""
    status = F.col("status")
    return jobs.groupBy("provider_id").agg(
        F.count_if(status == "running").alias("running"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "failed").alias("failed"),
        F.max_by("status", "id").alias("newest_status"),
    )


def daily_counts(jobs: DataFrame, ts: str = "started_at", delay: str = "1 day") -> DataFrame:
    """Jobs per calendar day and status; late jobs are accepted for ``delay``."""
    rows = jobs.withColumn("_ts", F.col(ts).cast("timestamp"))
    if jobs.isStreaming:
        rows = rows.withWatermark("_ts", delay)
    return rows.groupBy(F.window("_ts", "1 day").alias("_w"), "status").agg(F.count(F.lit(1)).alias("jobs")).select(
        F.col("_w.start").alias("day"), "status", "jobs")


def fail_stale(jobs: DataFrame, as_of: Column, seconds: int = C.STALE_JOB_SECONDS) -> DataFrame:
    """Jobs still running after the limit count as failed."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    stale = (F.col("status") == "running") & (age > seconds)
    return jobs.withColumns({
        "log_message": F.when(stale, F.lit(C.STALE_JOB_MESSAGE)).otherwise(F.col("log_message")),
        "status": F.when(stale, "failed").otherwise(F.col("status")),
    })


class StaleProcessor(StatefulProcessor):
    """Emits a job as failed when event time passes its limit without an end.

    The state is the earliest start and whether the job is over, with one timer.  A job that is over (ended or failed) is
    remembered until its timer clears it, so that a start that arrives after the end starts nothing.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "started long, over boolean")

    def _remember(self, started: int, over: bool, until: int) -> None:
        self.state.update((started, over))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = tuple(self.state.get()) if self.state.exists() else (-1, False)
        started, over, latest = known[0], known[1], 0
        for batch in rows:
            running = batch.loc[batch["status"] == "running", "at_ms"]
            if len(running):
                started = int(running.min()) if started < 0 else min(started, int(running.min()))
            over = over or len(running) < len(batch)
            latest = max(latest, int(batch["at_ms"].max()))
        if (started, over) != known:
            begin = latest if over else started
            self._remember(started, over, begin + self.seconds * 1000 + 1)
        yield self._rows([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        started, over = self.state.get()
        if over:
            self.state.clear()
            yield self._rows([], [], [])
        else:
            self.state.update((started, True))
            self.handle.registerTimer(at + self.seconds * 1000)
            yield self._rows([key[0]], [C.STALE_JOB_MESSAGE], [datetime.fromtimestamp(at / 1000, tz=timezone.utc)])

    @staticmethod
    def _rows(ids: list, messages: list, at: list) -> pd.DataFrame:
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "status": pd.Series(["failed"] * len(ids), dtype="str"),
                             "log_message": pd.Series(messages, dtype="str"), "at": pd.Series(at, dtype="datetime64[ns, UTC]")})

    def close(self) -> None:
        pass


def stale_stream(changes: DataFrame, seconds: int = C.STALE_JOB_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Status changes (id, status, ts) in, timed-out jobs out.  Needs the RocksDB state store."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        "id", "status", "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("id").transformWithStateInPandas(
        statefulProcessor=StaleProcessor(seconds),
        outputStructType="id long, status string, log_message string, at timestamp",
        outputMode="Append", timeMode="EventTime")


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, mode: str = "append",
                  each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Work through everything that is there, then stop; a later run goes on with the stored state.

    Rows go into parquet files (append mode), or every micro-batch to ``each`` (any mode), which stores it.
    """
    if (path is None) == (each is None):
        raise ValueError("state either a path or a function for micro-batches")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").start(path) if path else writer.foreachBatch(each).start()
    query.awaitTermination()
    return query
