"""Audit of a request log against a limit per window.

A window opens with the first request of a key and lasts ``window_ms``; the first request strictly
after its end opens the next one.  Windows are therefore anchored in the data, and each start depends
on the one before.

The batch form does not walk through a key's requests in one task.  Requests are first counted per
key and millisecond, then cut into time chunks.  A chunk is a function: from the end of the window that is
open when it begins to the end of the one that is open when it is over.  A small table says so for every
point at which a chain of windows can enter.  Tables of neighbouring chunks are composed, again and again, until a key
has one; then the ends are handed down the same tree, and with its own end every chunk is finished by itself.
No row holds more than one table, and a task holds two at a time, however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelspark.stage import Stages

CHUNK_WINDOWS = 64
FAN = 64  # neighbouring tables that become one on the way up
_NEVER = np.iinfo("int64").min  # no window is open
_TABLE = "key string, node long, entries array<long>, exits array<long>, beyond long"


def _next_starts(times: np.ndarray, window_ms: int) -> np.ndarray:
    """Index of the window start that follows a start at each position (len = none in this chunk)."""
    return np.searchsorted(times, times + window_ms, side="right")


def _entries(window_ms: int):
    """Per chunk its table: for each moment at which a chain can enter, the end with which it leaves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries, exits = [], []
            for begin, times in zip(batch["begin"], batch["times"]):
                times = np.asarray(times, dtype="int64")
                n, follow = len(times), _next_starts(times, window_ms)
                last = np.where(follow == n, np.arange(n), follow)
                while True:  # pointer doubling
                    further = last[last]
                    if np.array_equal(further, last):
                        break
                    last = further
                # an earlier window ends before begin + window_ms, so later positions are never entered
                m = min(n, int(np.searchsorted(times, begin + window_ms, side="right")) + 1)
                entries.append(times[:m])
                exits.append(times[last[:m]] + window_ms)
            yield batch.drop(columns="begin").assign(entries=entries, exits=exits)

    return run


def _leave(end: np.ndarray, entries: np.ndarray, exits: np.ndarray, beyond: float | None) -> np.ndarray:
    """The ends after a table, from the ends before it: the first moment after an end is where the chain enters.

    Behind the last moment the end becomes ``beyond``; without one it stays.
    """
    at = np.searchsorted(entries, end, side="right")
    later = end if beyond is None else np.full(len(end), beyond, "int64")
    return np.where(at < len(entries), exits[np.minimum(at, len(exits) - 1)], later)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row, is the last of its Arrow batch) in order; the rows of a group may lie in several batches."""
    for batch in batches:
        for i, row in enumerate(batch.itertuples(index=False), 1):
            yield row, i == len(batch)


def _given(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted tables to one table per (key, parent)."""
    group, table, done = None, None, []
    for row, last in _rows(batches):
        entries, exits, beyond = np.asarray(row.entries), np.asarray(row.exits), _given(row.beyond)
        if (row.key, row.parent) != group:
            if group is not None:
                done.append((*group, *table))
            group, table = (row.key, row.parent), (entries, exits, beyond)
        else:
            # an end that passes the left table is earlier than anything on the right
            through = int(exits[0]) if table[2] is None else int(_leave(np.array([table[2]]), entries, exits, beyond)[0])
            table = (table[0], _leave(table[1], entries, exits, beyond), through)
        if last and done:
            yield _tables(done)
            done = []
    if group is not None:
        yield _tables([*done, (*group, *table)])


def _tables(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "node", "entries", "exits", "beyond"])
    return out.assign(beyond=out["beyond"].astype("Int64"))


def _hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``open_until`` to sorted tables.  A row without a table opens a group with the end that its parent was given."""
    group, end, out = None, _NEVER, []
    for row, last in _rows(batches):
        if (row.key, row.parent) != group:
            group, end = (row.key, row.parent), _NEVER
        if row.entries is None:
            end = int(row.open_until)
        else:
            out.append(row._replace(open_until=end))
            end = int(_leave(np.array([end]), np.asarray(row.entries), np.asarray(row.exits), _given(row.beyond))[0])
        if last and out:
            yield pd.DataFrame(out).assign(open_until=[r.open_until for r in out])
            out = []


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ends by node, for the next level down."""
    for batch in _hand_down(batches):
        yield batch[["key", "node", "open_until"]]


def _assign(window_ms: int):
    """Per chunk: the window start of every millisecond."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _hand_down(batches):
            keys, at, requests, windows = [], [], [], []
            for key, times, counts, open_until in zip(batch["key"], batch["times"], batch["counts"], batch["open_until"]):
                times = np.asarray(times, dtype="int64")
                follow, i = _next_starts(times, window_ms), int(np.searchsorted(times, open_until, side="right"))
                starts = [open_until - window_ms] if i else []
                while i < len(times):
                    starts.append(times[i])
                    i = int(follow[i])
                starts = np.asarray(starts, dtype="int64")
                own = starts[np.searchsorted(starts, times, side="right") - 1]
                keys.extend([key] * len(times))
                at.append(times)
                requests.append(counts)
                windows.append(own)
            if at:
                yield pd.DataFrame({"key": keys, "at_ms": np.concatenate(at), "requests": np.concatenate(requests),
                                    "window_ms": np.concatenate(windows)})

    return run


def _in_order(tables: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Tables by (key, parent), sorted by node; before them, where there are ``ends``, the row with the parent's end."""
    rows = tables.withColumn("parent", F.floor(F.col("node") / FAN)).withColumn("open_until", F.lit(None).cast("long"))
    if ends is not None:
        heads = ends.select("key", F.col("node").alias("parent"), F.lit(-1).cast("long").alias("node"), "open_until")
        rows = rows.unionByName(heads, allowMissingColumns=True)
    return rows.repartition("key", "parent").sortWithinPartitions("key", "parent", "node")


def audit(requests: DataFrame, key: str, ts: str, limit: int, window_ms: int, stages: Stages | None = None) -> DataFrame:
    """Per key and millisecond: requests, how many of them were allowed and denied, the start of the window
    and, when any was denied, the seconds until the window ends (rounded up).

    The chunks and, of a long history, the levels of the tree are tables of ``stages``.
    """
    stages = stages or Stages(requests.sparkSession)
    width = CHUNK_WINDOWS * window_ms
    moments = (
        requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    chunks = (
        moments.groupBy("key", F.floor(F.col("at") / width).alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("m"))
        .select("key", "node", (F.col("node") * width).alias("begin"), F.col("m.at").alias("times"), F.col("m.n").alias("counts"),
                F.lit(None).cast("long").alias("beyond"))
    )
    chunks = stages.write(chunks.mapInPandas(
        _entries(window_ms), "key string, node long, times array<long>, counts array<long>, beyond long, entries array<long>, exits array<long>"), "chunks")
    first, last = chunks.agg(F.min("node"), F.max("node")).first()
    chunks = chunks.withColumn("node", F.col("node") - F.lit(first or 0))
    levels, span = [chunks.select("key", "node", "entries", "exits", "beyond")], (last or 0) - (first or 0)
    while span >= FAN:
        levels.append(stages.write(_in_order(levels[-1]).mapInPandas(_compose, _TABLE), "level"))
        span //= FAN
    ends = None  # at the top no window is open
    for level in reversed(levels[1:]):
        ends = _in_order(level, ends).mapInPandas(_ends, "key string, node long, open_until long")
    assigned = _in_order(chunks, ends).mapInPandas(_assign(window_ms), "key string, at_ms long, requests long, window_ms long")
    # a window holds at most window_ms distinct moments, however many requests it saw
    w = W.partitionBy("key", "window_ms").orderBy("at_ms")
    before = F.sum("requests").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("requests")
    allowed = F.greatest(F.lit(0), F.least(F.col("requests"), F.lit(limit) - before))
    rows = assigned.withColumn("allowed", allowed).withColumn("denied", F.col("requests") - F.col("allowed"))
    retry = F.ceil((F.col("window_ms") + window_ms - F.col("at_ms")) / 1000)
    return rows.withColumn("retry_after", F.when(F.col("denied") > 0, retry))


class LimitProcessor(StatefulProcessor):
    """Stream form: requests wait, counted per millisecond, until event time has passed them; then they are judged in time order.

    The counts of a second are one entry of a map, at most 1,000 of them, with a timer at the second's last millisecond.  Timers fire
    in time order, so whatever a micro-batch holds, only one second of one key is in memory at a time.  A timer at a full second
    forgets a window that is over.
    """

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count long, reset_ms long")
        self.seconds = handle.getMapState("seconds", "second long", "moments array<long>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            moments, counts = np.unique(batch["at_ms"].to_numpy(), return_counts=True)
            seconds = moments // 1000
            for low in np.flatnonzero(np.diff(seconds, prepend=seconds[:1] - 1)):
                second = int(seconds[low])
                high = int(np.searchsorted(seconds, second, side="right"))
                waiting = dict(zip(moments[low:high].tolist(), counts[low:high].tolist(), strict=True))
                if self.seconds.containsKey((second,)):
                    for at, n in zip(*self.seconds.getValue((second,)), strict=True):
                        waiting[at] = waiting.get(at, 0) + n
                else:
                    self.handle.registerTimer(1000 * second + 999)
                self.seconds.updateValue((second,), (sorted(waiting), [waiting[at] for at in sorted(waiting)]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        count, reset = self.window.get() if self.window.exists() else (0, None)
        if at % 1000 == 0:  # a window's state may go; what is still to come lies later
            if reset is not None and reset < at:
                self.window.clear()
            return
        second = (at // 1000,)
        moments, counts = (np.asarray(x, dtype="int64") for x in self.seconds.getValue(second))
        self.seconds.removeKey(second)
        before, ends = np.empty(len(moments), np.int64), np.empty(len(moments), np.int64)
        for i, (moment, n) in enumerate(zip(moments.tolist(), counts.tolist(), strict=True)):
            if reset is None or reset < moment:
                count, reset = 0, moment + self.window_ms
            before[i], ends[i] = count, reset
            count += n
        self.window.update((count, reset))
        self.handle.registerTimer((reset // 1000 + 1) * 1000)
        allowed = np.clip(self.limit - before, 0, counts)
        wait = -((moments - ends) // 1000)
        yield pd.DataFrame({"key": key[0], "at_ms": moments, "requests": counts, "allowed": allowed, "denied": counts - allowed,
                            "window_ms": ends - self.window_ms, "retry_after": pd.Series(wait, dtype="Int64").mask(allowed == counts)})

    def close(self) -> None:
        pass


def audit_stream(requests: DataFrame, key: str, ts: str, limit: int, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """The columns of :func:`audit`, one row per key and millisecond, once event time is ``delay`` past it.

    Requests may come in any order within ``delay``; later ones are dropped with the watermark.  Memory: per key the
    milliseconds of ``delay`` in the state store, and one second of them in a task.  Needs the RocksDB state store.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.filter("key is not null and ts is not null").withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LimitProcessor(limit, window_ms),
        outputStructType="key string, at_ms long, requests long, allowed long, denied long, window_ms long, retry_after long",
        outputMode="Append", timeMode="EventTime")
