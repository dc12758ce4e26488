"""File events: debouncing, caches, staleness."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = "500 milliseconds", lateness: str | None = None) -> DataFrame:
    """(key, started, ended, n): runs of events of a key closer than ``gap``; ended: last event.

    Works on batches and, with ``lateness`` as watermark, on streams. ``ts`` is cast to a timestamp.
    """
    rows = events.select(key, F.col(ts).cast("timestamp").alias("at"))
    if lateness:
        rows = rows.withWatermark("at", lateness)
    out = rows.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"))
    return out.select(key, "started", "ended", "n")


def stale(current: DataFrame, marks: DataFrame, by: str, hash_col: str) -> DataFrame:
    """(by, fresh): whether marks of a unit were made from its present content; without marks or a hash: not fresh. Marks may repeat."""
    known = marks.select(by, hash_col, F.lit(True).alias("fresh")).distinct()
    return current.select(by, hash_col).join(known, [by, hash_col], "left").select(by, F.coalesce("fresh", F.lit(False)).alias("fresh"))


def recompute(current: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` whose key and content hash are not in the cache."""
    return current.join(cache.select(*keys), keys, "left_anti")


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` with ``hit``."""
    return wanted.join(cache.select(key, F.lit(True).alias("hit")).distinct(), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))



def quiet_changes(events: DataFrame, key: str, ts: str, hash_col: str, gap: str = "500 milliseconds") -> DataFrame:
    """(key, at, hash): runs of events closer than ``gap``, by their last event, whose hash is not that of the run before.

    The batch form of ``QuietChanges``. Of events at one time the larger hash is the later one; null keys, times and hashes are left out.
    """
    rows = events.select(key, F.col(ts).cast("timestamp").alias("at"), F.col(hash_col).cast("string").alias("hash")).dropna()
    runs = rows.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.max(F.struct("at", "hash")).alias("x")).select(key, "x.at", "x.hash")
    before = F.lag("hash").over(Window.partitionBy(key).orderBy("at"))
    return runs.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("hash"))).drop("_before")


class QuietChanges(StatefulProcessor):
    """Lets a file through once it is quiet, if its contents changed: what a watcher acts on.

    Rows are (key, at, hash). State of a key, one value, as each access to it takes a round trip: the
    hash let through last, its events since, which are those of a gap and of the allowed lateness, as
    JSON, and its timer. When the watermark has passed the end of a run of
    events closer than ``gap_ms``, the run's last hash goes through, unless it is the one before; a
    timer at that end brings a key back that gets no more rows. Late events are put in their place, so
    results do not depend on the order of arrival within the lateness, nor on the cut into batches.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "passed string, waiting string, timer long")

    def _settle(self, key, new: list[tuple[int, str]], watermark_ms: int, expired: bool) -> Iterator[pd.DataFrame]:
        """Let closed runs through and keep the rest; times in microseconds. expired: the timer has gone off, and goes of itself."""
        last, waiting, timer = self.state.get() or (None, None, None)
        held = [(t, h) for t, h in json.loads(waiting)] if waiting else []
        out, run, open_, first, gap = [], [], [], None, self.gap_ms * 1000
        for event in [*sorted(held + new), None]:
            if run and (event is None or event[0] - run[-1][0] >= gap):
                if run[-1][0] + gap <= watermark_ms * 1000:
                    if run[-1][1] != last:
                        out.append(run[-1])
                        last = run[-1][1]
                else:
                    open_ += run
                    first = run[-1][0] if first is None else first
                run = []
            if event is not None:
                run.append(event)
        due = -(-(first + gap) // 1000) if open_ else None
        if due != timer:
            if timer is not None and not expired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((last, json.dumps(open_) if open_ else None, due))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at": pd.to_datetime([x[0] for x in out], unit="us", utc=True), "hash": [x[1] for x in out]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), h) for part in rows for t, h in zip(part["us"], part["hash"], strict=True)]
        yield from self._settle(key, new, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def watch(events: DataFrame, key: str, ts: str, hash_col: str, gap_ms: int = 500, lateness: str = "1 second") -> DataFrame:
    """(key string, at, hash): ``QuietChanges`` over a stream of events; the state store must be that of RocksDB."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(hash_col).cast("string").alias("hash")).dropna()
    rows = rows.withWatermark("at", lateness).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("key").transformWithStateInPandas(QuietChanges(gap_ms), "key string, at timestamp, hash string", "append", "eventtime")
