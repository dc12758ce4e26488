"""Watching as a stream with state, against the batch form and plain loops."""

import datetime as dt

import pandas as pd
import pytest

from tarnwell.streaming import watch

STORE = "spark.sql.streaming.stateStore.providerClass"
EVENT = "path string, ts timestamp, hash string"


def at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def by_hand(events, gap):
    out = []
    for path in {e[0] for e in events}:
        last, run = None, []
        for e in [*sorted((t, h) for p, t, h in events if p == path), None]:
            if run and (e is None or e[0] - run[-1][0] >= gap):
                if run[-1][1] != last:
                    out.append((path, *run[-1]))
                    last = run[-1][1]
                run = []
            if e:
                run.append(e)
    return sorted(out)


# Batches of arrivals: a burst, a late event that joins two runs, one that is repeated, a change back, an unchanged file.
BATCHES = [
    [("a", 0.0, "1"), ("a", 0.2, "2"), ("b", 0.0, "x")],
    [("a", 0.9, "3"), ("b", 0.1, "x"), ("b", 3.0, "x")],
    [("a", 0.5, "9"), ("a", 0.9, "3"), ("c", 3.2, "k")],
    [("a", 6.0, "3"), ("b", 6.0, "y"), ("c", 6.4, "m")],
    [("a", 9.0, "1"), ("b", 9.0, "x"), ("c", 6.6, "k")],
    [("end", 60.0, "z")],
]


def rows(df, name):
    return sorted((r[name], (r["at"].timestamp() - at(0).timestamp()), r["hash"]) for r in df.collect())


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def test_batch(spark):
    events = [e for batch in BATCHES for e in batch]
    df = spark.createDataFrame([(p, at(t), h) for p, t, h in events] + [(None, at(0), "1"), ("q", None, "1"), ("q", at(0), None)], EVENT)
    got = [(p, round(t, 3), h) for p, t, h in rows(watch.quiet_changes(df, "path", "ts", "hash"), "path")]
    assert got == by_hand(events, 0.5)


def test_stream_with_late_events_and_a_restart(spark, store, tmp_path):
    """Each batch is a run of the query of its own, which goes on from the checkpoint."""
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for batch in BATCHES:
        spark.createDataFrame([(p, at(t), h) for p, t, h in batch], EVENT).coalesce(1).write.mode("append").parquet(folder)
        stream = watch.watch(spark.readStream.schema(EVENT).parquet(folder), "path", "ts", "hash", 500, "3 seconds")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(p, round(t, 3), h) for p, t, h in rows(spark.read.parquet(out), "key")]
    want = by_hand([e for batch in BATCHES for e in batch], 0.5)
    assert got == [w for w in want if w[0] != "end"]  # the last event's run is still open


class Handle:
    """A state handle that counts round trips."""

    def __init__(self):
        self.value, self.timers, self.trips = None, set(), 0

    def trip(self):
        self.trips += 1

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        self.trip()
        return self.value

    def exists(self):
        self.trip()
        return self.value is not None

    def update(self, value):
        self.trip()
        self.value = value

    put = update

    def clear(self):
        self.update(None)

    def listTimers(self):
        self.trip()
        return iter(self.timers)

    def registerTimer(self, at):
        self.trip()
        self.timers.add(at)

    def deleteTimer(self, at):
        self.trip()
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_takes_few_round_trips():
    """Three where a timer is set, two where none is."""
    handle, changes = Handle(), watch.QuietChanges(500)
    changes.init(handle)
    trips = []

    def told(out):
        got = [tuple(r) for df in out for r in df[["key", "hash"]].itertuples(index=False)]
        trips.append(handle.trips)
        handle.trips = 0
        return got

    rows = lambda *x: [pd.DataFrame(x, columns=["us", "hash"])]
    assert told(changes.handleInputRows(("k",), rows((0, "a"), (10_000, "b")), Now(0))) == []
    assert handle.timers == {510}
    assert told(changes.handleInputRows(("k",), rows((5_000, "c")), Now(0))) == []  # the run ends where it did
    assert told(changes.handleExpiredTimer(("k",), Now(600), None)) == [("k", "b")]
    handle.timers.clear()  # as the engine does
    assert told(changes.handleInputRows(("k",), rows((9_000_000, "b"), (20_000_000, "z")), Now(10_000))) == []
    assert handle.timers == {20_500}
    assert trips == [3, 2, 2, 3]
