"""The streaming detector gives what the batch operator gives, though rows come out of order over several batches."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelens.operators import events
from wavelens.streaming import detector, sessions

START = dt.datetime(2024, 1, 1)


def write(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "capture_id long, ts timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")


def drain(spark, tmp_path, name, make, kind):
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_events_of_late_rows(spark, tmp_path, rocks):
    rng = np.random.default_rng(4)
    rows = []
    for c in (1, 2, 3):
        level = np.repeat(rng.choice([0.0, 5.0, 10.0], 20), rng.integers(1, 6, 20))[:50]
        rows += [(c, START + dt.timedelta(seconds=i), float("nan") if i == 17 else float(v + rng.normal(0, 0.3))) for i, v in enumerate(level)]
    rows[60] = (*rows[60][:2], None)
    # Neighbours up to 6 s apart change places, and the batches overlap in time; a far row lets the watermark pass at the end.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] - START).total_seconds() + rng.uniform(0, 6))
    cut = len(order) // 2
    write(spark, tmp_path, "a", [rows[i] for i in order[:cut]])
    write(spark, tmp_path, "b", [rows[i] for i in order[cut:]])
    write(spark, tmp_path, "c", [(9, START + dt.timedelta(hours=1), 0.0)])
    write(spark, tmp_path, "d", [(9, START + dt.timedelta(hours=2), 0.0)])
    kind = "capture_id long, ts timestamp, v double"
    got = drain(spark, tmp_path, "late_events", lambda s: detector.hysteresis_events(s, 8.0, 2.0, enter_n=2, leave_n=3, least=3, late="20 seconds"), kind)
    batch = spark.createDataFrame(rows, kind).withColumn("n", F.row_number().over(Window.partitionBy("capture_id").orderBy("ts")) - 1)
    want = events.hysteresis(batch, 8.0, 2.0, 2, 3, 3).collect()
    assert sorted((r.capture_id, r.start_n, r.end_n, r.is_open) for r in got) == sorted((r.capture_id, r.start_n, r.end_n, r.is_open) for r in want)
    assert len(want) >= 4 and all((r.start_ts - START).total_seconds() == r.start_n and (r.end_ts - START).total_seconds() == r.end_n for r in got)
    with pytest.raises(ValueError):
        detector.hysteresis_events(batch, 1.0, 2.0)


def test_sliding_windows(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, START + dt.timedelta(seconds=i), float(i)) for i in range(20)])
    write(spark, tmp_path, "z", [(1, START + dt.timedelta(hours=1), 0.0)])
    write(spark, tmp_path, "zz", [(1, START + dt.timedelta(hours=2), 0.0)])
    got = {(r.start - START).total_seconds(): (r["count"], r.mean) for r in drain(spark, tmp_path, "slid", lambda s: sessions.windowed_stats(s, "10 seconds", "1 seconds", "5 seconds"), "capture_id long, ts timestamp, v double")}
    assert got[-5.0] == (5, 2.0) and got[0.0] == (10, 4.5) and got[5.0] == (10, 9.5) and got[15.0] == (5, 17.0)


class FakeState:
    """A key's state and timers in memory, which counts the calls that would be messages to the JVM."""

    def __init__(self):
        self.calls, self.timers, self.rows, self.row = 0, set(), [], None
        count = lambda f: lambda *a: (setattr(self, "calls", self.calls + 1), f(*a))[1]
        self.held = SimpleNamespace(get=count(lambda: iter(self.rows)), appendValue=count(lambda x: self.rows.append(x)), appendList=count(lambda x: self.rows.extend(x)), put=count(lambda x: setattr(self, "rows", list(x))), clear=count(lambda: self.rows.clear()))
        self.machine = SimpleNamespace(get=count(lambda: self.row), exists=count(lambda: self.row is not None), update=count(lambda x: setattr(self, "row", x)), clear=count(lambda: setattr(self, "row", None)))
        self.getListState, self.getValueState = lambda *a: self.held, lambda *a: self.machine
        self.registerTimer, self.deleteTimer, self.listTimers = count(self.timers.add), count(self.timers.discard), count(lambda: iter(sorted(self.timers)))

    def pass_time(self, machine, ms):
        out, at = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
        for t in sorted(t for t in self.timers if t <= ms):
            out += list(machine.handleExpiredTimer((1,), at, None))
            self.timers.discard(t)
        return out


def test_few_state_calls_and_state_that_goes():
    rng = np.random.default_rng(8)
    machine, state = detector._Detector(8.0, 2.0, 2, 1, 0, 60_000), FakeState()
    machine.init(state)
    level = np.repeat(rng.choice([0.0, 5.0, 10.0, np.nan], 80), rng.integers(1, 6, 80))
    rows = [SimpleNamespace(us=i * 1_000_000, v=None if v != v else float(v)) for i, v in enumerate([*level, 9.0, 9.0])]
    got, order = [], np.argsort(np.arange(len(rows)) + rng.uniform(0, 4, len(rows)))
    for some in np.array_split(order, 9):
        state.calls = 0
        assert list(machine.handleInputRows((1,), iter([rows[i] for i in some]), None)) == []
        assert state.calls <= 2 and len(state.rows) <= 2  # however many samples came
        reached = int(max(rows[i].us for i in some)) // 1000 - 5000
        fired, state.calls = len([t for t in state.timers if t <= reached]), 0
        got += state.pass_time(machine, reached)
        assert state.calls <= 5 * fired
    last = rows[-1].us // 1000
    got += state.pass_time(machine, last + 59_999)
    assert state.row is not None and len(got) > 3
    got += state.pass_time(machine, last + 60_000)
    assert state.row is None and not state.rows and got[-1].is_open and not state.pass_time(machine, last + 10**6) and not state.timers
    want, on, run = [], None, []
    for n, r in enumerate(rows):
        if on is None:
            run = [*run, n] if r.v is not None and r.v >= 8 else []
            on, run = (run[0], []) if len(run) == 2 else (None, run)
        elif r.v is None or r.v <= 2:
            want, on = [*want, (on, n)], None
    assert [(e.start_n, e.end_n) for e in got] == [*want, (on, len(rows) - 1)] and [e.event for e in got] == list(range(1, len(got) + 1))
