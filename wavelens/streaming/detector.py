"""A detector with persistence over streams, whose rows may come late: state by capture with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "capture_id bigint, event bigint, start_n bigint, end_n bigint, start_us bigint, end_us bigint, is_open boolean"
_Event = Row(*(c.split()[0] for c in EVENT.split(", ")))

#: A held sample.
HELD = np.dtype([("us", "<i8"), ("v", "<f8")])

#: The time of a row that has none, in microseconds: before all others.
NO_TIME = -(2**63) // 1000


class _Detector(StatefulProcessor):
    """Rows are held until the watermark has passed them, then taken in order of time; a timer stands at the earliest row that
    came with a batch or was left of one, another at the end of silence, after which the state goes. The machine is a row of
    counters. Each call to the state is a message to the JVM, and each row of it is pickled, so held samples are a block of bytes for
    each batch, and timers that stand for nothing any more are left to fire."""

    def __init__(self, enter: float, leave: float, enter_n: int, leave_n: int, least: int, silence_ms: int):
        self.enter, self.leave, self.enter_n, self.leave_n, self.least = enter, leave, enter_n, leave_n, least
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "samples binary")  # as HELD
        # n samples taken; events so far; whether on; where the run that may turn it began (-1: none); where it turned on.
        self.machine = handle.getValueState("machine", "n bigint, events bigint, active boolean, run_n bigint, run_us bigint, start_n bigint, start_us bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = np.array([(row.us, np.nan if row.v is None else row.v) for row in rows], HELD)  # null and NaN tell the same
        self.held.appendValue((new.tobytes(),))
        self.handle.registerTimer(int(new["us"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.zeros(0, HELD), *(np.frombuffer(block, HELD) for block, in self.held.get())])
        held = held[np.argsort(held["us"], kind="stable")]
        passed = int(np.searchsorted(held["us"], reached, "right"))
        due, rest = held[:passed].tolist(), held[passed:]
        state = self.machine.get()
        n, events, active, run_n, run_us, start_n, start_us, last_us = state or (0, 0, False, -1, 0, 0, 0, 0)
        out = []

        def close(end_n: int, end_us: int, is_open: bool) -> None:
            nonlocal events
            if end_n - start_n >= self.least:
                out.append(_Event(key[0], events + 1, start_n, end_n, start_us, end_us, is_open))
                events += 1

        for ts, v in due:
            turns = (v != v or v <= self.leave) if active else v >= self.enter
            if not turns:
                run_n = -1
            elif run_n < 0:
                run_n, run_us = n, ts
            if turns and n - run_n + 1 >= (self.leave_n if active else self.enter_n):
                if active:
                    close(run_n, run_us, False)
                else:
                    start_n, start_us = run_n, run_us
                active, run_n = not active, -1
            n, last_us = n + 1, ts
        if due:
            self.machine.update((n, events, active, run_n, run_us, start_n, start_us, last_us))
            if len(rest):
                self.held.put([(rest.tobytes(),)])
            else:
                self.held.clear()
        if len(rest):
            self.handle.registerTimer(int(rest["us"][0]) // 1000 + 1)
        elif due or (state and last_us // 1000 + self.silence_ms > reached // 1000):
            self.handle.registerTimer(last_us // 1000 + self.silence_ms)
        elif state:
            if active:  # silent for long: what is on ends at the last sample
                close(n - 1, last_us, True)
            self.machine.clear()
        return iter(out)

    def close(self) -> None:
        pass


def hysteresis_events(samples: DataFrame, enter: float, leave: float, enter_n: int = 1, leave_n: int = 1, least: int = 0, late: str = "10 seconds", silence_ms: int = 60_000) -> DataFrame:
    """Events of a stream of samples(capture_id, ts, v), as operators.events.hysteresis finds them in a table (leave < enter).

    The detector turns on after enter_n samples at enter or above, off after leave_n at leave or below (or null or NaN);
    events go out when they end, those of under least samples not at all. Rows up to `late` behind the newest are put
    in order first; later ones are left out, as everywhere behind a watermark. A capture that is silent for silence_ms of
    event time ends: an event still on is given as open, and its state goes. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    if leave >= enter:
        raise ValueError("leave must lie below enter")
    machine = _Detector(float(enter), float(leave), enter_n, leave_n, least, silence_ms)
    rows = samples.select("capture_id", "ts", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us"), F.col("v").cast("double").alias("v")).withWatermark("ts", late)
    found = rows.groupBy("capture_id").transformWithState(machine, EVENT, "Append", "EventTime")
    return found.select("capture_id", "event", "start_n", "end_n", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "is_open")
