"""Streams of samples(capture_id, ts, v): windows, sessions, hysteresis and interval joins by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(samples: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, mean and RMS by capture and tumbling window, or sliding by slide (a row is in width / slide windows); rows later
    than late go."""
    w = samples.withWatermark("ts", late).groupBy("capture_id", F.window("ts", width, slide).alias("w"))
    return w.agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")).select("capture_id", F.col("w.start").alias("start"), "count", "mean", "rms")


def gap_sessions(samples: DataFrame, gap: str, late: str) -> DataFrame:
    """Episodes: sessions of a capture's rows that end where none comes for gap."""
    s = samples.withWatermark("ts", late).groupBy("capture_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("last"))


def interval_pairs(sources: DataFrame, outputs: DataFrame, least: str, most: str, late: str) -> DataFrame:
    """Pairs of a source and an output of the same capture that follows after least to most; both states are bounded by the
    watermarks. sources(capture_id, ts, source_id), outputs(capture_id, ts, output_id)."""
    a = sources.withWatermark("ts", late).selectExpr("capture_id AS a_capture", "ts AS a_ts", "source_id")
    b = outputs.withWatermark("ts", late).selectExpr("capture_id AS b_capture", "ts AS b_ts", "output_id")
    on = F.expr(f"a_capture = b_capture AND b_ts >= a_ts + INTERVAL {least} AND b_ts <= a_ts + INTERVAL {most}")
    return a.join(b, on).selectExpr("a_capture AS capture_id", "source_id", "output_id", "a_ts", "b_ts")


def first_seen(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """rows without those whose keys were seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def hysteresis_changes(samples: DataFrame, enter: float, leave: float) -> DataFrame:
    """(capture_id, ts, state): changes of a detector that turns on at enter or above and off at leave or below, in order of
    time within a batch of input. The state of a capture is one row: its state and the last time seen; rows older than
    that are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, last = state.get if state.exists else (False, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, v in zip(rows.ts, rows.v, strict=True):
            stamp = ts.value // 1000
            if last is not None and stamp < last:
                continue
            last = stamp
            now = True if v >= enter else False if v <= leave or v != v else on
            if now != on:
                out.append((key[0], ts, int(now)))
            on = now
        state.update((on, last))
        yield pd.DataFrame(out, columns=["capture_id", "ts", "state"]).astype({"ts": "datetime64[ns]"})

    return samples.groupBy("capture_id").applyInPandasWithState(run, "capture_id bigint, ts timestamp, state int", "on boolean, last bigint", "append", GroupStateTimeout.NoTimeout)
