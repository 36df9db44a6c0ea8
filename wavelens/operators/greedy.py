"""Greedy passes over captures in time order.

Rows are dealt by capture, sorted by time and streamed as Arrow batches; what a pass remembers is the span that later
rows can still change, so memory follows that span and not the capture. A capture is one task's work, as its passes are
sequential by definition.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, order: list[str], begin: Callable, kind: str) -> DataFrame:
    """rows(capture_id, ...) by capture in order through begin(): an object whose feed(columns) and finish() give rows
    (without the capture) of what is settled. A new one begins with each capture; null captures are a capture."""
    sorted_rows = rows.repartition("capture_id").sortWithinPartitions("capture_id", *order)
    names = [x.split()[0] for x in kind.split(", ")]
    capture_type = rows.schema["capture_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, types = None, None, None
        for batch in batches:
            capture = batch.column(0).to_pylist()
            types = [batch.schema.field(0).type, *types_of(kind)]
            columns, out, at = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], [], 0
            while at < len(capture):
                upto = at + 1
                while upto < len(capture) and capture[upto] == capture[at]:
                    upto += 1
                if state is None or capture[at] != current:
                    if state is not None:
                        out += [(current, *r) for r in state.finish()]
                    state, current = begin(), capture[at]
                out += [(current, *r) for r in state.feed([c[at:upto] for c in columns])]
                at = upto
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["capture_id", *names])
        if state is not None and (out := [(current, *r) for r in state.finish()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["capture_id", *names])

    return sorted_rows.mapInArrow(run, f"capture_id {capture_type}, {kind}")


def types_of(kind: str) -> list[pa.DataType]:
    return [{"bigint": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in kind.split(", ")]


class Chatter:
    """Windows of least or more edges that begin at an edge and end span later; they share no edge."""

    def __init__(self, span: float, least: int):
        self.span, self.least, self.t = span, least, np.zeros(0)

    def feed(self, columns):
        self.t = np.concatenate([self.t, columns[0]])
        return self._settle(self.t[-1])

    def finish(self):
        return self._settle(np.inf)

    def _settle(self, now: float) -> list:
        """Windows of those edges whose span has passed at time now."""
        t, out, at = self.t, [], 0
        ends = np.searchsorted(t, t + self.span, "right")
        settled = len(t) if now == np.inf else int(np.searchsorted(t + self.span, now, "left"))
        opens = np.flatnonzero(ends - np.arange(len(t)) >= self.least)
        while at < settled:
            k = int(np.searchsorted(opens, at))
            if k == len(opens) or opens[k] >= settled:
                at = settled
                break
            first = int(opens[k])
            at = int(ends[first])
            out.append((float(t[first]), float(t[at - 1]), at - first))
        self.t = t[at:]
        return out


def chatter(edges: DataFrame, span: float, least: int) -> DataFrame:
    """Windows (capture_id, start_s, end_s, edges) of least edges or more within span of their first edge.

    Windows are taken greedily in time and share no edge; an edge that opens none is passed over. Rows without a time
    are left out."""
    rows = edges.select("capture_id", F.col("t").cast("double").alias("t")).where("t IS NOT NULL AND NOT isnan(t)")
    return streamed(rows, ["t"], lambda: Chatter(span, least), "start_s double, end_s double, edges bigint")


class Matcher:
    """Each reference in turn takes the nearest free candidate within tolerance."""

    def __init__(self, tolerance: float):
        self.tolerance, self.waiting, self.t, self.ids = tolerance, [], [], []

    def feed(self, columns):
        for t, ident, side in zip(*(c.tolist() for c in columns), strict=True):
            if side:
                self.t.append(t)
                self.ids.append(ident)
            else:
                self.waiting.append((t, ident))
        return self._settle(columns[0][-1])

    def finish(self):
        return self._settle(np.inf)

    def _settle(self, now: float) -> list:
        """Matches of references whose candidates have all been seen at time now."""
        out, done = [], 0
        for at, ident in self.waiting:
            if at + self.tolerance >= now:
                break
            done += 1
            low, high = bisect_left(self.t, at - self.tolerance), bisect_right(self.t, at + self.tolerance)
            near = [(abs(self.t[i] - at), i) for i in range(low, high) if abs(self.t[i] - at) <= self.tolerance]
            if near:
                lag, i = min(near)
                out.append((ident, self.ids[i], lag))
                del self.t[i], self.ids[i]
        del self.waiting[:done]
        horizon = (self.waiting[0][0] if self.waiting else now) - self.tolerance
        k = bisect_left(self.t, horizon)
        del self.t[:k], self.ids[:k]
        return out


def greedy_match(references: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """(capture_id, reference_id, candidate_id, lag_s): references(capture_id, id, t) in order of time each take the
    nearest free candidate within tolerance, the earlier one of two equally near, the lesser id at equal times; every
    candidate is taken once at most. Rows without a time are left out."""
    both = references.select("capture_id", "t", "id", F.lit(0).alias("side")).union(candidates.select("capture_id", "t", "id", F.lit(1)))
    rows = both.select("capture_id", F.col("t").cast("double").alias("t"), F.col("id").cast("bigint").alias("id"), "side").where("t IS NOT NULL AND NOT isnan(t)")
    return streamed(rows, ["t", "id"], lambda: Matcher(tolerance), "reference_id bigint, candidate_id bigint, lag_s double")
