"""Signatures that bring their own code: registered by name, run over batches of captures, failures kept as results.

An analyzer takes a pandas batch of captures and gives a row or several (modes) for each. All analyzers see a batch in
one pass, nothing is shuffled; a batch is a slice of what Arrow brings. Where one fails, its batch is tried again row by row, so only the captures it cannot take
get an error row; the job and the other analyzers go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "capture_id bigint, signature_id string, family string, mode string, matched boolean, confidence double, reason string, error string"
FAILED = "signature_runtime_error"

#: Captures that analyzers see at a time: where one fails, each of them gets a frame of its own.
SLICE = 256


@dataclass(frozen=True)
class Analyzer:
    signature_id: str
    family: str
    analyze: Callable[[pd.DataFrame], pd.DataFrame]


class Registry:
    """Analyzers by signature, in the order in which they were registered."""

    def __init__(self):
        self.analyzers: dict[str, Analyzer] = {}

    def register_signature(self, signature_id: str, family: str, analyze: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        """analyze(batch) gives (capture_id, matched, confidence) and, if it likes, reason and mode. Raises on a name twice."""
        if signature_id in self.analyzers:
            raise ValueError(f"{signature_id} is registered already")
        self.analyzers[signature_id] = Analyzer(signature_id, family, analyze)


def _checked(analyzer: Analyzer, batch: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(analyzer.analyze(batch.copy()))
    if missing := {"capture_id", "matched", "confidence"} - set(out.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    if not set(batch.capture_id) <= set(out.capture_id) or not set(out.capture_id) <= set(batch.capture_id):
        raise ValueError("not a result for each capture")
    confidence = out.confidence.astype(float)
    if not confidence.between(0, 1).all():
        raise ValueError("confidence is not within 0 and 1")
    text = lambda c: out[c].astype(object).where(out[c].notna(), None) if c in out else None
    return pd.DataFrame({"capture_id": out.capture_id, "signature_id": analyzer.signature_id, "family": analyzer.family, "mode": text("mode"), "matched": out.matched.astype(bool), "confidence": confidence, "reason": text("reason"), "error": None})


def results(batch: pd.DataFrame, analyzers: list[Analyzer]) -> pd.DataFrame:
    """All analyzers' results over a batch, in the columns of RESULT."""
    parts = []
    for analyzer in analyzers:
        try:
            parts.append(_checked(analyzer, batch))
        except Exception:  # noqa: BLE001 - which captures it cannot take is found out one by one
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1]
                try:
                    parts.append(_checked(analyzer, one))
                except Exception as error:  # noqa: BLE001 - the failure is the result
                    parts.append(pd.DataFrame({"capture_id": one.capture_id, "signature_id": analyzer.signature_id, "family": analyzer.family, "mode": None, "matched": False, "confidence": 0.0, "reason": FAILED, "error": repr(error)}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])


def analyze(captures: DataFrame, registry: Registry) -> DataFrame:
    """RESULT rows of every analyzer for captures(capture_id, ...): one for each mode of each signature. Rows that repeat a
    capture_id are captures of their own. An empty table gives no rows."""
    analyzers = list(registry.analyzers.values())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield results(batch.iloc[at : at + SLICE], analyzers)

    return captures.mapInPandas(run, RESULT)


def best_modes(found: DataFrame) -> DataFrame:
    """One row for each capture and signature: its matched, most confident mode, ties by name; with modes, their number."""
    order = F.struct((~F.col("matched")).alias("a"), (-F.col("confidence")).alias("b"), F.coalesce("mode", F.lit("")).alias("c"))
    best = found.groupBy("capture_id", "signature_id").agg(F.min_by(F.struct("family", "mode", "matched", "confidence", "reason", "error"), order).alias("x"), F.count("*").alias("modes"))
    return best.select("capture_id", "signature_id", "x.*", "modes")


def decide(best: DataFrame) -> DataFrame:
    """(capture_id, winner, decision, top_signature, top_confidence, signatures, errors) of best_modes: matched first, then confidence,
    then signature; what failed ranks as unmatched with confidence 0."""
    entry = F.struct((~F.col("matched")).alias("a"), (-F.col("confidence")).alias("b"), "signature_id")
    top = best.groupBy("capture_id").agg(F.min(entry).alias("t"), F.count("*").alias("signatures"), F.count("error").alias("errors"))
    return top.select("capture_id", F.when(~F.col("t.a"), F.col("t.signature_id")).alias("winner"), F.when(F.col("t.a"), F.lit("no_match")).otherwise(F.lit("matched")).alias("decision"), F.col("t.signature_id").alias("top_signature"), (-F.col("t.b")).alias("top_confidence"), "signatures", "errors")


def register_pulse_table(spark: SparkSession, name: str, low: float, high: float) -> None:
    """A table function for SQL, name(TABLE(samples) PARTITION BY capture_id ORDER BY n), that gives each capture's pulses
    (capture_id, pulse, start_s, end_s, peak) of a Schmitt trigger: from a rise to high to the fall to low. A capture's rows
    stream through; a pulse under way at its begin or end is left out."""

    class Pulses:
        def __init__(self):
            self.state, self.start, self.peak, self.pulse, self.capture = None, None, None, 0, None

        def eval(self, row):
            self.capture, t, v = row["capture_id"], row["t"], row["v"]
            was, self.state = self.state, 1 if v >= high else 0 if v <= low else (1 if v >= (low + high) / 2 else 0) if self.state is None else self.state
            if self.state == 1 and was == 0:
                self.start, self.peak = t, v
            elif self.state == 1 and self.start is not None:
                self.peak = max(self.peak, v)
            elif self.state == 0 and was == 1 and self.start is not None:
                self.pulse += 1
                yield self.capture, self.pulse, self.start, t, self.peak
                self.start = None

    spark.udtf.register(name, F.udtf(Pulses, returnType="capture_id bigint, pulse bigint, start_s double, end_s double, peak double"))
