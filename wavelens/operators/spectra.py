"""Cross-spectra of two channels over an ensemble of captures.

Each capture's residuals are transformed where they lie (a batch at a time); what is aggregated over captures are rows
(ensemble, k, re1, im1, re2, im2), so an ensemble is never gathered. Only its spectra, of a bounded number of lines, are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise
from .quantiles import quantiles

#: Limits of the labels, and the smallest divisor.
COHERENT, PHASE_DEG, PRESENT, ABSENT, TINY = 0.85, 20.0, 0.5, 0.25, float(np.finfo(float).eps)


def lines(captures: DataFrame, rate: float) -> DataFrame:
    """captures(ensemble, capture_id, r1, r2: arrays of double of one length) as rows (ensemble, capture_id, k, hz, re1, im1,
    re2, im2, a1, a2): the one-sided transform under a periodic Hann window, less the mean, and amplitudes corrected for the
    window (lines at 0 and at half the rate count once). Captures whose channels are null, empty, of unlike length or hold
    nulls or non-finite values have no rows."""
    number = "forall(r, x -> x IS NOT NULL AND abs(x) < double('infinity'))"
    usable = captures.where(f"size(r1) = size(r2) AND size(r1) > 1 AND {number.replace('(r,', '(r1,')} AND {number.replace('(r,', '(r2,')}")

    def one(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = values.shape[1]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        spectrum = np.fft.rfft((values - values.mean(1, keepdims=True)) * window, axis=1)
        amplitude = np.abs(spectrum) * 2 / window.sum()
        amplitude[:, 0] *= 0.5
        if n % 2 == 0:
            amplitude[:, -1] *= 0.5
        return spectrum, amplitude

    def run(batches):
        for batch in batches:
            ensemble, capture, r1, r2 = batch.columns
            size = np.diff(r1.offsets.to_numpy())
            for n in np.unique(size).tolist():  # captures of one length make a matrix
                at = pa.array(np.flatnonzero(size == n))
                (s1, a1), (s2, a2) = (one(r.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for r in (r1, r2))
                k = s1.shape[1]
                again = pa.array(np.repeat(np.flatnonzero(size == n), k))
                number = np.tile(np.arange(k), len(s1))
                columns = [number.astype(np.int32), number * rate / n, *(x.ravel() for x in (s1.real, s1.imag, s2.real, s2.imag, a1, a2))]
                yield pa.RecordBatch.from_arrays([ensemble.take(again), capture.take(again), *map(pa.array, columns)], names)

    names = ["ensemble", "capture_id", "k", "hz", "re1", "im1", "re2", "im2", "a1", "a2"]
    types = dict(captures.select("ensemble", "capture_id").dtypes)
    kind = f"ensemble {types['ensemble']}, capture_id {types['capture_id']}, k int, hz double, " + ", ".join(f"{c} double" for c in names[4:])
    return usable.select("ensemble", "capture_id", F.col("r1").cast("array<double>"), F.col("r2").cast("array<double>")).mapInArrow(run, kind)


def cross_spectrum(rows: DataFrame) -> DataFrame:
    """(ensemble, k, hz, captures, mean_a1, mean_a2, coherence, phase_deg) of lines: coherence is |mean conj(R1) R2|^2 over the
    product of the mean powers, the phase that of channel 2 after channel 1."""
    power = lambda i: F.avg(F.expr(f"re{i} * re{i} + im{i} * im{i}")).alias(f"s{i}")
    out = rows.groupBy("ensemble", "k", "hz").agg(F.count("*").alias("captures"), F.avg("a1").alias("mean_a1"), F.avg("a2").alias("mean_a2"), power(1), power(2), F.avg(F.expr("re1 * re2 + im1 * im2")).alias("re"), F.avg(F.expr("re1 * im2 - im1 * re2")).alias("im"))
    coherence = F.expr(f"(re * re + im * im) / greatest(s1 * s2, {TINY!r}D)")
    return out.select("ensemble", "k", "hz", "captures", "mean_a1", "mean_a2", coherence.alias("coherence"), F.degrees(F.atan2("im", "re")).alias("phase_deg"))


def peaks(spectrum: DataFrame, band: tuple[float, float], height: float, prominence: float, distance_hz: float) -> DataFrame:
    """(ensemble, k) of the spectral peaks: local maxima within band of the greater mean amplitude (the middle of a flat top)
    of at least height times the band's median, of which those closer than distance_hz to a higher one go (of equal ones the
    lower), and whose prominence (height over the higher of the lowest points towards higher ground on either side) is
    at least prominence times the median. An ensemble's spectrum, of as many lines as half a capture, is one row here."""
    inside = spectrum.where((F.col("hz") >= band[0]) & (F.col("hz") <= band[1])).select("ensemble", F.struct("k", "hz", F.greatest("mean_a1", "mean_a2").alias("v")).alias("s"))
    one = inside.groupBy("ensemble").agg(F.array_sort(F.collect_list("s")).alias("s")).withColumn("v", F.expr("transform(s, x -> x.v)"))
    one = one.withColumn("o", F.expr("array_sort(v)")).withColumn("floor", F.expr("(o[(size(o) - 1) DIV 2] + o[size(o) DIV 2]) / 2")).withColumn("n", F.size("v"))
    step = F.expr(f"if(n > 1, greatest(1, int(round({float(distance_hz)!r}D / (s[1].hz - s[0].hz)))), 1)")
    # A flat top runs from i (left neighbour lower) to the last of its equals, whose right neighbour is lower.
    top = """filter(transform(sequence(1, greatest(n - 2, 1)), i -> named_struct('i', i, 'j', aggregate(sequence(i, n - 1), i, (a, x) -> if(x = a + 1 AND v[x] = v[i], x, a)))),
        p -> p.j < n - 1 AND v[p.i - 1] < v[p.i] AND v[p.j + 1] < v[p.i])"""
    found = one.where("n > 2").withColumn("step", step).withColumn("p", F.expr(f"filter(transform({top}, p -> int((p.i + p.j) DIV 2)), i -> v[i] >= {float(height)!r}D * floor)"))
    order = "array_sort(p, (a, b) -> CASE WHEN v[a] > v[b] OR (v[a] = v[b] AND a > b) THEN -1 WHEN a = b THEN 0 ELSE 1 END)"
    kept = found.withColumn("p", F.expr(f"aggregate({order}, cast(array() AS array<int>), (got, i) -> if(exists(got, q -> abs(q - i) < step), got, concat(got, array(i))))"))
    left = "array_min(slice(v, coalesce(array_max(filter(sequence(0, i), x -> v[x] > v[i])), 0) + 1, i - coalesce(array_max(filter(sequence(0, i), x -> v[x] > v[i])), 0) + 1))"
    right = "array_min(slice(v, i + 1, coalesce(array_min(filter(sequence(i, n - 1), x -> v[x] > v[i])), n - 1) - i + 1))"
    return kept.select("ensemble", F.explode(F.expr(f"transform(filter(p, i -> v[i] - greatest({left}, {right}) >= {float(prominence)!r}D * floor), i -> s[i].k)")).alias("k"))


def common_mode(captures: DataFrame, rate: float, band: tuple[float, float] = (5.0, 800.0), height: float = 12.0, prominence: float = 8.0, distance_hz: float = 8.0, occupied: float = 8.0) -> DataFrame:
    """Classes of an ensemble's spectral peaks by how the two channels share them.

    A row for each peak: ensemble, hz, mean_a1, mean_a2, gain (median over captures of a2 / a1 where channel 1 has the line),
    gain_mad (their median deviation, relative), coherence, phase_deg, occupancy1, occupancy2 (share of captures in which the line
    exceeds `occupied` times the capture's median amplitude in band) and label. Ensembles without peaks have no row."""
    rows = materialise(lines(captures, rate))  # read several times; transforms and references are found once
    spectrum = materialise(cross_spectrum(rows))
    at = peaks(spectrum, band, height, prominence, distance_hz)
    inside = rows.where((F.col("hz") >= band[0]) & (F.col("hz") <= band[1]))
    # A capture's own floor: over its lines, which lie in one row of few numbers.
    floors = inside.groupBy("ensemble", "capture_id").agg(F.median("a1").alias("floor1"), F.median("a2").alias("floor2"))
    met = inside.join(at, ["ensemble", "k"]).join(floors, ["ensemble", "capture_id"]).withColumn("on1", F.col("a1") > occupied * F.col("floor1")).withColumn("on2", F.col("a2") > occupied * F.col("floor2"))
    met = materialise(met.select("ensemble", "k", "a1", "a2", "on1", "on2"))
    share = met.groupBy("ensemble", "k").agg(F.avg(F.col("on1").cast("double")).alias("occupancy1"), F.avg(F.col("on2").cast("double")).alias("occupancy2"))
    ratios = met.where("on1").select("ensemble", "k", F.expr(f"a2 / greatest(a1, {TINY!r}D)").alias("ratio"))
    gain = quantiles(ratios, ["ensemble", "k"], "ratio", [0.5]).select("ensemble", "k", F.col("q")[0].alias("gain"))
    away = ratios.join(gain, ["ensemble", "k"]).withColumn("d", F.abs(F.col("ratio") - F.col("gain")))
    mad = quantiles(away, ["ensemble", "k"], "d", [0.5]).select("ensemble", "k", F.col("q")[0].alias("mad"))
    out = spectrum.join(at, ["ensemble", "k"]).join(share, ["ensemble", "k"]).join(gain, ["ensemble", "k"], "left").join(mad, ["ensemble", "k"], "left")
    both = f"occupancy1 >= {PRESENT} AND occupancy2 >= {PRESENT}"
    label = f"""CASE WHEN coherence >= {COHERENT} AND abs(phase_deg) <= {PHASE_DEG} AND {both} THEN 'common-mode'
        WHEN coherence >= {COHERENT} AND 180 - abs(phase_deg) <= {PHASE_DEG} AND {both} THEN 'differential / opposite-polarity'
        WHEN occupancy1 >= {PRESENT} AND occupancy2 < {ABSENT} THEN 'channel 1 local' WHEN occupancy2 >= {PRESENT} AND occupancy1 < {ABSENT} THEN 'channel 2 local'
        WHEN coherence >= {COHERENT} THEN 'shared, non-common phase relation' ELSE 'unclassified residual' END"""
    return out.select("ensemble", "hz", "mean_a1", "mean_a2", "gain", (F.col("mad") / F.greatest("gain", F.lit(TINY))).alias("gain_mad"), "coherence", "phase_deg", "occupancy1", "occupancy2", F.expr(label).alias("label"))
