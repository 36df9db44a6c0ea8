"""Features of a waveform against a reference, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FEATURES = ["gain", "rms_ratio", "peak_ratio", "correlation", "low_freq_ratio", "mid_freq_ratio", "high_freq_ratio", "edge_segments", "zero_crossings", "derivative_rms", "initial_vs_final_rms", "residual_energy_ratio"]
#: Band edges in hertz, and floors of denominators.
LOW_HZ, MID_HZ, TINY, FLOOR = 120.0, 1000.0, 1e-12, 1e-9


def rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.mean(x * x, axis=1))


def bands(x: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the amplitude spectrum (symmetric Hann window, median removed) in three bands, by row."""
    n = x.shape[1]
    amplitude = np.abs(np.fft.rfft((x - np.median(x, axis=1, keepdims=True)) * np.hanning(n), axis=1))
    hertz = np.arange(n // 2 + 1)[None, :] * rate[:, None] / n
    total = amplitude.sum(1) + TINY
    low, upto = (amplitude * (hertz <= LOW_HZ)).sum(1), (amplitude * (hertz <= MID_HZ)).sum(1)
    return low / total, (upto - low) / total, (amplitude * (hertz > MID_HZ)).sum(1) / total


def features(p: np.ndarray, r: np.ndarray, rate: np.ndarray) -> pd.DataFrame:
    """All features of waveforms p against references r (captures x samples)."""
    n = p.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(np.abs(r) > FLOOR, p / np.where(np.abs(r) > FLOOR, r, 1), np.nan)
        some = np.isfinite(ratio).any(1)
        gain = np.ones(len(p))
        if some.any():
            gain[some] = np.nanmedian(np.where(np.isfinite(ratio[some]), ratio[some], np.nan), axis=1)
        dp, dr = p - p.mean(1, keepdims=True), r - r.mean(1, keepdims=True)
        corr = (dp * dr).sum(1) / np.sqrt((dp * dp).sum(1) * (dr * dr).sum(1))
    reference = np.maximum(rms(r), TINY)
    step = np.diff(p, axis=1)
    centre = np.median(step, axis=1, keepdims=True)
    limit = np.maximum(FLOOR, 6 * 1.4826 * np.median(np.abs(step - centre), axis=1, keepdims=True))
    active = np.abs(step) > limit
    level = p - np.median(p, axis=1, keepdims=True)
    edge = max(4, n // 4)
    low, mid, high = bands(p, rate)
    values = [
        gain,
        rms(p) / reference,
        np.abs(p).max(1) / np.maximum(np.abs(r).max(1), TINY),
        np.nan_to_num(corr, nan=0.0, posinf=0.0, neginf=0.0),
        low,
        mid,
        high,
        (active[:, :1].sum(1) + (active[:, 1:] & ~active[:, :-1]).sum(1)).astype(float),
        (level[:, 1:] * level[:, :-1] < 0).sum(1).astype(float),
        rms(step),
        rms(p[:, :edge]) / np.maximum(rms(p[:, -edge:]), TINY),
        rms(p - r) / reference,
    ]
    return pd.DataFrame(dict(zip(FEATURES, values, strict=True)))


def pair_features(captures: DataFrame) -> DataFrame:
    """captures(capture_id, reference_label, rate, primary, reference, ...) with the features in place of both vectors.

    A pair that cannot be analysed (under 8 samples, unequal lengths, null or non-finite samples, rate not positive)
    keeps its row, with null features and the reason in reject_reason. One narrow pass, no shuffle.
    """
    kept = [f for f in captures.schema.fields if f.name not in ("primary", "reference")]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{f} double" for f in FEATURES] + ["reject_reason string"])

    def reason(p, r, rate) -> str | None:
        if rate is None or not rate > 0:
            return "sample_rate"
        if p is None or len(p) < 8:
            return "too_short"
        if r is None or len(r) != len(p):
            return "reference_length"
        both = np.array([*p, *r], dtype=float)
        return None if np.isfinite(both).all() else "not_finite"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            why = [reason(*x) for x in zip(pdf.primary, pdf.reference, pdf.rate, strict=True)]
            out = pdf[[f.name for f in kept]].assign(**dict.fromkeys(FEATURES, np.nan), reject_reason=why)
            good = pd.Series([w is None for w in why], index=pdf.index)
            for _, rows in pdf[good].groupby(pdf.primary[good].map(len)):
                found = features(np.array(rows.primary.tolist(), float), np.array(rows.reference.tolist(), float), rows.rate.to_numpy(float))
                out.loc[rows.index, FEATURES] = found.to_numpy()
            out[FEATURES] = out[FEATURES].astype(object).where(out[FEATURES].notna(), None)
            yield out

    return captures.mapInPandas(run, kind)
