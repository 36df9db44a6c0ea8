"""Cross-spectra: planted tones of each class, peaks against a plain search, odd captures."""

import numpy as np
import pytest

from wavelens.operators import spectra

RATE, N = 4096.0, 512


def ensemble(rng, name, tones, captures=24):
    """tones: (line, amplitude in 1, amplitude in 2, phase of 2 after 1)."""
    t, rows = np.arange(N) / RATE, []
    for c in range(captures):
        r1, r2 = rng.normal(0, 0.02, N), rng.normal(0, 0.02, N)
        for line, a, b, phase in tones:
            start = rng.uniform(0, 2 * np.pi)
            hz = line * RATE / N
            r1 = r1 + a * np.cos(2 * np.pi * hz * t + start)
            r2 = r2 + b * np.cos(2 * np.pi * hz * t + start + np.radians(phase))
        rows.append((name, c, r1.tolist(), r2.tolist()))
    return rows


SCHEMA = "ensemble string, capture_id long, r1 array<double>, r2 array<double>"


def test_classes(spark):
    rng = np.random.default_rng(1)
    rows = ensemble(rng, "e", [(10, 1.0, 0.5, 0), (25, 1.0, 2.0, 180), (40, 1.0, 0.0, 0), (55, 0.0, 1.0, 0), (70, 1.0, 1.0, 90)]) + ensemble(rng, "quiet", [])
    odd = [("e", 100, None, None), ("e", 101, [1.0], [1.0]), ("e", 102, [1.0, None] * 8, [1.0] * 16), ("e", 103, [float("nan")] * 16, [1.0] * 16), ("e", 104, [1.0] * 16, [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = {round(r.hz / (RATE / N)): r for r in spectra.common_mode(df, RATE).where("ensemble = 'e'").collect()}
    assert {k: r.label for k, r in got.items()} == {10: "common-mode", 25: "differential / opposite-polarity", 40: "channel 1 local", 55: "channel 2 local", 70: "shared, non-common phase relation"}
    assert got[10].gain == pytest.approx(0.5, abs=0.02) and got[10].mean_a1 == pytest.approx(1, abs=0.02) and got[70].phase_deg == pytest.approx(90, abs=2) and got[10].occupancy2 == 1
    assert spectra.common_mode(df.where("ensemble = 'quiet'"), RATE).count() == 0 and spectra.common_mode(df.where("false"), RATE).count() == 0


def plain_spectrum(rows):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N) / N)
    s = [np.fft.rfft((np.array([r[i] for r in rows]) - np.mean([r[i] for r in rows], axis=1, keepdims=True)) * window, axis=1) for i in (2, 3)]
    cross = np.mean(np.conj(s[0]) * s[1], axis=0)
    return np.abs(cross) ** 2 / (np.mean(np.abs(s[0]) ** 2, axis=0) * np.mean(np.abs(s[1]) ** 2, axis=0)), np.degrees(np.angle(cross))


def test_cross_spectrum(spark):
    rows = ensemble(np.random.default_rng(2), "e", [(10, 1.0, 0.5, 30)])
    got = spectra.cross_spectrum(spectra.lines(spark.createDataFrame(rows, SCHEMA), RATE)).orderBy("k").collect()
    coherence, phase = plain_spectrum(rows)
    assert np.allclose([r.coherence for r in got], coherence) and np.allclose(np.cos(np.radians([r.phase_deg for r in got])), np.cos(np.radians(phase)), atol=1e-6)


def plain_peaks(v, height, prominence, distance):
    floor, n, found = np.median(v), len(v), []
    i = 1
    while i < n - 1:
        j = i
        while j < n - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < n - 1 and v[j + 1] < v[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = sorted((i for i in found if v[i] >= height * floor), key=lambda i: (-v[i], -i))
    kept = []
    for i in found:
        if all(abs(i - q) >= distance for q in kept):
            kept.append(i)
    out = []
    for i in kept:
        a = max((x for x in range(i) if v[x] > v[i]), default=0)
        b = min((x for x in range(i, n) if v[x] > v[i]), default=n - 1)
        if v[i] - max(v[a : i + 1].min(), v[i : b + 1].min()) >= prominence * floor:
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("distance", [1, 4])
def test_peaks(spark, distance):
    rng = np.random.default_rng(distance)
    spectrums = {i: np.round(rng.random(60) * 6) + 1 for i in range(12)} | {50: np.ones(8), 51: np.array([1.0, 2.0]), 52: np.arange(9) + 1.0}
    rows = [(e, k, float(k), float(v), 0.0) for e, vs in spectrums.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ensemble long, k int, hz double, mean_a1 double, mean_a2 double")
    got = {e: [] for e in spectrums}
    for r in spectra.peaks(df, (0.0, 1e9), 1.2, 0.3, float(distance)).collect():
        got[r.ensemble].append(r.k)
    assert {e: sorted(k) for e, k in got.items()} == {e: plain_peaks(v, 1.2, 0.3, distance) for e, v in spectrums.items()}


def test_lines_are_found_once(spark):
    """What is left to run reads the spectral lines from a table: no step transforms the captures again."""
    rows = [("e", i, [float((i * j) % 7) for j in range(32)], [float((i + j) % 5) for j in range(32)]) for i in range(6)]
    df = spectra.common_mode(spark.createDataFrame(rows, "ensemble string, capture_id long, r1 array<double>, r2 array<double>"), 3200.0, (5.0, 1600.0), 1.0, 0.02, 1.0, 1.2)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == df.select("hz").distinct().count()
