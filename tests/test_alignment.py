"""Sliding least squares and lags against plain loops, with planted lags, constant stretches and nulls."""

import math

import numpy as np
import pytest

from wavelens.operators import alignment


def pairs(spark, captures):
    rows = [(c, n, None if x is None else float(x), None if y is None else float(y)) for c, (xs, ys) in captures.items() for n, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "capture_id long, n long, x double, y double")


def plain_affine(x, y, width):
    half, n = width // 2, len(x)
    at = lambda v, i: v[min(max(i, 0), n - 1)]
    wins = [([at(x, i + d) for d in range(-half, half + 1)], [at(y, i + d) for d in range(-half, half + 1)]) for i in range(n)]
    var = [np.var(a) for a, _ in wins]
    floor = max(float(np.median(var)) * 0.03, 1e-9)
    out = []
    for i, (a, b) in enumerate(wins):
        if var[i] <= floor or i < half or i >= n - half:
            out.append(None)
            continue
        cov = np.mean((a - np.mean(a)) * (b - np.mean(b)))
        gain = cov / (var[i] + 1e-9)
        out.append((gain, np.mean(b) - gain * np.mean(a), np.clip(cov / (np.sqrt(var[i] * np.var(b)) + 1e-9), -1, 1), np.sqrt(np.mean(np.square(b))) / (np.sqrt(np.mean(np.square(a))) + 1e-9)))
    return out


@pytest.mark.parametrize("width", [3, 7])
def test_local_affine(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(0, 1, 60) + 1e5  # a large common level must not cost digits
    flat = np.concatenate([rng.normal(0, 1, 40), np.full(30, 2.5), rng.normal(0, 1, 40)])
    captures = {1: (x, 3 * x - 7), 2: (flat, rng.normal(0, 1, 110)), 3: (np.zeros(20), np.arange(20.0)), 4: ([1.0], [2.0])}
    got = {(r.capture_id, r.n): r for r in alignment.local_affine(pairs(spark, captures), width).collect()}
    assert len(got) == 60 + 110 + 20 + 1
    for c, (a, b) in captures.items():
        for n, want in enumerate(plain_affine(np.array(a), np.array(b), width)):
            r = got[c, n]
            assert r.valid == (want is not None)
            values = (r.gain, r.offset, r.correlation, r.rms_ratio)
            assert values == (None,) * 4 if want is None else np.allclose(values, want, rtol=1e-4, atol=1e-4)
    assert not any(got[2, n].valid for n in range(40 + width // 2, 70 - width // 2))


def test_local_affine_with_void_pairs(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(0, 1, 50).tolist(), rng.normal(0, 1, 50).tolist()
    x[20], y[30] = None, float("nan")
    got = {r.n: r.valid for r in alignment.local_affine(pairs(spark, {1: (x, y)}), 5).collect()}
    assert all(not got[n] for m in (20, 30) for n in range(m - 2, m + 3)) and sum(got.values()) > 30
    assert alignment.local_affine(pairs(spark, {1: ([1.0], [1.0])}).where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        alignment.local_affine(pairs(spark, {1: ([1.0], [1.0])}), 4)


def plain_lags(x, y, most):
    x, y = x - np.nanmean(x), y - np.nanmean(y)
    for lag in range(-most, most + 1):
        a, b = (x[-lag:], y[:lag]) if lag < 0 else (x[: len(x) - lag], y[lag:])
        keep = ~np.isnan(a) & ~np.isnan(b)
        yield lag, a[keep], b[keep]


def plain_best(x, y, most):
    best = (-math.inf, 0)
    for lag, a, b in plain_lags(x, y, most):
        a, b = a - a.mean(), b - b.mean()
        c = a @ b / (math.sqrt((a @ a) * (b @ b)) + 1e-12)
        if c > best[0] + 1e-12:
            best = (c, lag)
    return best[1], best[0]


def plain_fit(x, y, most):
    best = (-math.inf,)
    for lag, a, b in plain_lags(x, y, most):
        k = a @ b / (a @ a + 1e-18)
        r2 = 1 - ((b - k * a) ** 2).sum() / (((b - b.mean()) ** 2).sum() + 1e-18)
        wc2 = (a @ b / (math.sqrt((a @ a) * (b @ b)) + 1e-18)) ** 2
        if r2 + 0.25 * wc2 > best[0] + 1e-12:
            best = (r2 + 0.25 * wc2, k, max(-1, min(1, r2)), lag / 10, wc2)
    return best[1:]


@pytest.mark.parametrize("block", [1024, 16])
def test_lags(spark, block, monkeypatch):
    monkeypatch.setattr(alignment.lag_sums, "__defaults__", (block,))
    rng = np.random.default_rng(block)
    captures = {}
    for c, (shift, gain) in enumerate([(0, 1.0), (5, 2.0), (-7, -0.5), (3, 0.1), (8, 4.0)]):
        x = rng.normal(0, 1, 150) + 40
        captures[c] = (x, np.roll(x, shift) * gain + rng.normal(0, 0.02, 150))
    void = captures[1][1].copy()
    void[[3, 70, 71]] = np.nan
    captures[10] = (captures[1][0], void)
    captures[11] = (np.full(30, 2.0), np.full(30, 3.0))
    rows = pairs(spark, captures)
    lags = {r.capture_id: (r.lag, r.correlation) for r in alignment.best_lag(rows, 8).collect()}
    fits = {r.capture_id: (r.gain, r.r2, r.lag_s, r.wc2) for r in alignment.best_lag_gain(rows, 8, 10.0).collect()}
    assert [lags[c][0] for c in (0, 1, 3, 4, 10)] == [0, 5, 3, 8, 5] and [round(fits[c][2] * 10) for c in (0, 1, 2, 3, 4, 10)] == [0, 5, -7, 3, 8, 5]
    for c, (x, y) in captures.items():
        x = np.where(np.isnan(y), np.nan, x)  # a void pair is void on both sides
        if c != 11:
            assert np.allclose(lags[c], plain_best(x, y, 8), atol=1e-6) and np.allclose(fits[c], plain_fit(x, y, 8), atol=1e-6)
    assert lags[11] == (-8, 0.0)
    assert alignment.best_lag(rows.where("false"), 3).count() == 0


def test_local_affine_sorts_once(spark):
    rng = np.random.default_rng(2)
    some = pairs(spark, {c: (rng.normal(0, 1, 30), rng.normal(0, 1, 30)) for c in (1, 2, None)})
    found = alignment.local_affine(some, 5)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    prepared = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and prepared.count("Sort [") == 1 and prepared.count("Exchange hashpartitioning") == 1
    assert {r.capture_id for r in found.collect()} == {1, 2} and found.count() == 60
