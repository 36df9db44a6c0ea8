"""Ranks, quantiles and slopes of large and lopsided groups against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest

from wavelens.operators import metrics, quantiles, ranks, slopes


def groups(spark):
    rng = np.random.default_rng(2)
    out = {"a": rng.normal(0, 1, 3000), "b": np.r_[rng.random(5000), 1e15], "c": np.r_[rng.random(500), math.inf, -math.inf], "d": np.full(4000, 7.0), None: rng.integers(0, 9, 300).astype(float), "e": np.array([math.inf, math.inf])}
    rows = [(g, float(v)) for g, vs in out.items() for v in vs] + [("a", None), ("a", math.nan), ("f", None)]
    return out, spark.createDataFrame(rows, "g string, v double")


def test_quantiles_hold_under_skew(spark):
    want, df = groups(spark)
    shares = [0.0, 0.25, 0.5, 1.0]
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(want)
    for g, vs in want.items():
        vs = np.sort(vs)
        at = [s * (len(vs) - 1) for s in shares]
        for q, x in zip(got[g][1], at, strict=True):
            a, b = vs[math.floor(x)], vs[math.ceil(x)]
            assert q == (a if a == b else pytest.approx(a + (b - a) * (x % 1)))
    chunks = ranks.counted(df.where("g = 'b'"), ["g"], "v")
    sizes = [r["count"] for r in chunks.groupBy("__chunk").count().collect()]
    assert sum(sizes) == 5001 and max(sizes) < 0.6 * sum(sizes)  # one far value doesn't put the others into one task


def test_average_ranks(spark):
    want, df = groups(spark)
    got = {(r.g, r.v): (r.k, r.n) for r in ranks.average_ranks(df, ["g"], "v").selectExpr("__g.g AS g", "__v AS v", "__rank AS k", "__size AS n").collect()}
    for g, vs in want.items():
        for v, k in zip(vs, pd.Series(vs).rank(), strict=True):
            assert got[g, float(v)] == (k, len(vs))


def test_rank_correlation(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in ("x", None, "y"):
        x, y = rng.integers(0, 12, 400).astype(float), rng.normal(0, 3, 400)
        y = np.round(y + x * {"x": 1, None: 0, "y": -2}[g])
        want[g] = pd.Series(x).rank().corr(pd.Series(y).rank())
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(g, None, 1.0), (g, math.nan, 2.0)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.n, r.rank_correlation) for r in ranks.rank_correlation(df, ["g"], "x", "y").collect()}
    assert got.pop("flat") == (5, None) and got.pop("few") == (2, None) and set(got) == set(want)
    assert all(got[g] == (400, pytest.approx(want[g])) for g in want)
    assert ranks.rank_correlation(df.where("false"), ["g"], "x", "y").count() == 0


def test_numbered_and_split(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 < 8, 'big', if(id % 10 = 8, 'small', NULL)) AS s")
    got = ranks.numbered(df, ["s"], ["id"]).toPandas()
    for _, part in got.groupby("s", dropna=False):
        part = part.sort_values("id")
        assert part["__r"].tolist() == list(range(1, len(part) + 1)) and (part["__n"] == len(part)).all()
    split = metrics.stratified_split(df, ["s"], "id", {"train": 0.6, "test": 0.4}).groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {("big", "train"): 1440, ("big", "test"): 960, ("small", "train"): 180, ("small", "test"): 120, (None, "train"): 180, (None, "test"): 120}


def all_slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    d = x[j] - x[i]
    return (float(np.median((y[j] - y[i])[d != 0] / d[d != 0])), int((d != 0).sum())) if (d != 0).any() else (None, 0)


@pytest.mark.parametrize("limits", [(8, 1000), (0, 20)])
def test_median_slope(monkeypatch, limits):
    monkeypatch.setattr(slopes, "LISTED", limits[0])
    monkeypatch.setattr(slopes, "LEAST", limits[1])
    rng = np.random.default_rng(6)
    for trial in range(200):
        n = int(rng.integers(1, 80))
        x, y = [(rng.normal(0, 10, n), rng.normal(0, 1, n)), (rng.integers(0, 6, n) * 1.0, rng.normal(0, 1, n)), (np.arange(n) * 1.0, 3 * np.arange(n) + rng.integers(0, 2, n)), (np.arange(n) * 0.1, np.arange(n) * 0.2), (np.arange(n) + 1e9, rng.integers(0, 3, n) * 1.0)][trial % 5]
        slope, pairs = slopes.median_slope(x, y)
        want = all_slopes(x, y)
        assert pairs == want[1] and (slope is None) == (want[0] is None) and (slope is None or slope == pytest.approx(want[0], rel=1e-8, abs=1e-8))


def test_theil_sen(spark):
    rng = np.random.default_rng(8)
    n = 100_000
    far = pd.DataFrame({"g": "long", "x": np.arange(n) * 1.0, "y": np.arange(n) * 0.25 + rng.normal(0, 5, n)})
    short = pd.DataFrame({"g": ["s", "s", "s", "one", "v", "v", None, None], "x": [1.0, 2.0, 4.0, 1.0, 1.0, 1.0, 0.0, 1.0], "y": [0.0, 1.0, 9.0, 1.0, 5.0, 6.0, math.nan, 1.0]})
    got = {r.g: (r.slope, r.pairs) for r in slopes.theil_sen(spark.createDataFrame(pd.concat([far, short])), "g").collect()}
    assert set(got) == {"long", "s"} and got["s"] == (3.0, 3)
    slope, pairs = got["long"]
    assert pairs == n * (n - 1) // 2 and slope == pytest.approx(0.25, abs=1e-4)
    x, y = far.x.to_numpy(), far.y.to_numpy()
    below, upto = (slopes._merged(slopes._order(x, y, slope + d), False) for d in (-1e-12, 1e-12))
    assert below <= pairs // 2 <= upto + 1


def test_median_slope_to_the_last_bit(monkeypatch):
    """Slopes are of the points as given, not less an origin: a median at a rounding limit falls on the side that SQL has."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = np.arange(64.0), rng.integers(1, 20_000, 64) / 100
        i, j = np.triu_indices(64, 1)
        assert slopes.median_slope(x, y)[0] == np.median((y[j] - y[i]) / (x[j] - x[i]))
    monkeypatch.setattr(slopes, "LISTED", 0)
    monkeypatch.setattr(slopes, "LEAST", 10)
    y = np.arange(64.0) * 0.07 + 0.3  # more pairs of one slope than are listed: one of theirs
    assert slopes.median_slope(x, y)[0] in (y[j] - y[i]) / (x[j] - x[i])
