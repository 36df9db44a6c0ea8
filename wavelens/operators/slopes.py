"""Median slope of all pairs of points, without the pairs.

With points in order of x, the pairs whose slope lies below s are the inversions of y - s x, which a merge sort counts. So
the slope is bisected: each step counts the pairs below it, until few enough lie between two slopes to be listed (as the
inversions between the orders at both), and the median is picked among these by its exact rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are listed at a time: so many by point, or in all.
LISTED, LEAST = 8, 100_000


def _merged(order: np.ndarray, pairs: bool, most: int | None = None):
    """Inversions of a permutation by merging ever wider blocks: their number, or (places i < j with order[i] > order[j]), `most`
    of them at least where there are more."""
    n, total, found = len(order), 0, []
    values, place, width = order.astype(np.int64), np.arange(n), 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = np.arange(n) // width % 2 == 0
        key = block * n + values  # blocks are sorted within, so both sides' keys are
        a, b = key[left], key[~left]
        after = np.searchsorted(a, b, "right")
        ends = np.searchsorted(a, (block[~left] + 1) * n)
        if pairs:
            more = ends - after
            if most is not None:  # whole elements, up to the first that reaches it
                more[np.cumsum(more) - more >= most] = 0
            at = np.repeat(after - np.concatenate([[0], np.cumsum(more)[:-1]]), more) + np.arange(more.sum())
            found.append((place[left][at], np.repeat(place[~left], more)))
            if most is not None and (most := most - len(at)) <= 0:
                break
        else:
            total += int((ends - after).sum())
        sort = np.argsort(key, kind="stable")
        values, place = values[sort], place[sort]
        width *= 2
    if not pairs:
        return total
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _order(x: np.ndarray, y: np.ndarray, slope: float) -> np.ndarray:
    """Each point's place by y - slope x. Points of equal x, in order of y, never count as an inversion, nor do equal values."""
    z = y - slope * x
    out = np.empty(len(z), np.int64)
    out[np.argsort(z, kind="stable")] = np.arange(len(z))
    return out


def median_slope(x: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """The median of the slopes of all pairs with different x (the mean of the two in the middle of an even number), and the
    number of such pairs; (None, 0) without any. Slopes that rounding can't tell from each other count as one."""
    sort = np.lexsort((y, x))
    x, y = x[sort], y[sort]
    n = len(x)
    same = np.unique(x, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return None, 0
    exact = x, y  # slopes returned are of the points as given; counts take them less an origin
    x, y = x - x[0], y - y[0]
    wanted = sorted({(pairs - 1) // 2, pairs // 2})
    gaps = np.diff(x)
    steps = np.abs(np.diff(y)[gaps > 0] / gaps[gaps > 0])
    top = float(steps.max()) if same.max() == 1 else float((y.max() - y.min()) / gaps[gaps > 0].min())
    top = top * 1.01 + 1e-300
    near = lambda slope: max(abs(slope), top * 1e-3) * 1e-11  # noqa: E731 - beyond what rounding moves
    rng = np.random.default_rng(1)

    def listed(low: float, high: float, most: int | None = None) -> np.ndarray:
        """The slopes between low and high, in order; `most` of them at least where there are more."""
        if (low, high) == (-top, top):
            i, j = np.triu_indices(n, 1)
        else:
            back = np.argsort(_order(x, y, low))
            i, j = (back[k] for k in _merged(_order(x, y, high)[back], True, most))
            i, j = np.minimum(i, j), np.maximum(i, j)
        keep = x[i] < x[j]
        i, j = i[keep], j[keep]
        return np.sort((exact[1][j] - exact[1][i]) / (exact[0][j] - exact[0][i]))

    def one(middle: float) -> float:
        """A slope that rounding can't tell from middle, of points; middle where none is found."""
        slopes = listed(middle - near(middle), middle + near(middle), LEAST)
        return float(slopes[len(slopes) // 2]) if len(slopes) else middle

    def search(low: float, high: float, below: int, upto: int, ranks: list[int]) -> list[float]:
        tries = 0
        while upto - below > max(LISTED * n, LEAST):
            middle = low + (high - low) * (0.5 if not tries else rng.uniform(0.3, 0.7))
            if high - low <= 4 * near(middle):
                return [one(middle)] * len(ranks)  # equal but for rounding
            a, b = (_merged(_order(x, y, middle + d), False) for d in (-near(middle), near(middle)))
            if a <= ranks[0] and ranks[-1] < b:
                return [one(middle)] * len(ranks)
            if a != b and tries < 8:  # slopes lie where the count would be unsure: try beside them
                tries += 1
                continue
            tries = 0
            if b <= ranks[0]:
                low, below = middle + near(middle), b
            elif a > ranks[-1]:
                high, upto = middle - near(middle), a
            else:  # the two ranks lie on either side
                return [slope for rank in ranks for slope in search(low, high, below, upto, [rank])]
        slopes = listed(low, high)
        return slopes[[min(max(rank - below, 0), len(slopes) - 1) for rank in ranks]].tolist()

    return float(np.mean(search(-top, top, 0, pairs, wanted))), pairs


def theil_sen(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, slope, pairs): the median of the slopes of all pairs of a group's points with different x, and their number.

    Points whose x or y is null, NaN or infinite count for nothing; a group without a pair has no row. A group is one
    task's work in n log n a step, of its points alone; other columns are ignored."""
    kind = points.schema[by].dataType.simpleString()
    rows = points.select(F.col(by).alias("by"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < double('infinity') AND abs(y) < double('infinity')")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        slope, pairs = median_slope(group.x.to_numpy(), group.y.to_numpy())
        return pd.DataFrame({"by": group.by.iloc[:1] if pairs else group.by.iloc[:0], "slope": slope, "pairs": pairs})

    return rows.groupBy("by").applyInPandas(fit, f"by {kind}, slope double, pairs bigint").withColumnRenamed("by", by)
