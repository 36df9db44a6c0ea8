"""A capture against its reference, sample by sample: sliding least squares, and the lag at which both agree best.

Pairs are rows (capture_id, n, x, y) with n from 0 without gaps: x the reference, y the signal. A null or NaN on either
side makes a pair void: it stands in its place, and what touches it is void too or leaves it out, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms that keep divisors from zero, and the share of a capture's median reference variance under which a
#: stretch says nothing about gain.
EPSILON, EXCITED = 1e-9, 0.03
CORR_FLOOR, FIT_FLOOR, WC2_WEIGHT = 1e-12, 1e-18, 0.25


def _centred(pairs: DataFrame) -> DataFrame:
    """pairs with void ones as nulls on both sides, and cx, cy: less the capture's means, against cancellation in sums. Rows
    without a capture are left out."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    whole = Window.partitionBy("capture_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    clean = pairs.where("capture_id IS NOT NULL").select("capture_id", "n", F.when(ok, F.col("x").cast("double")).alias("x"), F.when(ok, F.col("y").cast("double")).alias("y"))
    return clean.withColumns({"mx": F.avg("x").over(whole), "my": F.avg("y").over(whole)}).withColumn("cx", F.col("x") - F.col("mx")).withColumn("cy", F.col("y") - F.col("my"))


def local_affine(pairs: DataFrame, width: int) -> DataFrame:
    """(capture_id, n, gain, offset, correlation, rms_ratio, valid): least squares y = offset + gain x over the width (odd)
    samples around each, the correlation there (within -1 and 1), and the RMS of y over that of x.

    A sample is valid if a whole window lies around it, without void pairs, and the variance of x in it exceeds 3 % of the
    capture's median (and 1e-9); elsewhere all four are null. For that median, windows over a capture's ends repeat the first
    and last sample. Means, window sums and the median all run over one sort by capture, nothing is joined; moments are about the
    capture's means."""
    if width % 2 == 0 or width < 3:
        raise ValueError("width must be odd and at least 3")
    half = width // 2
    whole = Window.partitionBy("capture_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = Window.partitionBy("capture_id").orderBy("n").rowsBetween(-half, half)
    rows = _centred(pairs).withColumn("size", F.count("*").over(whole))
    before = F.greatest(F.lit(0), F.lit(half) - F.col("n"))
    after = F.greatest(F.lit(0), F.col("n") + half - (F.col("size") - 1))

    def mean(value):
        return (F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / width

    held = F.count("cx").over(near) + before * F.first(F.col("cx").isNotNull().cast("int")).over(whole) + after * F.last(F.col("cx").isNotNull().cast("int")).over(whole)
    cx, cy = F.col("cx"), F.col("cy")
    rows = rows.select("capture_id", "n", "size", "mx", "my", held.alias("held"), mean(cx).alias("ax"), mean(cy).alias("ay"), mean(cx * cx).alias("axx"), mean(cy * cy).alias("ayy"), mean(cx * cy).alias("axy"))
    rows = rows.withColumn("var_x", F.when(F.col("held") == width, F.greatest(F.col("axx") - F.col("ax") * F.col("ax"), F.lit(0.0))))
    rows = rows.withColumn("floor", F.greatest(EXCITED * F.median("var_x").over(Window.partitionBy("capture_id")), F.lit(EPSILON))).withColumn("valid", F.coalesce((F.col("var_x") > F.col("floor")) & (F.col("n") >= half) & (F.col("n") < F.col("size") - half), F.lit(False)))
    rows = rows.withColumn("var_y", F.greatest(F.col("ayy") - F.col("ay") * F.col("ay"), F.lit(0.0))).withColumn("cov", F.col("axy") - F.col("ax") * F.col("ay"))
    rows = rows.withColumn("b", F.col("cov") / (F.col("var_x") + EPSILON)).withColumn("x_", F.col("ax") + F.col("mx")).withColumn("y_", F.col("ay") + F.col("my"))
    corr = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cov") / (F.sqrt(F.col("var_x") * F.col("var_y")) + EPSILON)))
    ratio = F.sqrt(F.col("var_y") + F.col("y_") * F.col("y_")) / (F.sqrt(F.col("var_x") + F.col("x_") * F.col("x_")) + EPSILON)
    valid = lambda c: F.when(F.col("valid"), c)
    return rows.select("capture_id", "n", valid(F.col("b")).alias("gain"), valid(F.col("y_") - F.col("b") * F.col("x_")).alias("offset"), valid(corr).alias("correlation"), valid(ratio).alias("rms_ratio"), "valid")


def lag_sums(pairs: DataFrame, most: int, block: int = 1024) -> DataFrame:
    """(capture_id, lag, m, sx, sy, sxx, syy, sxy): for each lag from -most to most, sums over the pairs of x at n and y at
    n + lag, both less the capture's means.

    A capture is cut into blocks of samples, each an array with most samples more of y on both sides, so a sample meets
    only what lies within the lags; products arise inside the block's task and leave it as sums by lag. A block is a row
    of bounded size, so a capture of any length is spread over tasks. Void pairs are left out at each lag."""
    block = max(block, most, 1)
    rows = _centred(pairs).select("capture_id", "n", "cx", "cy")
    own = F.expr(f"n DIV {block}")
    spread = rows.select("capture_id", "n", "cx", "cy", own.alias("own"), F.explode(F.expr(f"sequence(greatest(n - {most}, 0) DIV {block}, (n + {most}) DIV {block})")).alias("block"))
    packed = spread.groupBy("capture_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "cx", "cy", (F.col("own") == F.col("block")).alias("here")))).alias("at"))
    each = packed.select("capture_id", F.expr("at[0].n").alias("first"), F.expr("transform(at, s -> s.cy)").alias("ys"), F.explode(F.expr("filter(at, s -> s.here AND s.cx IS NOT NULL)")).alias("s"))
    each = each.select("capture_id", "first", "ys", F.col("s.n").alias("n"), F.col("s.cx").alias("x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    met = each.select("capture_id", "lag", "x", F.expr("if(n + lag < first, NULL, get(ys, int(n + lag - first)))").alias("y")).where("y IS NOT NULL")
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    return met.groupBy("capture_id", "lag").agg(F.count("*").alias("m"), total("x", "sx"), total("y", "sy"), total("x * x", "sxx"), total("y * y", "syy"), total("x * y", "sxy"))


def best_lag(pairs: DataFrame, most: int) -> DataFrame:
    """(capture_id, lag, correlation): the lag within most samples at which y correlates best with x (a positive lag: y comes
    later); the least of equals. Captures without two samples in common at any lag have no row."""
    sums = lag_sums(pairs, most).where("m >= 2")
    spread = lambda a: f"greatest(s{a}{a} - s{a} * s{a} / m, 0D)"
    corr = F.expr(f"(sxy - sx * sy / m) / (sqrt({spread('x')} * {spread('y')}) + {CORR_FLOOR}D)")
    best = sums.groupBy("capture_id").agg(F.max(F.struct(corr.alias("c"), (-F.col("lag")).alias("l"))).alias("b"))
    return best.select("capture_id", (-F.col("b.l")).alias("lag"), F.col("b.c").alias("correlation"))


def best_lag_gain(pairs: DataFrame, most: int, rate: float = 1.0) -> DataFrame:
    """(capture_id, gain, r2, lag_s, wc2): the lag at which y = gain x fits best, by r2 + wc2 / 4 (the least of equals).

    r2 is the share of y's variance that the fit explains, within -1 and 1 in the result; wc2 the squared cosine of x and y,
    both about the capture's means. lag_s is in seconds of rate samples."""
    fit = lag_sums(pairs, most).withColumn("k", F.expr(f"sxy / (sxx + {FIT_FLOOR}D)"))
    fit = fit.withColumn("r2", F.expr(f"1 - (syy - 2 * k * sxy + k * k * sxx) / (syy - sy * sy / m + {FIT_FLOOR}D)")).withColumn("wc2", F.expr(f"pow(sxy / (sqrt(sxx * syy) + {FIT_FLOOR}D), 2)"))
    best = fit.groupBy("capture_id").agg(F.max(F.expr(f"struct(r2 + {WC2_WEIGHT}D * wc2 AS score, -lag AS l, k, r2, wc2)")).alias("b"))
    return best.select("capture_id", F.col("b.k").alias("gain"), F.expr("greatest(-1D, least(1D, b.r2))").alias("r2"), F.expr(f"-b.l / {float(rate)}D").alias("lag_s"), F.col("b.wc2").alias("wc2"))
