"""Evidence from several layers and measurements: scores that skip what is missing, compounds, fusion, populations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise
from . import ranks


def layered(weights: dict[str, float]) -> tuple[Column, Column, Column]:
    """Of score columns (null: layer not available) the weighted mean over those available, the share of the weights that
    this covers, and the geometric mean of the available ones (0 if one is 0). All null without any layer."""
    total = float(sum(weights.values()))
    have = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    mixed = sum((F.coalesce(F.col(c) * float(w), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    logs = sum((F.when(F.col(c).isNotNull(), F.when(F.col(c) > 0, F.ln(c)).otherwise(F.lit(float("-inf")))).otherwise(0.0) for c in weights), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in weights), F.lit(0))
    return F.when(have > 0, mixed / have), F.when(have > 0, have / total), F.when(n > 0, F.exp(logs / n))


def fused(hypotheses: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Totals of a hypothesis over all measurements, with the number of measurements, and rank by total (ties by key)."""
    order = ", ".join(f"`{k}`" for k in keys)
    out = hypotheses.groupBy(*keys).agg(F.sum(score).alias("total"), F.count("*").alias("measurements"))
    return out.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY `{keys[0]}` ORDER BY total DESC, {order})"))


def population(rows: DataFrame, by: str, label: str, valid: Column, hit: Column, value: str) -> DataFrame:
    """Cases, valid ones, hits and their rate over the valid, the commonest label, and the exact median of value."""
    from .quantiles import quantiles

    labels = rows.groupBy(by, label).agg(F.count("*").alias("n")).groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), label)).alias("top"), F.count("*").alias("classes"))
    out = rows.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(valid).alias("valid"), F.count_if(valid & hit).alias("hits"))
    middle = quantiles(rows, [by], value, [0.5]).select(by, F.col("q")[0].alias("median"))
    return out.join(labels, by).join(middle, by, "left").select(by, "cases", "valid", "hits", F.try_divide(F.col("hits").cast("double"), F.col("valid")).alias("rate"), "classes", F.col(f"top.{label}").alias("commonest"), "median")


#: Coefficients of variation up to which repeated measurements support a value.
SUPPORT = [("strongly_supported", 0.05), ("supported", 0.15)]


def repeatability(rows: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """Mean, sample deviation, coefficient of variation and support of repeated values; under least values, or where the
    mean is 0, exploratory."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    cv = F.try_divide(F.col("std"), F.abs("mean"))
    label = F.lit("exploratory")
    for name, upto in reversed(SUPPORT):
        label = F.when((F.col("n") >= least) & (cv <= upto), name).otherwise(label)
    return out.select(*by, "n", "mean", "std", cv.alias("cv"), label.alias("support"))


def combined_support(*labels: str) -> Column:
    """The weakest of several support columns."""
    order = F.array(F.lit("exploratory"), F.lit("supported"), F.lit("strongly_supported"))
    at = F.least(*(F.array_position(order, F.col(c)) for c in labels)) if len(labels) > 1 else F.array_position(order, F.col(labels[0]))
    return F.element_at(order, at.cast("int"))


def channel_pairs(samples: DataFrame) -> DataFrame:
    """Correlation, RMS of the difference and number of common samples of every pair of channels of samples(capture_id,
    channel, n, v). A sample's channels are paired inside its row (as many as the instrument has), so no self join."""
    at = samples.where("v IS NOT NULL").groupBy("capture_id", "n").agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("e"))
    paired = "flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> named_struct('a', x.channel, 'b', y.channel, 'x', x.v, 'y', y.v))))"
    rows = at.select("capture_id", F.inline(F.expr(paired)))
    d = F.col("x") - F.col("y")
    return rows.groupBy("capture_id", "a", "b").agg(F.corr("x", "y").alias("correlation"), F.sqrt(F.avg(d * d)).alias("rms_difference"), F.count("*").alias("samples"))


def interpolated(left: DataFrame, right: DataFrame, key: str = "capture_id") -> DataFrame:
    """left(key, t, ...) with aligned: right(key, t, v) at left's times by linear interpolation; null outside right's span.
    One shuffle on key carries the neighbours on both sides along; of right's rows at one time the least value counts."""
    from pyspark.sql import Window

    none = F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType)
    one = right.groupBy(key, "t").agg(F.min("v").alias("v"))
    both = one.select(key, F.col("t").alias("__t"), F.struct("t", "v").alias("__r"), none.alias("__l"))
    both = both.union(left.select(key, F.col("t").alias("__t"), F.lit(None).cast(both.schema["__r"].dataType), F.struct("*")))
    w = Window.partitionBy(key).orderBy("__t")
    a, b = F.last("__r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("__r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("__a", a).withColumn("__b", b).where("__l IS NOT NULL")
    share = F.coalesce(F.try_divide(F.col("__t") - F.col("__a.t"), F.col("__b.t") - F.col("__a.t")), F.lit(0.0))
    return rows.select("__l.*", F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share).alias("aligned"))


def padded_runs(runs: DataFrame, pad: int) -> DataFrame:
    """runs(capture_id, start_n, end_n) widened by pad samples on both sides (not below 0); those that touch become one."""
    from pyspark.sql import Window

    w = Window.partitionBy("capture_id").orderBy("s", "e")
    wide = runs.selectExpr("capture_id", f"greatest(start_n - {pad}, 0) AS s", f"end_n + {pad} AS e")
    opens = F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    return wide.withColumn("run", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("capture_id", "run").agg(F.min("s").alias("start_n"), F.max("e").alias("end_n"))


def settling(samples: DataFrame, tolerance: float) -> DataFrame:
    """Final value of each capture, and the time of the first sample from which all stay within tolerance of it."""
    final = samples.groupBy("capture_id").agg(F.max_by("v", "n").alias("final"))
    rows = samples.join(final, "capture_id")
    out = F.abs(F.col("v") - F.col("final")) > tolerance
    last = rows.groupBy("capture_id", "final").agg(F.max(F.when(out, F.col("n"))).alias("last_out"))
    return rows.join(last.drop("final"), "capture_id").groupBy("capture_id", "final").agg(F.min(F.when(F.col("last_out").isNull() | (F.col("n") > F.col("last_out")), F.col("t"))).alias("settled_s"), F.count_if(out).alias("samples_out"))


def interval_regularity(samples: DataFrame) -> DataFrame:
    """Of the intervals between a capture's events: median, drift (slope of the interval by event), and the events that are
    missing if the median were kept (an interval of about k medians misses k - 1)."""
    from pyspark.sql import Window

    steps = samples.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("capture_id").orderBy("n"))).where("dt IS NOT NULL")
    typical = steps.groupBy("capture_id").agg(F.median("dt").alias("typical"))
    gone = F.greatest(F.try_divide(F.col("dt"), F.col("typical")) + 0.5, F.lit(1.0))
    return steps.join(typical, "capture_id").groupBy("capture_id", "typical").agg(F.regr_slope("dt", "n").alias("drift"), F.sum(F.coalesce(F.floor(gone) - 1, F.lit(0))).alias("missing"))


def subwindows(samples: DataFrame, width: int) -> DataFrame:
    """Median and median absolute deviation of the steps, and the 90 % quantile of the level, in windows of width samples."""
    from pyspark.sql import Window

    steps = samples.withColumn("d", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("capture_id").orderBy("n")))).withColumn("w", F.floor(F.col("n") / width))
    middle = steps.groupBy("capture_id", "w").agg(F.median("d").alias("step_median"), F.percentile("v", F.lit(0.9)).alias("level_p90"), F.count("*").alias("samples"))
    away = steps.join(middle.select("capture_id", "w", "step_median"), ["capture_id", "w"]).groupBy("capture_id", "w").agg(F.median(F.abs(F.col("d") - F.col("step_median"))).alias("step_mad"))
    return middle.join(away, ["capture_id", "w"])


def contact_anatomy(states: DataFrame) -> DataFrame:
    """Of states(capture_id, n, t, state): first contact, reversals, the longest contact in samples, short contacts (under 2
    samples), and the time of the last reversal, after which the state holds."""
    from pyspark.sql import Window

    w = Window.partitionBy("capture_id").orderBy("n")
    moved = states.withColumn("turn", F.when(F.col("state") != F.lag("state").over(w), 1).otherwise(0)).withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = moved.groupBy("capture_id", "run").agg(F.max("state").alias("state"), F.min("t").alias("t"), F.count("*").alias("k"))
    on = F.col("state") == 1
    return runs.groupBy("capture_id").agg(F.min(F.when(on, F.col("t"))).alias("first_contact_s"), F.max("run").cast("bigint").alias("reversals"), F.max(F.when(on, F.col("k"))).alias("longest_contact"), F.count_if(on & (F.col("k") < 2)).alias("short_contacts"), F.max(F.when(F.col("run") > 0, F.col("t"))).alias("last_reversal_s"))


def support_ladder(rows: DataFrame, by: list[str], limits: dict[str, tuple[float, float]], least: int = 3, many: int = 6) -> DataFrame:
    """Support from several measures at once. limits gives for each the coefficients of variation (population deviation
    over mean) up to which it is strongly supported or supported; all measures must agree, and strong support needs many
    rows. Under least rows, or where a measure has under two values, exploratory."""
    n = F.count("*").alias("n")
    out = rows.groupBy(*by).agg(n, *(F.count(m).alias(f"{m}_n") for m in limits), *((F.stddev_pop(m) / F.greatest(F.avg(m), F.lit(1e-12))).alias(f"{m}_cv") for m in limits))
    within = lambda k: F.greatest(*(F.col(f"{m}_cv") / x[k] for m, x in limits.items()), F.lit(0.0)) <= 1
    usable = (F.col("n") >= least) & (F.least(*(F.col(f"{m}_n") for m in limits), F.col("n")) >= 2)
    label = F.when(usable & within(0) & (F.col("n") >= many), "strongly_supported").when(usable & within(1), "supported").otherwise("exploratory")
    return out.select(*by, "n", *(f"{m}_cv" for m in limits), label.alias("support"))


#: Relative spreads of a bootstrapped median up to which it is supported.
SPREADS = [("strongly_supported", 0.08), ("supported", 0.20)]


def bootstrap_support(rows: DataFrame, by: list[str], value: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(by, n, spread, support): the deviation of the median over resamples of a group's values, relative to the median of
    these medians. Under three values exploratory. Null keys are a group; nulls and NaNs are left out.

    A resample's median is a value of the group whose rank is random: the k-th of n uniform draws has a beta distribution,
    and the next one, given it, is the least of n - k draws above it. So only ranks are drawn, from the group's size, and
    looked up among the counted values; rows are never multiplied."""
    chunks = ranks.counted(rows, by, value)
    ahead = ranks.before(chunks, "__g", F.sum("__k"))
    sizes = ahead.select("__g", F.col("__all").alias("n")).distinct()

    def draw(batches):
        for pdf in batches:
            drawn = []
            for n, start in zip(pdf.n, pdf.start, strict=True):
                rng = np.random.default_rng(abs(int(start)))
                k = (n + 1) // 2
                low = rng.beta(k, n + 1 - k, rounds)
                high = low if n % 2 else low + (1 - low) * (1 - rng.random(rounds) ** (1 / (n - k)))
                drawn.append(np.minimum(n - 1, np.floor(n * np.stack([low, high])).astype(np.int64)))
            size = len(pdf) * rounds
            low, high = (np.concatenate([d[i] for d in drawn]) if drawn else np.zeros(0, np.int64) for i in (0, 1))
            yield pd.DataFrame({"id": np.repeat(pdf.id.to_numpy(), rounds), "b": np.arange(size) % rounds, "low": low, "high": high})

    keyed = sizes.withColumn("id", F.to_json("__g", {"ignoreNullFields": "false"}))
    drawn = keyed.select("id", "n", F.xxhash64("id", F.lit(seed)).alias("start")).mapInPandas(draw, "id string, b bigint, low bigint, high bigint")
    wanted = materialise(keyed.select("__g", "id").join(drawn, "id").select("__g", "b", F.explode(F.array("low", "high")).alias("rank")))
    places = ranks.values_at(chunks, ahead, wanted.select("__g", "rank").distinct())
    medians = wanted.join(places, ["__g", "rank"]).groupBy("__g", "b").agg(F.avg("__v").alias("m"))
    spread = medians.groupBy("__g").agg((F.stddev_pop("m") / F.greatest(F.abs(F.median("m")), F.lit(1e-12))).alias("spread"))  # a group has `rounds` medians
    label = F.lit("exploratory")
    for name, upto in reversed(SPREADS):
        label = F.when((F.col("n") >= 3) & (F.col("spread") <= upto), name).otherwise(label)
    return sizes.join(spread, "__g", "left").select(*(F.col("__g")[c].alias(c) for c in by), "n", "spread", label.alias("support"))
