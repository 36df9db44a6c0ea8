"""Timing of edges and of chains of channels (command, onset, motion, threshold, output) over samples(capture_id, n, t, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import by_n, sustained
from .evidence import interpolated

#: Quantiles that stand for the rails, and levels of an edge as shares of the span between them.
RAILS = (0.05, 0.95)
LEVELS = (0.1, 0.5, 0.9)
CHATTER = (0.4, 0.6)
TINY = 1e-12


def edge_windows(samples: DataFrame, half: int) -> DataFrame:
    """samples with mean and RMS of 2 half + 1 samples, as if what lies beyond the ends were zero (same_mean, same_rms) or
    went on with the end's value (nearest_mean, nearest_rms). Null values count as zero."""
    width = 2 * half + 1
    whole = by_n().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = samples.withColumn("x", F.coalesce("v", F.lit(0.0)))
    rows = rows.withColumns({"first_x": F.first("x").over(whole), "last_x": F.last("x").over(whole), "size": F.count("*").over(whole)})
    before, after = F.greatest(F.lit(half) - F.col("n"), F.lit(0)), F.greatest(F.lit(half + 1) - F.col("size") + F.col("n"), F.lit(0))
    out = {}
    for name, of in (("mean", lambda c: c), ("rms", lambda c: c * c)):
        inside = F.sum(of(F.col("x"))).over(by_n().rowsBetween(-half, half))
        padded = inside + before * of(F.col("first_x")) + after * of(F.col("last_x"))
        for edges, total in (("same", inside), ("nearest", padded)):
            out[f"{edges}_{name}"] = total / width if name == "mean" else F.sqrt(total / width)
    return rows.withColumns(out).drop("x", "first_x", "last_x", "size")


def rails(samples: DataFrame) -> DataFrame:
    """(capture_id, low_rail, high_rail) of each capture."""
    q = F.percentile("v", F.array(*(F.lit(x) for x in RAILS)))
    return samples.groupBy("capture_id").agg(q.alias("q")).select("capture_id", F.col("q")[0].alias("low_rail"), F.col("q")[1].alias("high_rail"))


def unit_edges(samples: DataFrame, rising: bool = True) -> DataFrame:
    """samples with the rails and u: the way from the rail where the edge starts to the other, 0 to 1; last_u and last_t are
    those of the sample before."""
    start, sign = ("low_rail", 1.0) if rising else ("high_rail", -1.0)
    span = F.greatest(F.col("high_rail") - F.col("low_rail"), F.lit(TINY))
    rows = samples.join(rails(samples), "capture_id").withColumn("u", (F.col("v") - F.col(start)) * sign / span)
    return rows.withColumns({"last_u": F.lag("u").over(by_n()), "last_t": F.lag("t").over(by_n()), "last_v": F.lag("v").over(by_n())})


def crossed(level: float, u: str = "u"):
    """The time between the sample before and this one at which u reaches level from below; null where it does not."""
    step = F.col(u) - F.col(f"last_{u}")
    share = F.when(step < TINY, F.lit(0.0)).otherwise((F.lit(level) - F.col(f"last_{u}")) / step)
    return F.when((F.col(f"last_{u}") < level) & (F.col(u) >= level), F.col("last_t") + share * (F.col("t") - F.col("last_t")))


def edge_timing(samples: DataFrame, rising: bool = True, tolerance: float = 0.05, hold: int = 3, before_s: float = 0.001, after_s: float = 0.015) -> DataFrame:
    """Of each capture's first edge: the times at 10, 50 and 90 % (each after the one before), the steepest step between
    them, overshoot as a share of the span, the time from 90 % until hold samples on end lie within tolerance of the rail
    (until the capture's end if none do), and reversals of the 40/60 % state from before_s before 10 % to after_s after
    90 % beyond the first. Without an edge all of these are null, without reversals chatter is 0."""
    whole = Window.partitionBy("capture_id")
    rows = unit_edges(samples, rising)
    last = None
    for level in LEVELS:
        at = crossed(level)
        name = f"t{round(100 * level)}"
        rows = rows.withColumn(name, F.min(at if last is None else F.when(at >= F.col(last), at)).over(whole))
        last = name
    ahead = by_n().rowsBetween(0, hold - 1)
    near = (F.abs(F.col("u") - 1) <= tolerance).cast("int")
    mark = F.when(F.col("u") >= CHATTER[1], 1).when(F.col("u") <= CHATTER[0], 0).when(F.col("n") == 0, (F.col("u") >= sum(CHATTER) / 2).cast("int"))
    rows = rows.withColumn("held", (F.min(near).over(ahead) == 1) & (F.count("*").over(ahead) == hold))
    rows = rows.withColumn("state", F.last(mark, ignorenulls=True).over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    local = (F.col("t") >= F.col("t10") - before_s) & (F.col("t") <= F.col("t90") + after_s)
    both = local & F.lag(local).over(by_n())
    rows = rows.withColumn("turn", both & (F.col("state") != F.lag("state").over(by_n())))
    steep = F.when((F.col("t") > F.col("t10")) & (F.col("last_t") < F.col("t90")), F.abs(F.try_divide(F.col("v") - F.col("last_v"), F.col("t") - F.col("last_t"))))
    past = F.col("t") >= F.col("t90")
    out = rows.groupBy("capture_id", "low_rail", "high_rail", "t10", "t50", "t90").agg(
        F.max(steep).alias("steepest"), F.greatest(F.max(F.when(past, F.col("u"))) - 1, F.lit(0.0)).alias("over"), F.coalesce(F.min(F.when(past & F.col("held"), F.col("t"))), F.max("t")).alias("settled"), F.count_if("turn").alias("turns")
    )
    edge = F.col("t90").isNotNull()
    return out.select("capture_id", "low_rail", "high_rail", "t10", "t50", "t90", (F.col("t90") - F.col("t10")).alias("transition_s"), F.when(edge, F.col("steepest")).alias("steepest"), F.when(edge, F.col("over")).alias("overshoot"), (F.col("settled") - F.col("t90")).alias("settling_s"), F.greatest(F.col("turns") - 1, F.lit(0)).alias("chatter"))


def level_time(samples: DataFrame, name: str, level: float | None = None) -> DataFrame:
    """(capture_id, name): when v first rises to level, by default to the middle between the rails; null if never."""
    rows = unit_edges(samples)
    return rows.groupBy("capture_id").agg(F.min(crossed(0.5) if level is None else crossed(level, "v")).alias(name))


def onset_time(samples: DataFrame, name: str, share: float, hold: int, least: int = 20, first: float = 0.12) -> DataFrame:
    """(capture_id, name): the first of hold samples on end that have left the baseline by share of the span between the
    rails; the baseline is the median of the capture's beginning (least samples or first of all, if that is more)."""
    size = samples.groupBy("capture_id").agg(F.greatest(F.lit(least), F.floor(F.count("*") * first)).alias("opening"))
    base = samples.join(size, "capture_id").groupBy("capture_id").agg(F.median(F.when(F.col("n") < F.col("opening"), F.col("v"))).alias("baseline"))
    rows = samples.join(base, "capture_id").join(rails(samples), "capture_id")
    out = sustained(rows, f"abs(v - baseline) >= {share}D * greatest(high_rail - low_rail, {TINY}D)", hold)
    return out.select("capture_id", F.col("first_s").alias(name))


def timing_chain(stages: list[DataFrame]) -> DataFrame:
    """Stages (capture_id, name) of captures that have all of them, the time between each and the next, and from the first
    to the last. Times that are null leave null latencies."""
    out = stages[0]
    for s in stages[1:]:
        out = out.join(s, "capture_id")
    names = [s.columns[1] for s in stages]
    gaps = [(F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(names, names[1:], strict=False)]
    return out.select("capture_id", *names, *gaps, (F.col(names[-1]) - F.col(names[0])).alias("total"))


def switch_hysteresis(output: DataFrame, position: DataFrame) -> DataFrame:
    """When output first rises through the middle between its rails and first falls after that, and the positions
    (capture_id, t, v) then, by linear interpolation; hysteresis is their distance. Only captures that do both."""
    up = level_time(output, "on_s")
    falls = unit_edges(output, rising=False).select("capture_id", crossed(0.5).alias("off_s")).where("off_s IS NOT NULL")
    both = up.join(falls, "capture_id").where("off_s > on_s").groupBy("capture_id", "on_s").agg(F.min("off_s").alias("off_s"))
    ends = both.select("capture_id", F.inline(F.expr("array(named_struct('side', 'on', 't', on_s), named_struct('side', 'off', 't', off_s))")))
    at = interpolated(ends, position)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    out = at.groupBy("capture_id").agg(side("on", "t").alias("on_s"), side("off", "t").alias("off_s"), side("on", "aligned").alias("on_position"), side("off", "aligned").alias("off_position"))
    return out.withColumn("hysteresis", F.abs(F.col("off_position") - F.col("on_position")))
