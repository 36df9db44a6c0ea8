"""Event operators over samples(capture_id, n, t, v): windows within a capture, ordered by n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .greedy import chatter, greedy_match  # noqa: F401
from .quantiles import quantiles
from .slopes import theil_sen  # noqa: F401


def by_n():
    """A capture's samples in order. Windows stream a capture through one task, spilling what does not fit; a capture is
    as long as its instrument's memory, and its order is what these operators are about."""
    return Window.partitionBy("capture_id").orderBy("n")


def channel_stats(samples: DataFrame) -> DataFrame:
    """Count, mean, extremes, population deviation, RMS, RMS about the mean and peak to peak of each capture."""
    v = F.col("v")
    out = samples.groupBy("capture_id").agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.withColumn("rms_ac", F.col("std")).withColumn("p2p", F.col("max") - F.col("min"))


def pointwise_reference(samples: DataFrame) -> DataFrame:
    """Median, mean and number of captures at each sample index: the ensemble's reference waveform."""
    mean = samples.groupBy("n").agg(F.avg("v").alias("mean"), F.count("*").alias("captures"))
    middle = quantiles(samples.select(F.col("n").alias("i"), "v"), ["i"], "v", [0.5])
    return mean.join(middle.select("i", F.col("q")[0].alias("reference")), F.col("n") == F.col("i"), "left").select("n", "reference", "mean", "captures")


def ensemble_spread(samples: DataFrame, trim: float = 0.1) -> DataFrame:
    """Median, median absolute deviation and trimmed mean (of what lies between the quantiles trim and 1 - trim, both
    included) at each sample index."""
    q = quantiles(samples.select(F.col("n").alias("i"), "v"), ["i"], "v", [trim, 0.5, 1 - trim])
    near = samples.join(q.select("i", "q"), F.col("n") == F.col("i")).withColumn("dev", F.abs(F.col("v") - F.col("q")[1]))
    kept = F.when((F.col("v") >= F.col("q")[0]) & (F.col("v") <= F.col("q")[2]), F.col("v"))
    mean = near.groupBy("n", F.col("q")[1].alias("reference")).agg(F.avg(kept).alias("trimmed_mean"), F.count(kept).alias("kept"))
    mad = quantiles(near.select(F.col("n").alias("i"), "dev"), ["i"], "dev", [0.5])
    return mean.join(mad.select("i", F.col("q")[0].alias("mad")), F.col("n") == F.col("i")).select("n", "reference", "mad", "trimmed_mean", "kept")


def mad_scale(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Median and 1.4826 times the median absolute deviation by group; groups may be of any size."""
    centre = quantiles(rows, [by], value, [0.5]).select(by, F.col("q")[0].alias("median"), F.col("n").alias("count"))
    away = rows.join(centre, by).select(by, F.abs(F.col(value) - F.col("median")).alias("d"))
    spread = quantiles(away, [by], "d", [0.5]).select(by, (1.4826 * F.col("q")[0]).alias("scale"))
    return centre.join(spread, by).select(by, "median", "scale", "count")


def pair_features(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Gain, RMS and peak ratios, correlation and residual of each capture against reference(n, reference)."""
    p, r = F.col("v"), F.col("reference")
    rms = lambda x: F.sqrt(F.avg(x * x))
    floor = lambda x: F.greatest(x, F.lit(1e-12))
    return samples.join(reference, "n").groupBy("capture_id").agg(
        F.coalesce(F.median(F.when(F.abs(r) > 1e-9, F.try_divide(p, r))), F.lit(1.0)).alias("gain"), (rms(p) / floor(rms(r))).alias("rms_ratio"), (F.max(F.abs(p)) / floor(F.max(F.abs(r)))).alias("peak_ratio"),
        F.coalesce(F.nanvl(F.corr(p, r), F.lit(0.0)), F.lit(0.0)).alias("correlation"), (rms(p - r) / floor(rms(r))).alias("residual_energy_ratio"),
    )


def edge_features(samples: DataFrame) -> DataFrame:
    """Runs of steps beyond six robust deviations, zero crossings about the median, and the RMS of steps."""
    level = samples.groupBy("capture_id").agg(F.median("v").alias("level"))
    steps = samples.join(level, "capture_id").withColumn("c", F.col("v") - F.col("level")).withColumn("last", F.lag("c").over(by_n())).withColumn("d", F.col("c") - F.col("last"))
    centre = steps.groupBy("capture_id").agg(F.median("d").alias("centre"))
    spread = steps.where("d IS NOT NULL").join(centre, "capture_id").groupBy("capture_id").agg(F.greatest(F.lit(1e-9), 6 * 1.4826 * F.median(F.abs(F.col("d") - F.col("centre")))).alias("limit"))
    marked = steps.where("d IS NOT NULL").join(spread, "capture_id").withColumn("active", F.abs("d") > F.col("limit")).withColumn("before", F.coalesce(F.lag("active").over(by_n()), F.lit(False)))
    return marked.groupBy("capture_id").agg(F.count_if(F.col("active") & ~F.col("before")).alias("edge_segments"), F.count_if(F.col("c") * F.col("last") < 0).alias("zero_crossings"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("derivative_rms"))


def initial_vs_final(samples: DataFrame) -> DataFrame:
    """RMS of the first quarter (4 samples at least) over that of the last."""
    size = samples.groupBy("capture_id").agg(F.count("*").alias("size"))
    k = F.greatest(F.lit(4), F.floor(F.col("size") / 4))
    rms = lambda cond: F.sqrt(F.avg(F.when(cond, F.col("v") * F.col("v"))))
    return samples.join(size, "capture_id").groupBy("capture_id").agg((rms(F.col("n") < k) / F.greatest(rms(F.col("n") >= F.col("size") - k), F.lit(1e-12))).alias("initial_vs_final_rms"))


def schmitt(samples: DataFrame, low: float, high: float) -> DataFrame:
    """samples with state: 1 from high upwards, 0 from low downwards, held in between; the first by the midpoint."""
    mark = F.when(F.col("v") >= high, 1).when(F.col("v") <= low, 0).when(F.col("n") == 0, F.when(F.col("v") >= (low + high) / 2, 1).otherwise(0))
    return samples.withColumn("state", F.last(mark, ignorenulls=True).over(by_n().rowsBetween(Window.unboundedPreceding, 0)))


def pulses(states: DataFrame) -> DataFrame:
    """Rising and falling edges, and the time spent high, by capture."""
    moved = states.withColumn("before", F.lag("state").over(by_n())).withColumn("next_t", F.lead("t").over(by_n()))
    return moved.groupBy("capture_id").agg(F.count_if((F.col("state") == 1) & (F.col("before") == 0)).alias("rising"), F.count_if((F.col("state") == 0) & (F.col("before") == 1)).alias("falling"), F.coalesce(F.sum(F.when(F.col("state") == 1, F.col("next_t") - F.col("t"))), F.lit(0.0)).alias("high_s"))


def runs(samples: DataFrame, condition: str, close: int = 0) -> DataFrame:
    """Runs of samples that meet condition: capture_id, run, start_n, end_n, length; gaps of up to close samples are bridged."""
    on = samples.where(condition).withColumn("before", F.lag("n").over(by_n()))
    start = F.when(F.col("before").isNull() | (F.col("n") - F.col("before") > close + 1), 1).otherwise(0)
    numbered = on.withColumn("run", F.sum(start).over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("capture_id", "run").agg(F.min("n").alias("start_n"), F.max("n").alias("end_n"), F.count("*").alias("length"))


def episodes(events: DataFrame, gap_s: float, least: int) -> DataFrame:
    """Groups of events(capture_id, n, t) no more than gap_s apart with least events or more; the primary one has most
    events, then the longest duration, then the earliest start."""
    start = F.when(F.col("t") - F.lag("t").over(by_n()) <= gap_s, 0).otherwise(1)
    grouped = events.withColumn("episode", F.sum(start).over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("capture_id", "episode").agg(F.count("*").alias("events"), F.min("t").alias("start_s"), F.max("t").alias("end_s")).where(F.col("events") >= least)
    best = Window.partitionBy("capture_id").orderBy(F.desc("events"), F.desc(F.col("end_s") - F.col("start_s")), "start_s")
    return out.withColumn("is_primary", F.row_number().over(best) == 1)


def burst_groups(events: DataFrame, factor: float = 5.0) -> DataFrame:
    """A new burst where an interval exceeds factor times the capture's median interval; counts and gaps."""
    steps = events.withColumn("dt", F.col("t") - F.lag("t").over(by_n()))
    typical = steps.groupBy("capture_id").agg(F.median("dt").alias("typical"))
    steps = steps.join(typical, "capture_id").withColumn("opens", F.when(F.col("dt").isNull() | (F.col("dt") > factor * F.col("typical")), 1).otherwise(0))
    steps = steps.withColumn("burst", F.sum("opens").over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("capture_id", "burst").agg(F.count("*").alias("events"), F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.max(F.when(F.col("opens") == 0, F.col("dt"))).alias("longest_gap_s"))


def moving_rms(samples: DataFrame, half: int) -> DataFrame:
    """samples with the mean and RMS of the 2 half + 1 samples around each (fewer at the ends)."""
    w = by_n().rowsBetween(-half, half)
    return samples.withColumn("moving_mean", F.avg("v").over(w)).withColumn("moving_rms", F.sqrt(F.avg(F.col("v") * F.col("v")).over(w)))


def sustained(samples: DataFrame, condition: str, k: int) -> DataFrame:
    """First sample of each capture from which condition holds k samples on end; null if there is none."""
    ahead = by_n().rowsBetween(0, k - 1)
    held = samples.withColumn("all_on", (F.min(F.expr(f"int({condition})")).over(ahead) == 1) & (F.count("*").over(ahead) == k))
    return held.groupBy("capture_id").agg(F.min(F.when(F.col("all_on"), F.col("n"))).alias("first_n"), F.min(F.when(F.col("all_on"), F.col("t"))).alias("first_s"))


def circular(rows: DataFrame, by: str, angle: str) -> DataFrame:
    """Phase coherence (length of the mean phasor) and mean angle by group."""
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return rows.groupBy(by).agg(F.sqrt(c * c + s * s).alias("coherence"), F.atan2(s, c).alias("mean_angle"), F.count("*").alias("count"))


def hysteresis(samples: DataFrame, enter: float, leave: float, enter_n: int, leave_n: int, least: int) -> DataFrame:
    """Events (capture_id, event, start_n, end_n, is_open) of a detector with persistence; leave < enter.

    It turns on where v has been at enter or above for enter_n samples and the event starts at the first of them; it
    turns off where v has been at leave or below (or null, or NaN) for leave_n samples and the event ends at the first of
    them. One still on at the last sample is open and ends there. Events of end_n - start_n under least go. As leave <
    enter, no sample is part of both kinds of runs, so the state is the last completed run: windows, no loop."""
    valid = F.col("v").isNotNull() & ~F.isnan("v")
    held = lambda on, k: (F.min(F.when(on, 1).otherwise(0)).over(by_n().rowsBetween(1 - k, 0)) == 1) & (F.count("*").over(by_n().rowsBetween(1 - k, 0)) == k)
    marked = samples.withColumn("mark", F.when(held(valid & (F.col("v") >= enter), enter_n), 1).when(held(~valid | (F.col("v") <= leave), leave_n), 0))
    state = marked.withColumn("state", F.coalesce(F.last("mark", ignorenulls=True).over(by_n().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    moved = state.withColumn("before", F.lag("state", 1, 0).over(by_n()))
    moved = moved.withColumn("event", F.sum(F.when((F.col("state") == 1) & (F.col("before") == 0), 1).otherwise(0)).over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    inside = moved.where("state = 1 OR before = 1").groupBy("capture_id", "event").agg(
        (F.min("n") - (enter_n - 1)).alias("start_n"), F.max(F.when(F.col("state") == 0, F.col("n") - (leave_n - 1))).alias("closed_n"), F.max("n").alias("last_n")
    )
    out = inside.select("capture_id", "event", "start_n", F.coalesce("closed_n", "last_n").alias("end_n"), F.col("closed_n").isNull().alias("is_open"))
    return out.where(F.col("end_n") - F.col("start_n") >= least)


def gradient(samples: DataFrame) -> DataFrame:
    """samples with dv_dt: central differences, one-sided at a capture's ends; null where no time passes."""
    behind, ahead = (lambda c: F.coalesce(F.lag(c).over(by_n()), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(by_n()), F.col(c)))
    return samples.withColumn("dv_dt", F.try_divide(ahead("v") - behind("v"), ahead("t") - behind("t")))


def pulse_list(states: DataFrame) -> DataFrame:
    """Pulses of states(capture_id, n, t, v, state): a rising edge to the next falling one, with start, end, width, the
    peak and the trapezoid area over its samples. A pulse that begins high or is still high at the end is left out."""
    w = by_n()
    moved = states.withColumn("before", F.lag("state").over(w)).withColumn("dt", F.lead("t").over(w) - F.col("t")).withColumn("ahead", F.lead("v").over(w))
    moved = moved.withColumn("pulse", F.sum(F.when((F.col("state") == 1) & (F.col("before") == 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fell = (F.col("state") == 0) & (F.col("before") == 1)
    area = F.when(F.col("state") == 1, F.col("dt") * (F.col("v") + F.col("ahead")) / 2)
    out = moved.where("pulse > 0").groupBy("capture_id", "pulse").agg(F.min("t").alias("start_s"), F.min(F.when(fell, F.col("t"))).alias("end_s"), F.max(F.when(F.col("state") == 1, F.col("v"))).alias("peak"), F.sum(area).alias("area"))
    return out.where("end_s IS NOT NULL").withColumn("width_s", F.col("end_s") - F.col("start_s"))


def merged_count(samples: DataFrame, condition: str, gap_s: float) -> DataFrame:
    """Events of each capture where condition holds; those no more than gap_s after the one before are the same event."""
    on = samples.withColumn("on", F.expr(condition)).where("on").withColumn("dt", F.col("t") - F.lag("t").over(by_n()))
    counted = on.groupBy("capture_id").agg(F.count_if(F.col("dt").isNull() | (F.col("dt") > gap_s)).alias("events"))
    return samples.select("capture_id").distinct().join(counted, "capture_id", "left").select("capture_id", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def activity_onset(samples: DataFrame, pre_share: float = 0.1, half: int = 1) -> DataFrame:
    """First time after the opening share of a capture at which the moving mean of deviations exceeds the noise floor.

    Deviations are from the opening's median; the floor is their median plus six median absolute deviations there, and 5 %
    of the peak to peak at least. Null if there is none, or the opening has under 8 samples."""
    ends = samples.groupBy("capture_id").agg((F.min("t") + pre_share * (F.max("t") - F.min("t"))).alias("until"), (0.05 * (F.max("v") - F.min("v"))).alias("least"))
    rows = samples.join(ends, "capture_id").withColumn("pre", F.col("t") <= F.col("until"))
    base = rows.where("pre").groupBy("capture_id").agg(F.median("v").alias("base"), F.count("*").alias("k"))
    dev = rows.join(base, "capture_id").withColumn("dev", F.abs(F.col("v") - F.col("base")))
    middle = dev.where("pre").groupBy("capture_id").agg(F.median("dev").alias("m"))
    spread = dev.where("pre").join(middle, "capture_id").groupBy("capture_id", "m").agg(F.median(F.abs(F.col("dev") - F.col("m"))).alias("s"))
    smooth = dev.join(spread, "capture_id").withColumn("smooth", F.avg("dev").over(by_n().rowsBetween(-half, half)))
    hit = F.when(~F.col("pre") & (F.col("k") >= 8) & (F.col("smooth") > F.greatest(F.col("m") + 6 * F.col("s"), F.col("least"))), F.col("t"))
    return smooth.groupBy("capture_id").agg(F.min(hit).alias("onset_s"))


def complement(windows: DataFrame, busy: DataFrame, least_s: float, most_s: float) -> DataFrame:
    """(capture_id, window_id, start_s, end_s): what busy(capture_id, start_s, end_s) leaves of windows(capture_id, window_id,
    start_s, end_s), pieces of least_s to most_s that end after the capture's first busy interval begins. Captures
    without busy intervals have none."""
    first = busy.groupBy("capture_id").agg(F.min("start_s").alias("first"))
    inside = windows.alias("w").join(busy.alias("b"), F.expr("w.capture_id = b.capture_id AND b.end_s > w.start_s AND b.start_s < w.end_s")).selectExpr("w.capture_id", "w.window_id", "w.start_s AS ws", "w.end_s AS we", "b.start_s AS s", "b.end_s AS e")
    borders = windows.selectExpr("capture_id", "window_id", "start_s AS ws", "end_s AS we")
    rows = inside.unionByName(borders.selectExpr("*", "ws AS s", "ws AS e")).unionByName(borders.selectExpr("*", "we AS s", "we AS e"))
    w = Window.partitionBy("capture_id", "window_id").orderBy("s", "e")
    free = rows.withColumn("cursor", F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("ws"))).where("s > cursor")
    out = free.join(first, "capture_id").selectExpr("capture_id", "window_id", "cursor AS start_s", "least(s, we) AS end_s", "first")
    return out.where(f"end_s > first AND end_s - start_s BETWEEN {least_s} AND {most_s}").drop("first")


def timeline(*sources: DataFrame) -> DataFrame:
    """Events (capture_id, t, channel, label) of all sources with seq, their order in the capture by time, channel, label."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("capture_id").orderBy("t", "channel", "label")))


def anchored_windows(events_of: DataFrame, spans: DataFrame) -> DataFrame:
    """Analysis windows (capture_id, name, start_s, end_s) of positive length from each capture's first events.

    events_of(capture_id, t, label) with labels rose, fell, source, reference, asserted; spans(capture_id, start_s, end_s).
    Without a rise or fall the capture's own ends serve."""
    first = lambda label: F.min(F.when(F.col("label") == label, F.col("t")))
    f = events_of.groupBy("capture_id").agg(*(first(x).alias(x) for x in ("rose", "fell", "source", "reference", "asserted")))
    c = spans.join(f, "capture_id", "left").withColumn("stop", F.coalesce("fell", "end_s")).withColumn("post", F.greatest("fell", "asserted"))
    one = lambda name, start, end, when: F.when(when, F.struct(F.lit(name).alias("name"), F.col(start).alias("start_s"), F.col(end).alias("end_s")))
    has = lambda *cols: F.expr(" AND ".join(f"{x} IS NOT NULL" for x in cols))
    rows = F.array(one("baseline_pre_command", "start_s", "rose", has("rose")), one("command_active", "rose", "fell", has("rose", "fell")), one("source_activity", "source", "stop", has("source")), one("reference_disturbance", "reference", "stop", has("reference")), one("post_event_recovery", "post", "end_s", has("post")))
    return c.select("capture_id", F.inline(F.filter(rows, lambda x: x.isNotNull()))).where("end_s > start_s")


def window_samples(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Count, mean and RMS of the samples in each window (capture_id, name, start_s, end_s), ends included. Windows are dealt
    to buckets of width, so a sample meets only those near it."""
    from .joins import interval_join

    named = windows.withColumnRenamed("start_s", "__from").withColumnRenamed("end_s", "__to")
    pairs = interval_join(named, samples.select("capture_id", "t", "v"), "capture_id", "__from", "__to", "t", width)
    return pairs.groupBy("capture_id", "name").agg(F.count("*").alias("samples"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def role_deltas(events_of: DataFrame, base: str, others: list[str]) -> DataFrame:
    """Seconds from a capture's first base event to the first event of each other label; null where either is missing."""
    first = events_of.groupBy("capture_id").agg(*(F.min(F.when(F.col("label") == x, F.col("t"))).alias(x) for x in (base, *others)))
    return first.select("capture_id", *((F.col(x) - F.col(base)).alias(f"{x}_after_s") for x in others))
