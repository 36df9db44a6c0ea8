"""What becomes of short pulses on their way: sources are matched with outputs, and what is missing is told apart.

sources and outputs are (capture_id, id, rise_s, fall_s and, where known, width_s, which fall_s - rise_s may round), signal is
the output's samples (capture_id, t, v). Joins are by
capture and time buckets, so a pulse meets only what lies within its window; groups are shapes of those matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join

#: Samples across a pulse below which acquisition is of each grade, the grade one step down, relative widths
#: beyond which a pulse collapsed or was stretched, multiples of noise and amplitude that count as a response.
GRADES = [(2, "inadequate"), (5, "limited"), (10, "usable")]
COLLAPSED, STRETCHED, NOISES, RESPONSE, EDGE, CLEAR_SNR, NEAR_FULL = 0.5, 1.5, 5.0, 0.03, 0.35, 8.0, 0.98
MISSED = ["complete pulse non-propagation", "subthreshold pulse suppression", "possible acquisition miss", "unresolved pulse miss"]


@dataclass(frozen=True)
class Path:
    """What is known of the way from source to output. late_s is how long after a source outputs still count as late; slack_s how
    exactly an output must span what it merges; before_s where a source's response may begin before its latency, and
    look_back_s how far its baseline reaches; rate samples a second; bandwidth of the acquisition, if known."""

    threshold: float
    rate: float
    latency_min_s: float = 0.0
    latency_max_s: float = 0.003
    late_s: float = 0.020
    slack_s: float = 0.001
    before_s: float = 0.0005
    look_back_s: float = 0.1
    bandwidth: float | None = None
    least_width_s: float | None = None


def quotient(a: str, b: str) -> str:
    """SQL: a / b of doubles that may be zero, as floating point has it: infinite, or NaN of 0 / 0."""
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {b} = 0 AND {a} > 0 THEN double('infinity') WHEN {b} = 0 AND {a} < 0 THEN double('-infinity') WHEN {b} = 0 AND {a} = 0 THEN double('NaN') END"


def width(pulses: DataFrame) -> Column:
    return F.col("width_s") if "width_s" in pulses.columns else F.col("fall_s") - F.col("rise_s")


def acquisition(width: str, path: Path) -> str:
    """SQL: how well a pulse of this width is sampled."""
    grade = "CASE " + " ".join(f"WHEN {width} * {path.rate!r}D < {n} THEN '{g}'" for n, g in GRADES) + " ELSE 'strong' END"
    if path.bandwidth is None:
        return grade
    lower = f"CASE {grade} WHEN 'strong' THEN 'usable' WHEN 'usable' THEN 'limited' ELSE {grade} END"
    return f"CASE WHEN {width} > 0 AND {path.bandwidth!r}D < {EDGE} / {width} THEN {lower} ELSE {grade} END"


def responses(sources: DataFrame, signal: DataFrame, path: Path) -> DataFrame:
    """(capture_id, id, peak, baseline, noise): the signal's peak from a source's latency to where late outputs end, and the median
    and robust deviation of what lies look_back_s before. Without samples there: 0, and noise of 1e-12 at least."""
    start = F.col("rise_s") + path.latency_min_s - path.before_s
    named = sources.select("capture_id", "id", (start - path.look_back_s).alias("__from"), start.alias("__start"), (F.col("rise_s") + max(path.late_s, path.latency_max_s)).alias("__to"))
    near = interval_join(named, signal.select("capture_id", "t", "v"), "capture_id", "__from", "__to", "t", path.look_back_s + path.late_s, fixed=True)
    level = near.groupBy("capture_id", "id").agg(F.max(F.when(F.col("t") >= F.col("__start"), F.col("v"))).alias("peak"), F.median(F.when(F.col("t") < F.col("__start"), F.col("v"))).alias("baseline"))
    away = near.where(F.col("t") < F.col("__start")).join(level.select("capture_id", "id", "baseline"), ["capture_id", "id"]).groupBy("capture_id", "id").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("baseline")))).alias("mad"))
    out = sources.select("capture_id", "id").join(level, ["capture_id", "id"], "left").join(away, ["capture_id", "id"], "left")
    return out.select("capture_id", "id", F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.greatest(F.coalesce("mad", F.lit(0.0)), F.lit(1e-12)).alias("noise"))


def merges(sources: DataFrame, outputs: DataFrame, path: Path) -> DataFrame:
    """(capture_id, id, merged_into): sources of which an output spans the arrival of two or more; the first such output."""
    longest = max(path.latency_max_s, path.latency_min_s)
    due = sources.select("capture_id", "id", (F.col("rise_s") + path.latency_min_s + path.slack_s).alias("due"), (F.col("fall_s") + longest - path.slack_s).alias("over"))
    spans = outputs.select("capture_id", F.col("id").alias("output"), F.col("rise_s").alias("o_rise"), F.col("fall_s").alias("o_fall"), (F.col("fall_s") + 2 * path.slack_s).alias("__until"))
    held = interval_join(spans, due, "capture_id", "o_rise", "__until", "due", path.late_s).where("o_fall >= over")
    many = held.groupBy("capture_id", "output").agg(F.count("*").alias("k")).where("k >= 2")
    return held.join(many, ["capture_id", "output"]).groupBy("capture_id", "id").agg(F.min_by("output", F.struct("o_rise", "output")).alias("merged_into"))


def ring_q(starts: DataFrame, signal: DataFrame, span_s: float, smooth: int = 1) -> DataFrame:
    """(capture_id, id, q) of starts(capture_id, id, start_s, base): from the logarithmic decrement of successive positive peaks
    within span_s (smoothed over `smooth` samples). Null under 20 samples, without two decays, or outside 0.2 to 100."""
    near = interval_join(starts.withColumn("__to", F.col("start_s") + span_s), signal.select("capture_id", "t", "v"), "capture_id", "start_s", "__to", "t", span_s, fixed=True)
    w = Window.partitionBy("capture_id", "id").orderBy("t")
    rows = near.withColumn("s", F.avg(F.col("v") - F.col("base")).over(w.rowsBetween(-(smooth // 2), smooth - 1 - smooth // 2))).withColumn("samples", F.count("*").over(Window.partitionBy("capture_id", "id")))
    tops = rows.withColumn("b", F.lag("s").over(w)).withColumn("a", F.lead("s").over(w)).where("samples >= 20 AND s > b AND s >= a AND s > 0")
    falls = tops.withColumn("next", F.lead("s").over(w)).where("s > next").groupBy("capture_id", "id").agg(F.median(F.ln(F.col("s") / F.col("next"))).alias("d"), F.count("*").alias("k"))
    q = F.lit(3.141592653589793) / F.sqrt(F.col("d") * F.col("d") + 1e-12)
    return falls.where("k >= 2 AND d > 0").select("capture_id", "id", F.when(q.between(0.2, 100), q).alias("q"))


def outcomes(sources: DataFrame, outputs: DataFrame, signal: DataFrame, scales: DataFrame, path: Path) -> DataFrame:
    """A row for each source: capture_id, id, outcome, mechanism, confidence, acquisition, matched (output ids in order of time),
    latency_s, width_ratio, peak, tau_s, cutoff_hz, q. scales(capture_id, amplitude, base): the source signal's span and the
    output's resting level (absent: 0).

    In this order: an output that spans several sources merged them; several outputs within the latency are a split; one is
    late, collapsed, stretched or valid; without any, the acquisition may have missed it, nothing came through, it
    stayed under the threshold, or the miss is unresolved. Widths that collapse: under half the source's, or under half the
    median of the capture's sources (or least_width_s)."""
    own = sources.select("capture_id", "id", "rise_s", width(sources).alias("width"))
    windows = own.select("capture_id", "id", "rise_s", "width", (F.col("rise_s") + path.latency_min_s).alias("__low"), (F.col("rise_s") + max(path.latency_max_s, path.late_s)).alias("__high"))
    heard = outputs.select("capture_id", F.col("id").alias("output"), F.col("rise_s").alias("o_rise"), width(outputs).alias("o_width"))
    pairs = interval_join(windows, heard, "capture_id", "__low", "__high", "o_rise", max(path.latency_max_s, path.late_s), fixed=True)
    due = F.col("o_rise") <= F.col("rise_s") + path.latency_max_s
    one = F.struct("o_rise", "output", "o_width")
    met = pairs.groupBy("capture_id", "id").agg(F.array_sort(F.collect_list(F.when(due, one))).alias("due"), F.min(F.when(~due, one)).alias("late"))  # outputs within one pulse's latency
    limit = F.lit(path.least_width_s) if path.least_width_s is not None else F.col("typical") / 2
    typical = own.groupBy("capture_id").agg(F.median("width").alias("typical"))
    rows = own.join(typical, "capture_id").join(met, ["capture_id", "id"], "left").join(merges(sources, outputs, path), ["capture_id", "id"], "left")
    into = heard.select("capture_id", F.col("output").alias("merged_into"), F.struct("o_rise", "output", "o_width").alias("merger"))
    rows = rows.join(into, ["capture_id", "merged_into"], "left").join(responses(sources, signal, path), ["capture_id", "id"]).join(scales, "capture_id", "left")
    rows = rows.withColumn("limit", limit).withColumn("acquisition", F.expr(acquisition("width", path))).withColumn("n", F.coalesce(F.size("due"), F.lit(0)))
    rows = rows.withColumn("o", F.expr("coalesce(merger, get(due, 0), late)")).withColumn("latency_s", F.expr("o.o_rise - rise_s")).withColumn("width_ratio", F.expr("o.o_width / greatest(width, 1e-12)"))
    rows = rows.na.fill(0.0, ["amplitude", "base"]).withColumn("snr", F.expr("(peak - baseline) / noise"))
    rows = rows.withColumn("outcome", F.expr(f"""CASE WHEN merger IS NOT NULL THEN 'pulse merging' WHEN n > 1 THEN 'pulse splitting'
        WHEN n = 0 AND late IS NULL THEN CASE WHEN acquisition = 'inadequate' THEN 'possible acquisition miss' WHEN peak - baseline <= greatest({NOISES} * noise, {RESPONSE} * amplitude) THEN 'complete pulse non-propagation'
            WHEN peak < {path.threshold!r}D THEN 'subthreshold pulse suppression' ELSE 'unresolved pulse miss' END
        WHEN n = 0 THEN 'late pulse propagation' WHEN o.o_width < limit OR width_ratio < {COLLAPSED} THEN 'pulse-width collapse' WHEN width_ratio > {STRETCHED} THEN 'pulse stretching' ELSE 'valid pulse propagation' END"""))
    # A first-order path that rose to peak within the pulse.
    rows = rows.withColumn("rise", F.expr("if(amplitude - base > 0 AND peak - base > 0, (peak - base) / (amplitude - base), NULL)")).withColumn("missed", F.col("outcome").isin(MISSED))
    rows = rows.withColumn("decay", F.expr(f"if(missed AND rise > 0 AND rise < {NEAR_FULL}, ln(greatest(1e-12, 1 - rise)), NULL)")).withColumn("tau_s", F.expr(quotient("-width", "decay")))  # a pulse without width has tau 0
    split = rows.where("outcome = 'pulse splitting'").select("capture_id", "id", F.col("o.o_rise").alias("start_s"), "base")
    rows = rows.join(ring_q(split, signal, path.late_s / 2, max(1, round(3e-6 * path.rate))), ["capture_id", "id"], "left")
    confidence = """CASE WHEN outcome IN ('pulse merging', 'pulse splitting') THEN if(acquisition IN ('strong', 'usable'), 'high', 'limited') WHEN outcome = 'possible acquisition miss' THEN 'unresolved'
        WHEN outcome = 'complete pulse non-propagation' THEN if(acquisition = 'strong', 'high', 'moderate') WHEN outcome = 'subthreshold pulse suppression' THEN if(snr >= {snr}, 'high', 'moderate')
        WHEN outcome = 'unresolved pulse miss' THEN 'moderate' ELSE if(acquisition = 'strong', 'high', 'moderate') END""".format(snr=CLEAR_SNR)
    mechanism = """CASE outcome WHEN 'pulse merging' THEN 'slow recovery or debounce' WHEN 'pulse splitting' THEN if(q IS NOT NULL, 'ringing', 'chatter or repeated crossings') WHEN 'possible acquisition miss' THEN 'too few samples or too little bandwidth'
        WHEN 'complete pulse non-propagation' THEN 'open or gated path' WHEN 'subthreshold pulse suppression' THEN if(tau_s IS NOT NULL, 'low-pass attenuation', 'attenuation or weak drive') WHEN 'unresolved pulse miss' THEN 'gating or unmatched timing'
        WHEN 'late pulse propagation' THEN 'delay on the path' WHEN 'pulse-width collapse' THEN 'clipping or filtering' WHEN 'pulse stretching' THEN 'slow discharge or hold' ELSE 'none' END"""
    matched = "CASE WHEN merger IS NOT NULL THEN array(merger.output) WHEN n > 1 THEN transform(due, x -> x.output) WHEN o IS NULL THEN array() ELSE array(o.output) END"
    return rows.select("capture_id", "id", "outcome", F.expr(mechanism).alias("mechanism"), F.expr(confidence).alias("confidence"), "acquisition", F.expr(f"array_join({matched}, ',')").alias("matched"), "latency_s", "width_ratio", "peak", "tau_s", F.expr(quotient("1", "(2 * pi() * tau_s)")).alias("cutoff_hz"), "q")


def summary(found: DataFrame, outputs: DataFrame) -> DataFrame:
    """By capture: expected, matched, missed, split, merged_groups, extra_outputs, detection_ratio, acquisition_limited, dominant (the
    commonest outcome, of equals the first by name). Captures with outputs only have no row."""
    missed = F.col("outcome").isin(MISSED)
    used = found.where("matched <> ''").select("capture_id", F.explode(F.split("matched", ",")).alias("output"), F.when(F.col("outcome") == "pulse merging", F.col("matched")).alias("group"))
    by = used.groupBy("capture_id").agg(F.countDistinct("output").alias("used"), F.countDistinct("group").alias("merged_groups"))
    total = outputs.groupBy("capture_id").agg(F.count("*").alias("outputs"))
    common = found.groupBy("capture_id", "outcome").agg(F.count("*").alias("k")).groupBy("capture_id").agg(F.min_by("outcome", F.struct(-F.col("k"), "outcome")).alias("dominant"))
    out = found.groupBy("capture_id").agg(F.count("*").alias("expected"), F.count_if(~missed).alias("matched"), F.count_if(missed).alias("missed"), F.count_if(F.col("outcome") == "pulse splitting").alias("split"), F.count_if(F.col("acquisition").isin("inadequate", "limited")).alias("acquisition_limited"))
    out = out.join(by, "capture_id", "left").join(total, "capture_id", "left").join(common, "capture_id").na.fill(0, ["used", "merged_groups", "outputs"])
    return out.select("capture_id", "expected", "matched", "missed", "split", "merged_groups", (F.col("outputs") - F.col("used")).alias("extra_outputs"), (F.col("matched") / F.col("expected")).alias("detection_ratio"), "acquisition_limited", "dominant")
