"""The signature rule base as data. Its scores are one projection over the feature row: the rules are a constant array,
walked by array functions, so the generated code stays small however many rules there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What rules look at; abs_gain is derived.
VALUES = ["rms_ratio", "peak_ratio", "correlation", "gain", "abs_gain", "low_freq_ratio", "mid_freq_ratio", "high_freq_ratio", "edge_segments", "zero_crossings", "initial_vs_final_rms", "derivative_rms"]

#: Fixed values. Signature: family, terms (weight, feature, low, high), conditions, reason if all hold, reason if not.
RULES = {
    "pq_voltage_sag": ("power_quality", [(0.28, "rms_ratio", 0.74, 0.8), (0.22, "peak_ratio", 1.04, 1.18), (0.2, "correlation", -0.4, 0.1), (0.15, "gain", -0.3, 0.02), (0.15, "initial_vs_final_rms", 0.96, 1.05)], [("rms_ratio", "<", 0.82), ("peak_ratio", ">", 1.02), ("correlation", "<", 0.2), ("gain", "<", 0.1)], "reduced_rms_and_gain", "no_sag_like_drop"),
    "pq_voltage_swell": ("power_quality", [(0.3, "rms_ratio", 1.01, 1.05), (0.25, "peak_ratio", 1.45, 1.6), (0.2, "low_freq_ratio", 0.45, 0.7), (0.15, "correlation", -0.25, 0.1), (0.1, "abs_gain", 0.05, 0.25)], [("rms_ratio", ">", 1.0), ("peak_ratio", ">", 1.35), ("low_freq_ratio", ">", 0.4)], "elevated_rms_and_gain", "no_swell_like_rise"),
    "pq_short_interruption": ("power_quality", [(0.32, "rms_ratio", 0.68, 0.76), (0.2, "peak_ratio", 1.0, 1.15), (0.18, "high_freq_ratio", 0.48, 0.74), (0.15, "zero_crossings", 50.0, 450.0), (0.15, "edge_segments", 1.0, 3.0)], [("rms_ratio", "<", 0.78), ("peak_ratio", ">", 0.98), ("high_freq_ratio", ">", 0.42)], "near_zero_energy_window", "not_short_interruption_like"),
    "pq_harmonic_distortion": ("power_quality", [(0.28, "rms_ratio", 0.87, 0.93), (0.28, "mid_freq_ratio", 0.1, 0.2), (0.24, "high_freq_ratio", 0.25, 0.62), (0.12, "peak_ratio", 1.15, 1.28), (0.08, "low_freq_ratio", 0.25, 0.7)], [("mid_freq_ratio", ">", 0.08), ("high_freq_ratio", ">", 0.22), ("rms_ratio", ">", 0.84)], "harmonic_energy_enhanced", "insufficient_harmonic_energy"),
    "pq_flicker_am_mod": ("power_quality", [(0.3, "low_freq_ratio", 0.55, 0.85), (0.25, "peak_ratio", 1.15, 1.35), (0.2, "high_freq_ratio", 0.15, 0.45), (0.15, "zero_crossings", 0.0, 100.0), (0.1, "abs_gain", 0.0, 0.08)], [("low_freq_ratio", ">", 0.5), ("high_freq_ratio", "<", 0.5), ("peak_ratio", ">", 1.1), ("zero_crossings", "<", 120.0)], "slow_amplitude_envelope_variation", "no_clear_flicker_envelope"),
    "pq_commutation_notch": ("power_quality", [(0.28, "peak_ratio", 1.2, 1.38), (0.24, "zero_crossings", 18.0, 140.0), (0.24, "high_freq_ratio", 0.34, 0.7), (0.14, "mid_freq_ratio", 0.03, 0.07), (0.1, "correlation", -0.2, 0.2)], [("peak_ratio", ">", 1.18), ("zero_crossings", ">=", 12.0), ("high_freq_ratio", ">", 0.3)], "sharp_event_cluster_detected", "no_commutation_notch_cluster"),
    "pq_impulsive_transient": ("power_quality", [(0.28, "peak_ratio", 1.1, 2.2), (0.24, "high_freq_ratio", 0.4, 0.68), (0.2, "initial_vs_final_rms", 1.08, 1.22), (0.14, "rms_ratio", 0.84, 0.92), (0.14, "zero_crossings", 8.0, 120.0)], [("peak_ratio", ">", 1.05), ("high_freq_ratio", ">", 0.36), ("initial_vs_final_rms", ">", 1.05)], "impulsive_peak_and_derivative", "no_impulsive_transient"),
    "pq_oscillatory_transient": ("power_quality", [(0.3, "high_freq_ratio", 0.45, 0.72), (0.25, "peak_ratio", 1.05, 1.2), (0.18, "rms_ratio", 0.84, 0.92), (0.15, "gain", -0.2, 0.05), (0.12, "mid_freq_ratio", 0.025, 0.06)], [("high_freq_ratio", ">", 0.4), ("peak_ratio", ">", 1.02), ("rms_ratio", ">", 0.82)], "oscillatory_tail_energy", "no_oscillatory_tail"),
    "emi_eft_burst": ("switching_emc", [(0.26, "rms_ratio", 0.08, 0.14), (0.24, "high_freq_ratio", 0.82, 0.95), (0.2, "initial_vs_final_rms", 0.95, 1.15), (0.16, "peak_ratio", 0.4, 0.6), (0.14, "zero_crossings", 100.0, 2000.0)], [("rms_ratio", "<", 0.16), ("high_freq_ratio", ">", 0.8), ("initial_vs_final_rms", ">", 0.92), ("initial_vs_final_rms", "<", 1.2)], "burst_like_edge_cluster", "no_eft_burst_pattern"),
    "current_inrush": ("switching_emc", [(0.32, "initial_vs_final_rms", 2.2, 3.2), (0.26, "rms_ratio", 0.38, 0.46), (0.18, "peak_ratio", 1.04, 1.2), (0.12, "correlation", 0.25, 0.55), (0.12, "high_freq_ratio", 0.35, 0.75)], [("initial_vs_final_rms", ">", 2.0), ("rms_ratio", "<", 0.5), ("peak_ratio", ">", 1.0)], "startup_envelope_above_recovery", "no_inrush_envelope"),
    "switch_relay_contact_bounce": ("digital_timing", [(0.28, "edge_segments", 8.0, 12.0), (0.24, "zero_crossings", 150.0, 1500.0), (0.22, "high_freq_ratio", 0.76, 0.87), (0.14, "peak_ratio", 0.62, 0.76), (0.12, "correlation", 0.08, 0.25)], [("edge_segments", ">=", 8.0), ("zero_crossings", ">=", 100.0), ("high_freq_ratio", ">", 0.72), ("peak_ratio", "<", 0.8)], "clustered_digital_toggles", "no_relay_bounce_cluster"),
    "relay_coil_inductive_kick": ("switching_emc", [(0.26, "rms_ratio", 0.09, 0.14), (0.24, "high_freq_ratio", 0.58, 0.8), (0.2, "zero_crossings", 250.0, 1500.0), (0.18, "peak_ratio", 0.88, 1.04), (0.12, "initial_vs_final_rms", 0.95, 1.1)], [("rms_ratio", "<", 0.14), ("high_freq_ratio", ">", 0.55), ("peak_ratio", ">", 0.88), ("peak_ratio", "<", 1.06)], "kickback_like_transient", "no_inductive_kick_like_transient"),
    "ground_loop_hum": ("measurement_artifact", [(0.3, "rms_ratio", 0.25, 0.35), (0.24, "low_freq_ratio", 0.2, 0.4), (0.18, "peak_ratio", 0.4, 0.6), (0.18, "high_freq_ratio", 0.35, 0.85), (0.1, "zero_crossings", 20.0, 250.0)], [("rms_ratio", "<", 0.4), ("low_freq_ratio", ">", 0.18), ("peak_ratio", "<", 0.65)], "mains_frequency_dominance", "no_ground_loop_hum_signature"),
    "common_mode_noise": ("measurement_artifact", [(0.3, "rms_ratio", 0.12, 0.22), (0.24, "high_freq_ratio", 0.85, 1.0), (0.2, "peak_ratio", 0.28, 0.45), (0.16, "low_freq_ratio", 0.03, 0.12), (0.1, "initial_vs_final_rms", 0.75, 0.98)], [("rms_ratio", "<", 0.28), ("high_freq_ratio", ">", 0.82), ("peak_ratio", "<", 0.5), ("initial_vs_final_rms", "<", 1.05)], "shared_residual_energy_detected", "no_common_mode_excess"),
    "pwm_vfd_edge_coupled_noise": ("switching_emc", [(0.3, "initial_vs_final_rms", 1.25, 1.85), (0.24, "high_freq_ratio", 0.82, 0.95), (0.18, "rms_ratio", 0.15, 0.3), (0.16, "peak_ratio", 0.4, 0.6), (0.12, "zero_crossings", 120.0, 2000.0)], [("initial_vs_final_rms", ">", 1.2), ("high_freq_ratio", ">", 0.8), ("peak_ratio", "<", 0.65)], "edge_coupled_high_frequency_activity", "no_pwm_vfd_like_coupling"),
    "sensor_threshold_chatter": ("digital_timing", [(0.28, "edge_segments", 20.0, 30.0), (0.24, "zero_crossings", 240.0, 2000.0), (0.2, "high_freq_ratio", 0.76, 0.88), (0.18, "peak_ratio", 0.3, 0.42), (0.1, "initial_vs_final_rms", 1.25, 2.2)], [("edge_segments", ">=", 18.0), ("zero_crossings", ">=", 180.0), ("peak_ratio", "<", 0.5)], "threshold_hover_toggle_cluster", "no_sensor_chatter"),
    "slow_edge_late_transition": ("digital_timing", [(0.3, "correlation", 0.84, 0.95), (0.24, "gain", 0.82, 0.97), (0.22, "initial_vs_final_rms", 0.04, 0.1), (0.14, "rms_ratio", 0.83, 0.88), (0.1, "peak_ratio", 1.04, 1.18)], [("correlation", ">", 0.8), ("gain", ">", 0.75), ("initial_vs_final_rms", "<", 0.12)], "slow_transition_slope", "no_slow_edge_pattern"),
    "missed_short_pulse": ("digital_timing", [(0.3, "rms_ratio", 0.1, 0.13), (0.24, "peak_ratio", 0.84, 0.92), (0.18, "high_freq_ratio", 0.78, 0.86), (0.16, "edge_segments", 1.0, 3.0), (0.12, "zero_crossings", 120.0, 2000.0)], [("rms_ratio", "<", 0.15), ("peak_ratio", "<", 0.95), ("high_freq_ratio", ">", 0.75)], "pulse_missing_or_subthreshold", "no_missed_pulse_pattern"),
    "high_speed_input_bounce": ("digital_timing", [(0.28, "edge_segments", 12.0, 18.0), (0.24, "high_freq_ratio", 0.83, 0.92), (0.2, "peak_ratio", 0.74, 0.86), (0.18, "zero_crossings", 150.0, 2000.0), (0.1, "derivative_rms", 0.035, 0.09)], [("edge_segments", ">=", 10.0), ("high_freq_ratio", ">", 0.8), ("peak_ratio", ">", 0.7)], "clustered_input_transitions", "no_high_speed_bounce_cluster"),
}
UNMATCHED_CAP = 0.45
#: Fixed values for signatures without rules: weights of residual and correlation, and the residual that matches.
FALLBACK = (0.5, 0.2, 0.12)


def soft_margin(low: float, high: float) -> float:
    """How far outside its band a value still scores."""
    return max(0.75 * (high - low), 0.2 * abs(low), 0.2 * abs(high), 1e-6)


def _value_sql(feature: str) -> str:
    return "abs(gain)" if feature == "abs_gain" else feature


def score_sql(signature: str) -> tuple[str, str]:
    """The signature's condition and confidence over the feature columns, as SQL for any engine."""
    _, terms, conditions, *_ = RULES[signature]
    met = " AND ".join(f"{_value_sql(f)} {op} {v!r}e0" for f, op, v in conditions)
    band = lambda f, low, high: f"greatest(0e0, 1e0 - greatest({low!r}e0 - {_value_sql(f)}, {_value_sql(f)} - {high!r}e0, 0e0) / {soft_margin(low, high):.17g}e0)"
    mixed = " + ".join(f"{w!r}e0 * {band(f, low, high)}" for w, f, low, high in terms)
    score = f"least(1e0, greatest(0e0, ({mixed}) / {sum(w for w, *_ in terms):.17g}e0))"
    return met, f"CASE WHEN {met} THEN {score} ELSE least({UNMATCHED_CAP}e0, {score}) END"


def _constant(signatures: list[str]) -> str:
    """The rules as a constant array of structs; features by their place in VALUES."""
    number = lambda x: f"{float(x)!r}D"
    rows = []
    for s in signatures:
        family, terms, conditions, yes, no = RULES[s]
        total = sum(w for w, *_ in terms)
        t = ", ".join(f"named_struct('w', {number(w / total)}, 'i', {VALUES.index(f)}, 'low', {number(low)}, 'high', {number(high)}, 'soft', {number(soft_margin(low, high))})" for w, f, low, high in terms)
        c = ", ".join(f"named_struct('i', {VALUES.index(f)}, 'op', '{op}', 'v', {number(v)})" for f, op, v in conditions)
        rows.append(f"named_struct('id', '{s}', 'family', '{family}', 'terms', array({t}), 'conditions', array({c}), 'yes', '{yes}', 'no', '{no}')")
    return f"array({', '.join(rows)})"


def score_signatures(features: DataFrame, signatures: list[str] | None = None) -> DataFrame:
    """features with a column `scores`: an array of (signature_id, family, matched, confidence, reason), one for each
    signature; features are neither shuffled nor multiplied. A signature without rules takes the fallback: residual and
    correlation. A row without features (rejected) matches nothing, with confidence 0."""
    wanted = list(signatures or RULES)
    known, others = [s for s in wanted if s in RULES], [s for s in wanted if s not in RULES]
    values = "array(" + ", ".join(_value_sql(v) for v in VALUES) + ")"
    score = "least(1D, greatest(0D, aggregate(r.terms, 0D, (a, t) -> a + t.w * greatest(0D, 1D - greatest(t.low - v[t.i], v[t.i] - t.high, 0D) / t.soft))))"
    met = "forall(r.conditions, c -> CASE c.op WHEN '>' THEN v[c.i] > c.v WHEN '>=' THEN v[c.i] >= c.v ELSE v[c.i] < c.v END)"
    row = "named_struct('signature_id', {id}, 'family', {family}, 'matched', x.met, 'confidence', if(x.met, x.score, least(%sD, x.score)), 'reason', if(x.met, {yes}, {no}))" % UNMATCHED_CAP
    let = lambda name, e, body: f"transform(array({e}), {name} -> {body})[0]"
    parts = []
    if known:
        one = let("x", f"named_struct('met', coalesce({met}, false), 'score', if(gain IS NULL, 0D, {score}))", row.format(id="r.id", family="r.family", yes="r.yes", no="r.no"))
        parts.append(let("v", values, f"transform({_constant(known)}, r -> {one})"))
    for s in others:
        a, b, least = FALLBACK
        weak = f"named_struct('met', coalesce(residual_energy_ratio > {least}D, false), 'score', coalesce(least(1D, greatest(0D, {a}D * residual_energy_ratio + {b}D * greatest(correlation, 0D))), 0D))"
        parts.append(f"array({let('x', weak, row.format(id=repr(s), family=repr('unknown'), yes=repr('generic_residual'), no=repr('no_residual')))})")
    return features.withColumn("scores", F.expr(f"concat({', '.join(parts)})"))


def ranked(scored: DataFrame) -> DataFrame:
    """One row a capture: its best reference for each signature, signatures ranked in tournament order, and the winner.

    scored(capture_id, reference_label, scores). The best reference is the matched, most confident one, ties by label.
    Ranking: matched first, then confidence, then signature id. Only (capture, signature) minima are shuffled."""
    long = scored.select("capture_id", "reference_label", F.inline("scores"))
    order = F.struct((~F.col("matched")).alias("a"), (-F.col("confidence")).alias("b"), F.col("reference_label").alias("c"))
    best = long.groupBy("capture_id", "signature_id").agg(F.min(F.struct(order.alias("o"), "matched", "confidence", "reference_label", "reason", "family")).alias("best"))
    entry = F.struct((~F.col("best.matched")).alias("unmatched"), (-F.col("best.confidence")).alias("minus"), "signature_id", F.col("best.reference_label").alias("best_reference"), F.col("best.reason").alias("reason"))
    cases = best.groupBy("capture_id").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    top = F.col("ranked")[0]
    return cases.select(
        "capture_id",
        F.when(~top.unmatched, top.signature_id).alias("winner"),
        F.when(~top.unmatched, F.lit("matched")).otherwise(F.lit("no_match")).alias("decision"),
        top.signature_id.alias("top_signature"),
        (-top.minus).alias("top_confidence"),
        top.best_reference.alias("best_reference"),
        F.when(~top.unmatched, F.array(F.concat(F.lit("best_reference="), top.best_reference), top.reason)).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.when(top.unmatched, F.array(top.reason)).otherwise(F.array().cast("array<string>")).alias("rejections"),
        F.array_join(F.transform("ranked", lambda x: x.signature_id), " > ").alias("ranked_ids"),
    )
