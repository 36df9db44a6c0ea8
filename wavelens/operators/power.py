"""Power of analyzers over case rows: success by bucket, ranking, worst buckets, concentration, and bootstrap.

All bucket types are rows of one aggregation: a case is exploded into its (type, value) buckets, so the cases are read and
shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio_or_zero

#: The balanced objective's weights, and the normal quantile of a 95 % interval.
WEIGHTS = {
    "posterior_mean_success": 0.25, "posterior_lower_success": 0.20, "precision": 0.12, "recall": 0.12, "specificity": 0.10, "worst_bucket_success": 0.08, "high_noise_success": 0.06, "conflict_resistance": 0.05,
    "one_minus_false_positive_rate": 0.02, "one_minus_false_negative_rate": 0.02, "one_minus_fp_concentration_share": 0.02, "one_minus_high_noise_gap": 0.01, "one_minus_primary_stolen_rate": 0.01,
}
Z = 1.959963984540054
BUCKETS = ["family", "split", "noise_tier", "waveform_intent", "test_id", "truth_label", "reference_status", "conflict_state", "target_rule"]
FP_BUCKETS = ["split", "noise_tier", "waveform_intent", "test_id", "conflict_state"]


def beta_interval(successes: Column, failures: Column, alpha: float = 1.0, beta: float = 1.0) -> tuple[Column, Column, Column]:
    """Mean and 95 % interval of the Beta posterior, by its normal approximation."""
    a, b = successes + alpha, failures + beta
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return mean, F.greatest(F.lit(0.0), mean - Z * sd), F.least(F.lit(1.0), mean + Z * sd)


def objective(metric: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    return sum((F.lit(w) * metric[m] for m, w in weights.items()), F.lit(0.0))


def _joined_key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def is_conflict() -> Column:
    return F.col("ambiguous") | F.col("primary_stolen") | F.col("is_false_positive") | F.col("is_false_negative")


def success_distribution(cases: DataFrame) -> DataFrame:
    """Successes, posterior, rates, noise gap, worst bucket, concentration and power of each analyzer, bucket type and value.

    cases are case_rows with reference_status and target_rule. Worst bucket: the least success rate by split, noise, intent
    and state. Concentration: the share of the commonest (test, noise, intent, state) of the false positives."""
    types = F.array(F.struct(F.lit("overall").alias("bucket_type"), F.lit("all").alias("bucket_value")), *(F.struct(F.lit(b).alias("bucket_type"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("bucket_value")) for b in BUCKETS))
    keys = ["analyzer_id", "bucket_type", "bucket_value"]
    fine = cases.withColumn("worst_key", _joined_key("split", "noise_tier", "waveform_intent", "conflict_state")).withColumn("fp_key", _joined_key("test_id", "noise_tier", "waveform_intent", "conflict_state"))
    count = lambda c: F.count_if(c)
    positive, right = F.col("expected_fault_present"), F.col("is_correct")
    parts = {
        "n_cases": F.count("*"), "successes": count(right), "tp": count(positive & right), "fn": count(positive & ~right), "fp": count(~positive & ~right), "tn": count(~positive & right),
        "states": count(~F.col("conflict_state").isin("negative_avoided_primary", "negative_no_match")), "stolen": count("primary_stolen"), "conflicts": count(is_conflict()), "conflict_wins": count(is_conflict() & right),
        "high_n": count(F.col("noise_tier") == "high"), "high_wins": count((F.col("noise_tier") == "high") & right), "normal_n": count(F.col("noise_tier") == "normal"), "normal_wins": count((F.col("noise_tier") == "normal") & right), "fps": count("is_false_positive"),
    }
    # By all bucket columns at once first: what is multiplied by the bucket types are counts, whatever the number of cases.
    total = lambda names: [F.sum(k).alias(k) for k in names]
    counts = fine.groupBy("analyzer_id", *BUCKETS, "worst_key", "fp_key").agg(*(v.alias(k) for k, v in parts.items()))
    small = counts.select("analyzer_id", F.inline(types), "worst_key", "fp_key", *parts).groupBy(*keys, "worst_key", "fp_key").agg(*total(parts))
    by_worst = small.groupBy(*keys, "worst_key").agg(*total(parts))
    worst = by_worst.groupBy(*keys).agg(*total(parts), F.min(F.col("successes") / F.col("n_cases")).alias("worst_bucket_success"))
    top = small.groupBy(*keys, "fp_key").agg(F.sum("fps").alias("k")).groupBy(*keys).agg(F.max("k").alias("top_fp"))
    d = worst.join(top, keys)
    n, s = F.col("n_cases"), F.col("successes")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    mean, low, high = beta_interval(s, n - s)
    d = d.select(
        *keys, "n_cases", "successes", mean.alias("posterior_mean"), low.alias("credible_low"), high.alias("credible_high"), ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), ratio_or_zero(tn, tn + fp).alias("specificity"),
        ratio_or_zero(fp, fp + tn).alias("false_positive_rate"), ratio_or_zero(fn, fn + tp).alias("false_negative_rate"), ratio_or_zero(F.col("states"), n).alias("conflict_rate"), ratio_or_zero(F.col("stolen"), n).alias("primary_stolen_rate"),
        ratio_or_zero(F.col("high_wins"), F.col("high_n")).alias("high_noise_success"), ratio_or_zero(F.col("normal_wins"), F.col("normal_n")).alias("normal_noise_success"), "worst_bucket_success",
        ratio_or_zero(F.col("top_fp"), F.col("fps")).alias("fp_concentration_share"), F.when(F.col("conflicts") > 0, F.col("conflict_wins") / F.col("conflicts")).otherwise(1.0).alias("conflict_resistance"), "conflicts",
    )
    d = d.withColumn("high_noise_delta", F.col("high_noise_success") - F.col("normal_noise_success"))
    return d.withColumn("power_score", objective(_metrics(F.col("posterior_mean"), F.col("conflict_resistance"))))


def _metrics(mean: Column, resistance: Column) -> dict[str, Column]:
    c = F.col
    return {
        "posterior_mean_success": mean, "posterior_lower_success": c("credible_low"), "precision": c("precision"), "recall": c("recall"), "specificity": c("specificity"), "worst_bucket_success": c("worst_bucket_success"), "high_noise_success": c("high_noise_success"), "conflict_resistance": resistance,
        "one_minus_false_positive_rate": 1 - c("false_positive_rate"), "one_minus_false_negative_rate": 1 - c("false_negative_rate"), "one_minus_fp_concentration_share": 1 - c("fp_concentration_share"), "one_minus_high_noise_gap": 1 - F.abs("high_noise_delta"), "one_minus_primary_stolen_rate": 1 - c("primary_stolen_rate"),
    }


def ranking(distribution: DataFrame) -> DataFrame:
    """Overall rows ranked by power, lower-bound power and posterior mean, with a recommended status. The lower bound takes
    1 - conflict_rate for the resistance to conflicts. Ties go to the lesser id. One row for each analyzer."""
    o = distribution.where("bucket_type = 'overall'").withColumn("lower_bound_power", objective(_metrics(F.col("credible_low"), 1 - F.col("conflict_rate"))))
    c = F.col
    lower, share, resist, gap, worst = c("lower_bound_power"), c("fp_concentration_share"), c("conflict_resistance"), F.abs("high_noise_delta"), c("worst_bucket_success")
    status = (
        F.when((lower >= 0.82) & (share <= 0.20) & (resist >= 0.80) & (gap <= 0.12), "promote")
        .when((lower >= 0.70) & (c("precision") >= 0.80) & (share <= 0.28) & (worst >= 0.65), "keep")
        .when((c("precision") >= 0.80) & (share >= 0.30), "guardrail_needed")
        .when((lower < 0.60) | (worst < 0.55) | (c("recall") < 0.65), "do_not_trust")
        .otherwise("tune")
    )
    order = Window.orderBy(F.desc("power_score"), F.desc("lower_bound_power"), F.desc("posterior_mean"), "analyzer_id")
    return o.withColumn("recommended_status", status).withColumn("rank", F.row_number().over(order)).select("rank", "analyzer_id", F.col("power_score").alias("mean_power"), "lower_bound_power", "posterior_mean", "credible_low", "recommended_status")


def worst_buckets(distribution: DataFrame) -> DataFrame:
    """Each analyzer's bucket of the least success rate, then the least lower bound, then the most cases, then type and value."""
    rate = F.col("successes") / F.col("n_cases")
    key = F.struct(rate.alias("success_rate"), "credible_low", (-F.col("n_cases")).alias("m"), "bucket_type", "bucket_value")
    w = distribution.where("bucket_type <> 'overall' AND n_cases > 0").groupBy("analyzer_id").agg(F.min(key).alias("k"))
    return w.select("analyzer_id", "k.bucket_type", "k.bucket_value", (-F.col("k.m")).alias("n_cases"), "k.success_rate", "k.credible_low")


def false_positive_concentration(cases: DataFrame) -> DataFrame:
    """Each analyzer's commonest bucket of false positives over five dimensions, of equal ones the last by type and value.
    An analyzer without false positives has a row with count 0."""
    stack = F.array(*(F.struct(F.lit(b).alias("t"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("v")) for b in FP_BUCKETS))
    counts = cases.where("is_false_positive").select("analyzer_id", F.inline(stack)).groupBy("analyzer_id", "t", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("analyzer_id").agg(F.max(F.struct("n", "t", "v")).alias("m"))
    every = cases.groupBy("analyzer_id").agg(F.count_if("is_false_positive").alias("false_positive_cases"))
    return every.join(top, "analyzer_id", "left").select(
        "analyzer_id", "false_positive_cases", ratio_or_zero(F.col("m.n"), F.col("false_positive_cases")).alias("fp_concentration_share"),
        F.coalesce("m.t", F.lit("")).alias("top_fp_bucket_type"), F.coalesce("m.v", F.lit("")).alias("top_fp_bucket_value"), F.coalesce("m.n", F.lit(0)).cast("bigint").alias("top_fp_count"),
    )


def noise_table(distribution: DataFrame, cases: DataFrame) -> DataFrame:
    """Success by noise tier, their gap and stability, with the numbers of cases, by analyzer."""
    n = cases.groupBy("analyzer_id").agg(F.count_if(F.col("noise_tier") == "normal").alias("normal_noise_cases"), F.count_if(F.col("noise_tier") == "high").alias("high_noise_cases"))
    o = distribution.where("bucket_type = 'overall'").select("analyzer_id", "normal_noise_success", "high_noise_success", "high_noise_delta", (1 - F.abs("high_noise_delta")).alias("noise_stability_score"))
    return o.join(n, "analyzer_id")


def conflict_table(cases: DataFrame) -> DataFrame:
    """Cases in conflict and how they ended, by analyzer."""
    k = is_conflict()
    out = cases.groupBy("analyzer_id").agg(F.count("*").alias("n"), F.count_if(k).alias("conflict_cases"), F.count_if(k & F.col("is_correct")).alias("conflict_successes"), F.count_if("primary_stolen").alias("primary_stolen_cases"), F.count_if("ambiguous").alias("multi_match_ambiguity_cases"))
    return out.select("analyzer_id", "conflict_cases", "conflict_successes", F.when(F.col("conflict_cases") > 0, F.col("conflict_successes") / F.col("conflict_cases")).otherwise(1.0).alias("conflict_resistance"), "primary_stolen_cases", ratio_or_zero(F.col("primary_stolen_cases"), F.col("n")).alias("primary_stolen_rate"), "multi_match_ambiguity_cases", ratio_or_zero(F.col("conflict_cases"), F.col("n")).alias("conflict_rate"))


def power_summary(ranked: DataFrame) -> DataFrame:
    """One row: the analyzers with the most mean power, the most and the least lower-bound power (ties: the lesser id)."""
    pick = lambda *order: F.min(F.struct(*order, "analyzer_id")).getField("analyzer_id")
    most, least = (-F.col("mean_power")).alias("m"), (-F.col("lower_bound_power")).alias("l")
    return ranked.agg(F.count("*").alias("total_analyzers"), pick(most, least).alias("strongest_by_mean"), pick(least, most).alias("strongest_by_lower_bound"), pick(F.col("lower_bound_power").alias("l"), F.col("mean_power").alias("m")).alias("weakest"))


def bootstrap_power(cases: DataFrame, resamples: int = 400, seed: int = 1337) -> DataFrame:
    """Mean and 95 % interval of each analyzer's power over resamples of its cases.

    The power is a function of the numbers of cases by outcome, noise, state and fine keys; so a resample is a multinomial
    draw over these combinations, which Spark counts once. No case is copied or gathered."""
    kinds = ["noise_tier", "is_correct", "expected_fault_present", "is_false_positive", "primary_stolen", "conflict", "fp_key"]
    rows = cases.withColumn("conflict", is_conflict()).withColumn("fp_key", _joined_key("test_id", "noise_tier", "waveform_intent", "conflict_state"))
    counts = rows.groupBy("analyzer_id", *kinds).agg(F.count("*").alias("n"))
    schema = "analyzer_id string, power_score_estimate double, power_score_ci_low double, power_score_ci_high double, n_bootstrap int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(kinds)
        drawn = np.random.default_rng(seed).multinomial(pdf.n.sum(), pdf.n / pdf.n.sum(), resamples).astype(float)
        score = power_of(pdf, drawn)
        low, high = np.quantile(score, [0.025, 0.975])
        return pd.DataFrame({"analyzer_id": [str(pdf.analyzer_id.iloc[0])], "power_score_estimate": [score.mean()], "power_score_ci_low": [low], "power_score_ci_high": [high], "n_bootstrap": np.int32([resamples])})

    return counts.groupBy("analyzer_id").applyInPandas(run, schema)


def power_of(kinds: pd.DataFrame, drawn: np.ndarray) -> np.ndarray:
    """Power for rows of numbers of cases, one column for each of kinds."""
    count = lambda mask: drawn[:, np.asarray(mask, bool)].sum(1)
    over = lambda a, b, none=0.0: np.divide(a, b, out=np.full_like(a, none), where=b > 0)
    right, positive, n = kinds.is_correct, kinds.expected_fault_present, drawn.sum(1)
    tp, fn, fp, tn = count(positive & right), count(positive & ~right), count(~positive & ~right), count(~positive & right)
    a, b = count(right) + 1, n - count(right) + 1
    mean = a / (a + b)
    low = np.maximum(0, mean - Z * np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
    tiers = {t: (count((kinds.noise_tier == t) & right), count(kinds.noise_tier == t)) for t in kinds.noise_tier.unique()}
    rate = {t: over(*x) for t, x in tiers.items()}
    zero = np.zeros(len(drawn))
    high, normal = rate.get("high", zero), rate.get("normal", zero)
    worst = np.min([np.where(tiers[t][1] > 0, rate[t], np.inf) for t in tiers], axis=0)
    wrong = kinds.is_false_positive
    tops = np.max([count(wrong & (kinds.fp_key == k)) for k in kinds.fp_key[wrong].unique()] or [zero], axis=0)
    metric = {
        "posterior_mean_success": mean, "posterior_lower_success": low, "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "specificity": over(tn, tn + fp), "worst_bucket_success": worst, "high_noise_success": high, "conflict_resistance": over(count(kinds.conflict & right), count(kinds.conflict), 1.0),
        "one_minus_false_positive_rate": 1 - over(fp, fp + tn), "one_minus_false_negative_rate": 1 - over(fn, fn + tp), "one_minus_fp_concentration_share": 1 - over(tops, count(wrong)), "one_minus_high_noise_gap": 1 - np.abs(high - normal), "one_minus_primary_stolen_rate": 1 - count(kinds.primary_stolen) / n,
    }
    return sum(w * metric[m] for m, w in WEIGHTS.items())
