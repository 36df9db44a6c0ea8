"""Threshold profiles compared on whole campaigns: decisions, metrics, objectives, ablation and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion_counts, ratio_or_zero

METRICS = ["accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1", "false_positive_rate", "false_negative_rate"]

#: Fixed values. Objective: gain, its penalised rate, that rate's floor.
GATED = {"balanced_default": ("balanced_accuracy", "precision", 0.88), "conservative_precision": ("precision", "recall", 0.85), "sensitive_fault_finding": ("recall", "precision", 0.85)}
PENALTY, CONFLICT_WEIGHT = 2.0, 0.25


def threshold_of(profile: dict[str, float], default: float = 0.5) -> Column:
    """A profile's threshold for the row's signature."""
    out = F.lit(float(default))
    for signature, t in profile.items():
        out = F.when(F.col("signature_id") == signature, F.lit(float(t))).otherwise(out)
    return out


def decide(scores: DataFrame, profiles: dict[str, dict[str, float]], default: float = 0.5) -> DataFrame:
    """(capture_id, truth, tier, profile, winner, hits): each capture's decision under every profile.

    All profiles are aggregates of the same pass, so neither scores nor the shuffle are multiplied by them. The winner is
    the most confident signature that reaches its threshold, ties by id; null if none does. hits: how many do."""
    c, aggregates, rows = F.col("confidence"), [], []
    for i, (name, profile) in enumerate(profiles.items()):
        passed = c >= threshold_of(profile, default)
        aggregates += [F.min(F.when(passed, F.struct((-c).alias("c"), "signature_id"))).alias(f"w{i}"), F.count_if(passed).alias(f"h{i}")]
        rows.append(F.struct(F.lit(name).alias("profile"), F.col(f"w{i}.signature_id").alias("winner"), F.col(f"h{i}").alias("hits")))
    return scores.groupBy("capture_id", "truth", "tier").agg(*aggregates).select("capture_id", "truth", "tier", F.inline(F.array(*rows)))


def full_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Counts, rates and conflicts of cases(positive, predicted, conflict) by group; rates over nothing are 0."""
    out = cases.groupBy(*by).agg(F.count("*").alias("total"), *confusion_counts(F.col("positive"), F.col("predicted")), F.count_if("conflict").alias("conflict_cases"))
    tp, fp, tn, fn, total = (F.col(x) for x in ("tp", "fp", "tn", "fn", "total"))
    out = out.select("*", ratio_or_zero(tp + tn, total).alias("accuracy"), ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), ratio_or_zero(tn, tn + fp).alias("specificity"))
    out = out.select("*", ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_accuracy"), ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))
    return out.select("*", ratio_or_zero(fp, fp + tn).alias("false_positive_rate"), ratio_or_zero(fn, fn + tp).alias("false_negative_rate"), ratio_or_zero(F.col("conflict_cases"), total).alias("conflict_rate"))


def compare_profiles(measured: DataFrame, split: str, baseline: str, tuned: str) -> DataFrame:
    """(split, metric, baseline, tuned, delta) of full_metrics rows by profile and split; a split that only one has counts."""
    long = measured.select("profile", split, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
    of = lambda p: F.max(F.when(F.col("profile") == p, F.col("value")))
    return long.groupBy(split, "metric").agg(of(baseline).alias("baseline"), of(tuned).alias("tuned")).withColumn("delta", F.col("tuned") - F.col("baseline"))


def objectives(measured: DataFrame) -> DataFrame:
    """full_metrics rows with a column for each objective."""
    gated = {name: F.col(gain) - PENALTY * F.greatest(F.lit(0.0), F.lit(floor) - F.col(rate)) for name, (gain, rate, floor) in GATED.items()}
    return measured.withColumns(gated | {"field_triage": F.col("f1") - CONFLICT_WEIGHT * F.col("conflict_rate")})


def reverted(baseline: dict[str, float], tuned: dict[str, float]) -> dict[str, dict[str, float]]:
    """The tuned profile, and for each threshold that it changed a profile with that one put back."""
    changed = [s for s in tuned if tuned[s] != baseline.get(s)]
    return {"tuned": tuned} | {f"revert_{s}": {k: v for k, v in (tuned | {s: baseline.get(s)}).items() if v is not None} for s in changed}


def bootstrap(cases: DataFrame, by: str, resamples: int = 2000, seed: int = 1337) -> DataFrame:
    """Estimate and 95 % percentile interval of each metric by group.

    Resampling n cases draws a multinomial of the four outcomes, so only a group's four counts are resampled; cases are
    aggregated once, by Spark, and none is copied."""
    counts = full_metrics(cases, by).select(by, "tp", "fp", "tn", "fn")
    kind = f"`{by}` {dict(counts.dtypes)[by]}, metric string, estimate double, ci_low double, ci_high double, n_bootstrap int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, *outcome in batch.itertuples(index=False):
                n = np.array(outcome, np.int64)
                drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), resamples)
                low, high = np.quantile(rates(drawn), [0.025, 0.975], axis=0)
                yield pd.DataFrame({by: [group] * len(METRICS), "metric": METRICS, "estimate": rates(n[None])[0], "ci_low": low, "ci_high": high, "n_bootstrap": np.int32(resamples)})

    return counts.mapInPandas(run, kind)


def rates(outcomes: np.ndarray) -> np.ndarray:
    """METRICS of rows (tp, fp, tn, fn), 0 over nothing."""
    tp, fp, tn, fn = outcomes.T.astype(float)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    precision, recall, specificity = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fp)
    return np.stack([over(tp + tn, tp + fp + tn + fn), precision, recall, specificity, (recall + specificity) / 2, over(2 * precision * recall, precision + recall), over(fp, fp + tn), over(fn, fn + tp)], 1)


def threshold_robustness(sweep: DataFrame, score: str, near: float = 0.01) -> DataFrame:
    """By signature: best score, thresholds within near of it, the least of these, and the width of the sweep."""
    best = sweep.withColumn("best", F.expr(f"max(coalesce({score}, 0)) OVER (PARTITION BY signature_id)"))
    close = F.coalesce(F.col(score), F.lit(0.0)) >= F.col("best") - near
    return best.groupBy("signature_id").agg(F.max("best").alias("best_score"), F.count_if(close).alias("near_best"), F.min(F.when(close, F.col("threshold"))).alias("selected_threshold"), (F.max("threshold") - F.min("threshold")).alias("width"))


def session_summary(scores: DataFrame, family: Column) -> DataFrame:
    """Outcome and ambiguity counts by signature and family; a passing signature of a capture without truth is a fp."""
    is_truth, passed = F.coalesce(F.col("truth") == F.col("signature_id"), F.lit(False)), F.coalesce(F.col("matched"), F.lit(False))
    marked = scores.withColumn("ambiguous", F.expr("count_if(matched) OVER (PARTITION BY capture_id) >= 2"))
    return marked.groupBy("signature_id", family.alias("family")).agg(F.count("*").alias("total"), *confusion_counts(is_truth, passed), F.count_if("ambiguous").alias("ambiguous_cases"))


def outcome_rates(cases: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of case rows by group, with the objective balanced_default."""
    positive, right = F.col("expected_fault_present"), F.col("is_correct")
    out = cases.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(positive & right).alias("tp"), F.count_if(~positive & ~right).alias("fp"), F.count_if(~positive & right).alias("tn"), F.count_if(positive & ~right).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = out.select("*", ratio_or_zero(tp + tn, F.col("total")).alias("accuracy"), ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), ratio_or_zero(tn, tn + fp).alias("specificity"))
    out = out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    gain, rate, floor = GATED["balanced_default"]
    return out.withColumn("objective", F.col(gain) - PENALTY * F.greatest(F.lit(0.0), F.lit(floor) - F.col(rate)))


def aggregate_rows(cases: DataFrame, by: str) -> DataFrame:
    """Outcome counts, mean and sample deviation (0 for one case) of the expected analyzer's confidence by group."""
    c = outcome_rates(cases, by).select(by, "total", "tp", "fp", "tn", "fn")
    s = cases.groupBy(by).agg(F.avg("expected_confidence").alias("mean_confidence"), F.coalesce(F.stddev_samp("expected_confidence"), F.lit(0.0)).alias("std_confidence"))
    return c.join(s, by)


def split_summary(manifest: DataFrame, cases: DataFrame, baseline: str, tuned: str) -> DataFrame:
    """Sizes of each split, both profiles' rates and objectives, and the profile that the split dev recommends."""
    z = manifest.groupBy("split").agg(F.count("*").alias("total_cases"), F.count_if("expected_fault_present").alias("positives"), F.count_if(~F.col("expected_fault_present")).alias("negatives"), F.countDistinct("signature_id").alias("signatures"), F.countDistinct("family").alias("families"), F.count_if(F.col("noise_tier") == "high").alias("high_noise_cases"))
    m = outcome_rates(cases, "profile", "split")
    of = lambda p, c: F.max(F.when(F.col("profile") == p, F.col(c)))
    wide = m.groupBy("split").agg(*(of(p, c).alias(f"{n}_{c}") for c in ("accuracy", "precision", "recall") for n, p in (("baseline", baseline), ("tuned", tuned))), of(baseline, "objective").alias("objective_baseline"), of(tuned, "objective").alias("objective_tuned"))
    better = F.max(F.when(F.col("split") == "dev", F.when(F.col("objective_tuned") >= F.col("objective_baseline"), "tuned").otherwise("baseline"))).over(Window.partitionBy(F.lit(1)))  # a row for each split
    return z.join(wide.withColumn("recommended_profile", better), "split")


#: Metrics whose intervals are compared, in this order.
WEAK = ["balanced_accuracy", "precision", "recall"]


def overfit_diagnostics(cases: DataFrame, baseline: str, tuned: str) -> DataFrame:
    """(diagnostic, baseline, tuned, delta) of the checks that fire, of case rows by profile and split; one row
    no_material_overfit_signals if none does. All checks are filters over counts by split, tier and top groups; the last
    compares bootstrapped intervals of the locked split."""
    m = outcome_rates(cases, "profile", "split").where("split IN ('dev', 'test')")
    of = lambda p, s, c: F.max(F.when((F.col("profile") == p) & (F.col("split") == s), F.col(c)))
    one = m.agg(*(of(p, s, c).alias(f"{n}_{s}_{c}") for n, p in (("b", baseline), ("t", tuned)) for s in ("dev", "test") for c in ("balanced_accuracy", "recall", "precision", "fp", "fn")))
    wrong = cases.where((F.col("profile") == tuned) & (F.col("split") == "test"))
    share = lambda rows, key, name: rows.groupBy(key).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias(name))
    tiers = outcome_rates(cases.where(F.col("profile") == tuned), "noise_tier").agg(F.max(F.when(F.col("noise_tier") == "normal", F.col("balanced_accuracy"))).alias("normal"), F.max(F.when(F.col("noise_tier") == "high", F.col("balanced_accuracy"))).alias("high"))
    # Intervals of the locked split: they overlap and hardly differ, so what was gained may be chance.
    tested = cases.where("split = 'test'").select("profile", F.col("expected_fault_present").alias("positive"), (F.col("expected_fault_present") == F.col("is_correct")).alias("predicted"), F.lit(False).alias("conflict"))
    ci = bootstrap(tested, "profile").where(F.col("metric").isin(WEAK))
    side = lambda p, n: ci.where(F.col("profile") == p).select("metric", *(F.col(c).alias(f"{n}_{c}") for c in ("estimate", "ci_low", "ci_high")))
    order = F.array_position(F.array(*map(F.lit, WEAK)), F.col("metric"))
    over = side(baseline, "b").join(side(tuned, "t"), "metric").where("least(b_ci_high, t_ci_high) > greatest(b_ci_low, t_ci_low) AND abs(t_estimate - b_estimate) < 0.02")
    weak = over.agg(F.min(F.struct(order.alias("o"), F.col("b_estimate").alias("b"), F.col("t_estimate").alias("t"))).alias("weak"))
    parts = [one, share(wrong.where("is_false_positive"), "predicted_primary", "fp_share"), share(wrong.where("is_false_negative"), "test_id", "fn_share"), tiers, weak]
    row = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        row = row.join(p.withColumn("one", F.lit(1)), "one")  # single rows
    checks = [
        ("dev_improvement_not_transferred", "t_dev_balanced_accuracy > b_dev_balanced_accuracy AND t_test_balanced_accuracy < b_test_balanced_accuracy", "b_test_balanced_accuracy", "t_test_balanced_accuracy"),
        ("recall_gain_with_precision_collapse", "t_test_recall >= b_test_recall AND t_test_precision + 0.03 < b_test_precision", "b_test_precision", "t_test_precision"),
        ("single_analyzer_dominates_false_positives", "fp_share >= 0.30", "b_test_fp", "t_test_fp"), ("single_test_dominates_false_negatives", "fn_share >= 0.20", "b_test_fn", "t_test_fn"),
        ("high_noise_underperforms_normal_noise", "normal - high >= 0.05", "normal", "high"), ("confidence_interval_overlap_weak_improvement", "weak IS NOT NULL", "weak.b", "weak.t"),
    ]
    rows = ", ".join(f"CASE WHEN {cond} THEN named_struct('diagnostic', '{name}', 'baseline', double({a}), 'tuned', double({b})) END" for name, cond, a, b in checks)
    fired = row.select(F.expr(f"filter(array({rows}), x -> x IS NOT NULL)").alias("f"))
    none = "array(named_struct('diagnostic', 'no_material_overfit_signals', 'baseline', 0D, 'tuned', 0D))"
    return fired.select(F.inline(F.expr(f"if(size(f) > 0, f, {none})"))).withColumn("delta", F.col("tuned") - F.col("baseline"))


def coordinate_descent(manifest: DataFrame, results: DataFrame, start: dict[str, float], thresholds: list[float], min_precision: float, target_recall: float, passes: int = 4) -> tuple[DataFrame, dict[str, float]]:
    """Thresholds tuned one signature at a time by (precision gate, recall gate, recall, precision, specificity + balanced
    accuracy), until a pass changes nothing. Returns all trials and the tuned profile.

    Each coordinate step is one job: a capture's candidates meet all trial thresholds of one signature inside its row, and
    only counts by threshold come back. results(capture_id, signature_id, confidence, raw_matched,
    reference_evidence_score, rank); captures without results are skipped, ties keep the earlier threshold."""
    from ..tables import materialise

    spark = manifest.sparkSession
    entry = F.struct("signature_id", "confidence", F.col("raw_matched").alias("m"), F.col("reference_evidence_score").alias("ref"), "rank")
    cand = results.groupBy("capture_id").agg(F.collect_list(entry).alias("c"))
    rows = materialise(manifest.select("capture_id", F.col("signature_id").alias("expected"), "expected_fault_present").join(cand, "capture_id"))
    profile, trials = dict(start), []

    def measure(signature: str, trial: list[float]) -> list:
        given = "CASE x.signature_id " + "".join(f"WHEN '{s}' THEN {t}D " for s, t in profile.items() if s != signature) + f"WHEN '{signature}' THEN t ELSE 0.5D END"
        best = f"array_max(transform(filter(c, x -> x.m AND x.ref > 0 AND x.confidence >= {given}), x -> struct(least(1D, x.confidence * (0.70D + 0.30D * x.ref) + 0.05D), x.confidence, x.ref, -x.rank, x.signature_id AS s))).s"
        won = rows.select("expected", "expected_fault_present", "c", F.explode(F.array(*(F.lit(float(t)) for t in trial))).alias("t")).select("t", F.col("expected_fault_present").alias("p"), F.expr(f"coalesce({best} = expected, false)").alias("w"))
        found = {r.t: r for r in won.groupBy("t").agg(F.count_if(F.col("p") & F.col("w")).alias("tp"), F.count_if(~F.col("p") & F.col("w")).alias("fp"), F.count_if(~F.col("p") & ~F.col("w")).alias("tn"), F.count_if(F.col("p") & ~F.col("w")).alias("fn")).collect()}
        return [found[float(t)] for t in trial if float(t) in found]

    def score(r) -> tuple:
        over = lambda a, b: a / b if b else 0.0
        precision, recall, specificity = over(r.tp, r.tp + r.fp), over(r.tp, r.tp + r.fn), over(r.tn, r.tn + r.fp)
        return (float(precision >= min_precision), float(recall >= target_recall), recall, precision, specificity + (recall + specificity) / 2)

    for k in range(passes):
        changed = False
        for signature in sorted(profile):
            now = profile[signature]
            measured = measure(signature, list(dict.fromkeys([float(now), *map(float, thresholds)])))
            best, top = now, next((score(r) for r in measured if r.t == now), None)
            for r in (r for t in thresholds for r in measured if r.t == t):
                trials.append((k + 1, signature, r.t, r.tp, r.fp, r.tn, r.fn))
                if top is None or score(r) > top:
                    best, top = r.t, score(r)
            changed |= best != now
            profile[signature] = best
        if not changed:
            break
    return spark.createDataFrame(trials, "pass int, signature_id string, threshold double, tp bigint, fp bigint, tn bigint, fn bigint"), profile
