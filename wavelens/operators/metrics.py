"""Campaign metrics over scores(capture_id, signature_id, confidence, matched, truth) and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .quantiles import quantiles


def ratio(a: Column, b: Column) -> Column:
    """a / b, null over 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def confusion_counts(positive: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn of two boolean columns."""
    return [_count(positive & predicted).alias("tp"), _count(~positive & predicted).alias("fp"), _count(~positive & ~predicted).alias("tn"), _count(positive & ~predicted).alias("fn")]


def signature_summary(scores: DataFrame) -> DataFrame:
    """Counts, confidence statistics and one-vs-rest rates by signature, with partial aggregation; exact quantiles."""
    positive, c = F.col("truth") == F.col("signature_id"), F.col("confidence")
    out = scores.groupBy("signature_id").agg(F.count("*").alias("total_cases"), _count(F.col("matched")).alias("matched_count"), F.avg(c).alias("mean_confidence"), *confusion_counts(positive, F.col("matched")))
    names = ("median_confidence", "p05_confidence", "p95_confidence")
    spread = quantiles(scores, ["signature_id"], "confidence", [0.5, 0.05, 0.95]).select(F.col("signature_id").alias("__s"), *(F.col("q")[i].alias(n) for i, n in enumerate(names)))
    out = out.join(spread, F.col("signature_id").eqNullSafe(F.col("__s")), "left")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rates = [ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(fp, fp + tn).alias("fpr"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, F.col("total_cases")).alias("accuracy")]
    return out.select("signature_id", "total_cases", "matched_count", "mean_confidence", *names, "tp", "fp", "tn", "fn", *rates)


def signature_report(per_case: DataFrame, with_truth: bool = True) -> DataFrame:
    """Signatures over per-case rows (cases.per_case): cases, matches, wins, confidence statistics, mean rank and errors (column
    error_count; absent: 0); with truth the counts and rates of one against the rest (over nothing: null), without it the
    shares of matches and wins."""
    c, errors = F.col("confidence"), F.sum("error_count") if "error_count" in per_case.columns else F.lit(0).cast("bigint")
    won = F.coalesce(F.col("winner") == F.col("signature_id"), F.lit(False))
    out = per_case.groupBy("signature_id").agg(F.count("*").alias("total_cases"), _count(F.col("matched")).alias("matched_count"), _count(won).alias("top1_count"), F.avg(c).alias("mean_confidence"), F.avg("rank").alias("mean_rank"), errors.alias("error_count"), *(_count(F.col(f"is_{x}")).alias(n) for x, n in (("true_positive", "tp"), ("false_positive", "fp"), ("true_negative", "tn"), ("false_negative", "fn"))))
    names = ("median_confidence", "p05_confidence", "p95_confidence")
    spread = quantiles(per_case, ["signature_id"], "confidence", [0.5, 0.05, 0.95]).select(F.col("signature_id").alias("__s"), *(F.col("q")[i].alias(n) for i, n in enumerate(names)))
    out = out.join(spread, F.col("signature_id").eqNullSafe(F.col("__s")), "left")
    base = ["signature_id", "total_cases", "matched_count", "top1_count", "mean_confidence", *names, "mean_rank", "error_count"]
    if not with_truth:
        return out.select(*base, ratio_or_zero(F.col("matched_count"), F.col("total_cases")).alias("match_rate"), ratio_or_zero(F.col("top1_count"), F.col("total_cases")).alias("top1_rate"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return out.select(*base, (tp + fn).alias("truth_cases"), "tp", "fp", "tn", "fn", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(fp, fp + tn).alias("false_positive_rate"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def confusion_matrix(decisions: DataFrame) -> DataFrame:
    """Counts of (truth, predicted); a null winner is predicted none."""
    return decisions.where("truth IS NOT NULL").groupBy("truth", F.coalesce("winner", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))


def overlap_matrix(scores: DataFrame) -> DataFrame:
    """For each pair of signatures, how often both, one or neither match a capture.

    A capture's signatures are gathered once and paired inside the row (as many entries as there are signatures), and only
    pairs of which one matches become rows. What a pair is not seen with follows from the totals of its first signature;
    the pairs themselves are made inside one row of totals, so nothing is joined but counts."""
    entries = F.array_sort(F.collect_list(F.struct("signature_id", F.coalesce("matched", F.lit(False)).alias("m"), F.col("confidence").alias("c"))))
    paired = "flatten(transform(e, (x, i) -> transform(filter(slice(e, i + 2, size(e)), y -> x.m OR y.m), y -> named_struct('a', x.signature_id, 'b', y.signature_id, 'xm', x.m, 'ym', y.m, 'xc', x.c, 'yc', y.c))))"
    pairs = scores.groupBy("capture_id").agg(entries.alias("e")).select(F.inline(F.expr(paired)))
    both = F.col("xm") & F.col("ym")
    seen = pairs.groupBy("a", "b").agg(_count(both).alias("both"), _count(~F.col("xm") & F.col("ym")).alias("b_only"), F.avg(F.when(both, F.col("xc"))).alias("ca"), F.avg(F.when(both, F.col("yc"))).alias("cb"))
    totals = scores.groupBy("signature_id").agg(F.count("*").alias("n"), _count(F.col("matched")).alias("m"))
    grid = totals.agg(F.array_sort(F.collect_list(F.struct("signature_id", "n", "m"))).alias("e")).select(F.inline(F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> named_struct('a', x.signature_id, 'b', y.signature_id, 'n', x.n, 'm', x.m))))")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = grid.join(seen, ["a", "b"], "left").withColumn("both", zero("both")).withColumn("b_only", zero("b_only")).withColumn("a_only", F.col("m") - F.col("both"))
    out = out.withColumn("neither", F.col("n") - F.col("both") - F.col("a_only") - F.col("b_only"))
    union = F.col("both") + F.col("a_only") + F.col("b_only")
    return out.select(
        F.col("a").alias("signature_a"), F.col("b").alias("signature_b"), F.col("n").alias("total_cases"), F.col("both").alias("both_matched"), "a_only", "b_only", "neither", F.col("ca").alias("mean_confidence_a_when_both"), F.col("cb").alias("mean_confidence_b_when_both"),
        ratio(F.col("both"), F.col("n")).alias("overlap_rate"), ratio(F.col("both"), union).alias("jaccard_overlap"),
    )


def feature_stats(long: DataFrame) -> DataFrame:
    """Distribution of each feature by signature, of long(signature_id, feature, value); population deviation, exact quantiles."""
    v, by = F.col("value"), ["signature_id", "feature"]
    rows = long.where("value IS NOT NULL AND NOT isnan(value)")
    out = rows.groupBy(*by).agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(rows, by, "value", [0.05, 0.25, 0.5, 0.75, 0.95]).select(*(F.col(c).alias(f"__{c}") for c in by), "q")
    out = out.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return out.select(*by, "count", "mean", "std", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))), "max")


def threshold_sweep(scores: DataFrame, thresholds: list[float], min_tpr: float = 0.9, max_fpr: float = 0.05) -> DataFrame:
    """One-vs-rest counts and rates of each signature at each threshold.

    Scores are first counted by (signature, truth, number of thresholds reached); thresholds then meet these few rows
    only, so the input is aggregated once and not multiplied."""
    cuts = sorted(thresholds)
    reached = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    small = scores.groupBy("signature_id", F.coalesce(F.col("truth") == F.col("signature_id"), F.lit(False)).alias("is"), reached.alias("reached")).agg(F.count("*").alias("n"))
    grid = small.select("*", F.posexplode(F.array(*(F.lit(t) for t in cuts))).alias("i", "threshold")).withColumn("hit", F.col("reached") > F.col("i"))
    add = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = grid.groupBy("signature_id", "threshold").agg(add(F.col("is") & F.col("hit")).alias("tp"), add(~F.col("is") & F.col("hit")).alias("fp"), add(~F.col("is") & ~F.col("hit")).alias("tn"), add(F.col("is") & ~F.col("hit")).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = out.select("*", (tp + fp + tn + fn).alias("total_cases"), (tp + fn).alias("truth_cases"), ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr"))
    return out.select("*", f1.alias("f1"), (F.col("tpr") - F.col("fpr")).alias("youden_j"), F.coalesce((F.col("tpr") >= min_tpr) & (F.col("fpr") <= max_fpr), F.lit(False)).alias("deployable"))


def deployable_thresholds(sweep: DataFrame) -> DataFrame:
    """For each signature the highest deployable threshold, ties by Youden's J and F1."""
    rank = F.expr("row_number() OVER (PARTITION BY signature_id ORDER BY threshold DESC, youden_j DESC NULLS LAST, f1 DESC NULLS LAST)")
    return sweep.where("deployable").withColumn("r", rank).where("r = 1").drop("r")


def capture_metrics(cases: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Precision, recall, specificity and accuracy of cases(positive, predicted, ...) over grouping sets in one pass."""
    names = sorted({c for s in sets for c in s})
    out = cases.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count("*").alias("total"), *confusion_counts(F.col("positive"), F.col("predicted")))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = out.select("*", ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), ratio_or_zero(tn, tn + fp).alias("specificity"), ratio_or_zero(tp + tn, F.col("total")).alias("accuracy"))
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def stratified_split(manifest: DataFrame, strata: list[str], id_column: str, shares: dict[str, float], seed: int = 610) -> DataFrame:
    """manifest with a column split: largest-remainder allocation within each stratum, members in hash order.

    The order is a hash of the seed and id, so it does not depend on partitioning; a stratum is spread over tasks (ranks.py)."""
    out = ranks.numbered(manifest.withColumn("__h", F.xxhash64(F.lit(seed), id_column)), strata, ["__h", id_column]).drop("__h")
    return out.withColumn("split", F.expr(allocation_sql("__r", "__n", shares))).drop("__r", "__n")


def allocation_sql(rank: str, n: str, shares: dict[str, float]) -> str:
    """SQL: the split of the rank-th of n rows. Remainders go to the splits of the largest fractions, ties in order."""
    names, total = list(shares), sum(shares.values())
    floor = {s: f"cast(floor({n} * {shares[s] / total:.17g}e0 + 1e-9) AS int)" for s in names}
    part = {s: f"({n} * {shares[s] / total:.17g}e0 - {floor[s]})" for s in names}
    left = f"({n} - ({' + '.join(floor.values())}))"
    size = {}
    for i, s in enumerate(names):
        above = " + ".join(f"CASE WHEN {part[t]} > {part[s]} + 1e-9 OR (abs({part[t]} - {part[s]}) <= 1e-9 AND {j} < {i}) THEN 1 ELSE 0 END" for j, t in enumerate(names) if t != s)
        size[s] = f"({floor[s]} + CASE WHEN {above} < {left} THEN 1 ELSE 0 END)"
    out, upto = "CASE", ""
    for s in names[:-1]:
        upto = f"{upto} + {size[s]}" if upto else size[s]
        out += f" WHEN {rank} <= {upto} THEN '{s}'"
    return f"{out} ELSE '{names[-1]}' END"
