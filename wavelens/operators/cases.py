"""Cases: a manifest's captures with the results of all signatures, candidates in order, and each case's decision.

manifest(capture_id, signature_id, family, truth_label, expected_fault_present, noise_tier, split, waveform_intent,
test_id); results(capture_id, signature_id, confidence, raw_matched, reference_evidence_score, required_reference_status,
rank, ...). One shuffle on capture_id carries both: candidates of a capture are ranked by a window and the decision is an
aggregate of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence scores of a best, a matched and a weak reference; closeness of confidences in conflict.
EVIDENCE = (1.0, 0.8, 0.25, 0.0)
CLOSE = 0.10


def with_references(references: DataFrame) -> DataFrame:
    """Results of references(capture_id, signature_id, reference_label, confidence, matched): a row for each capture and
    signature with reference_results (array), matched, confidence, best_reference (of the matched ones the most
    confident, ties by label; null if none matches) and reference_count."""
    entry = F.struct((-F.col("confidence")).alias("c"), "reference_label", F.col("matched").alias("m"))
    best = F.min(F.when(F.col("matched"), entry))
    out = references.groupBy("capture_id", "signature_id").agg(
        F.array_sort(F.collect_list(F.struct("reference_label", "confidence", "matched"))).alias("reference_results"), F.max("matched").alias("matched"), F.max("confidence").alias("confidence"), best.alias("b"), F.count("*").alias("reference_count")
    )
    return out.select("capture_id", "signature_id", "reference_results", "matched", "confidence", F.col("b.reference_label").alias("best_reference"), "reference_count")


def reference_evidence(best: str = "best_reference", references: str = "reference_results") -> tuple[Column, Column]:
    """Score and status of a result's reference evidence: a best reference, a matched one, a weak one, or none."""
    has, matched, some = F.col(best).isNotNull() & (F.col(best) != ""), F.exists(references, lambda r: r.matched), F.size(references) > 0
    ladder = lambda a, b, c, d: F.when(has, a).when(F.coalesce(matched, F.lit(False)), b).when(some, c).otherwise(d)
    score = ladder(*(F.lit(x) for x in EVIDENCE))
    return score, ladder("best_reference_available", "matched_reference_available", "reference_present_but_weak", "missing_or_not_reported")


def per_case(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each capture and signature with rank, winner and outcome flags. results(capture_id, signature_id, matched,
    confidence, best_reference, reference_count); decisions(capture_id, truth, winner). Flags are null without a truth."""
    w = Window.partitionBy("capture_id").orderBy(F.desc("matched"), F.desc("confidence"), "signature_id")
    rows = results.withColumn("rank", F.row_number().over(w)).join(decisions, "capture_id")
    truth, hit = F.col("signature_id") == F.col("truth"), F.col("matched")
    flag = lambda c: F.when(F.col("truth").isNotNull() & (F.col("truth") != ""), c)
    return rows.select(
        "capture_id", F.coalesce("truth", F.lit("")).alias("truth_label"), "signature_id", "matched", "confidence", "rank", F.coalesce("winner", F.lit("")).alias("winner"), F.when(F.col("winner").isNull(), "no_match").otherwise("matched").alias("decision"),
        F.coalesce(F.col("signature_id") == F.col("winner"), F.lit(False)).alias("is_winner"), F.coalesce("best_reference", F.lit("")).alias("best_reference"), "reference_count",
        flag(truth).alias("is_truth_signature"), flag(hit & truth).alias("is_true_positive"), flag(hit & ~truth).alias("is_false_positive"), flag(~hit & ~truth).alias("is_true_negative"), flag(~hit & truth).alias("is_false_negative"),
    )


def per_reference(results: DataFrame) -> DataFrame:
    """A row for each reference of each result: reference_matched, reference_confidence, is_best_reference."""
    return results.select("capture_id", "signature_id", F.col("matched").alias("signature_matched"), F.col("confidence").alias("signature_confidence"), "best_reference", F.explode("reference_results").alias("r")).select(
        "capture_id", "signature_id", F.col("r.reference_label").alias("reference_label"), "signature_matched", F.col("r.matched").alias("reference_matched"), "signature_confidence", F.col("r.confidence").alias("reference_confidence"),
        F.coalesce(F.col("r.reference_label") == F.col("best_reference"), F.lit(False)).alias("is_best_reference"),
    )


def reference_summary(references: DataFrame) -> DataFrame:
    """Match and best counts, rates and confidences by signature and reference, of per_reference rows."""
    from .quantiles import quantiles

    by = ["signature_id", "reference_label"]
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = references.groupBy(*by).agg(
        F.count("*").alias("total_cases"), F.count_if("reference_matched").alias("reference_matched_count"), rate("reference_matched").alias("reference_match_rate"),
        F.count_if("is_best_reference").alias("best_reference_count"), rate("is_best_reference").alias("best_reference_rate"), F.avg("reference_confidence").alias("mean_reference_confidence"),
    )
    middle = quantiles(references, by, "reference_confidence", [0.5]).select(*by, F.col("q")[0].alias("median_reference_confidence"))
    return out.join(middle, by, "left")


def threshold_column(profile: dict[str, float], default: float = 0.5, column: str = "signature_id") -> Column:
    out = F.lit(float(default))
    for signature, t in profile.items():
        out = F.when(F.col(column) == signature, F.lit(float(t))).otherwise(out)
    return out


def merge_splits(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """manifest with the columns split and split_purpose of splits where these are neither null nor empty. Of splits rows
    that repeat a capture the first counts, by column `ordinal`. A capture in neither has split 'overall'."""
    w = Window.partitionBy("capture_id").orderBy("ordinal")
    one = splits.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("capture_id", F.col("split").alias("__split"), F.col("split_purpose").alias("__purpose"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return manifest.join(one, "capture_id", "left").withColumn("split", F.coalesce(given("__split"), "split", F.lit("overall"))).withColumn("split_purpose", F.coalesce(given("__purpose"), "split_purpose", F.lit(""))).drop("__split", "__purpose")


def diagnosed(results: DataFrame, profile: dict[str, float], default: float = 0.5) -> DataFrame:
    """Results with diagnostic score and rank, role, the primary diagnosis, secondary candidates and warnings.

    results(capture_id, signature_id, matched, confidence, best_reference, reference_results). Ranking: score, confidence,
    evidence, signature."""
    score, status = reference_evidence()
    case = Window.partitionBy("capture_id")
    order = [F.desc("diagnostic_score"), F.desc("confidence"), F.desc("reference_evidence_score"), "signature_id"]
    d = results.select("*", score.alias("reference_evidence_score"), status.alias("required_reference_status"), threshold_column(profile, default).alias("threshold"))
    d = d.withColumn("threshold_pass", F.col("matched") & (F.col("confidence") >= F.col("threshold")))
    d = d.withColumn("diagnostic_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * (0.70 + 0.30 * F.col("reference_evidence_score")) + F.when(F.col("threshold_pass"), 0.05).otherwise(0.0))))
    d = d.withColumn("diagnostic_rank", F.row_number().over(case.orderBy(*order))).withColumn("strong", F.col("threshold_pass") & (F.col("reference_evidence_score") > 0))
    found = F.array_sort(F.collect_list(F.when(F.col("strong"), F.struct(F.col("diagnostic_rank").alias("r"), F.col("signature_id").alias("s"), F.col("confidence").alias("c")))).over(case))
    d = d.withColumn("found", found).withColumn("multi_match_count", F.size("found"))
    d = d.withColumn("primary_diagnosis", F.when(F.col("multi_match_count") > 0, F.col("found")[0].s).otherwise(""))
    primary = F.col("strong") & (F.col("signature_id") == F.col("primary_diagnosis"))
    names = lambda xs: F.array_join(F.transform(xs, lambda x: x.s), ", ")
    near = F.expr(f"filter(found, x -> found[0].c - x.c <= {CLOSE} AND array_max(transform(found, y -> y.c)) - x.c <= {CLOSE})")
    conflict = F.when(F.col("multi_match_count") < 2, "").when(F.size(near) >= 2, F.concat(F.lit("multiple_high_confidence_signatures_match: "), names(near))).otherwise(F.concat(F.lit("multiple_signatures_match_above_threshold: "), names(F.col("found"))))
    d = d.withColumn("conflict_warning", conflict)
    warnings = F.array_join(F.filter(F.array(F.when(F.col("threshold_pass"), F.col("conflict_warning")), F.when(F.col("threshold_pass") & (F.col("reference_evidence_score") <= 0), F.lit("required_reference_evidence_missing_or_weak"))), lambda x: x != ""), " | ")
    return d.select(
        "capture_id", "signature_id", "confidence", "threshold", "threshold_pass", "reference_evidence_score", "required_reference_status", "diagnostic_score", "diagnostic_rank",
        F.when(primary, "primary_diagnosis").when(F.col("threshold_pass"), "secondary_candidate").otherwise("rejected_or_below_threshold").alias("candidate_role"), "primary_diagnosis",
        F.array_join(F.transform(F.filter("found", lambda x: x.s != F.col("primary_diagnosis")), lambda x: x.s), ",").alias("secondary_candidates"), "multi_match_count", (F.col("multi_match_count") >= 2).alias("multi_match_ambiguity"), "conflict_warning", warnings.alias("warnings"),
    )


def first_seen_rank(results: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """results with rank by confidence, of equal ones the first seen."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("confidence"), ordinal)))


def case_rows(manifest: DataFrame, results: DataFrame, profile: dict[str, float], default: float = 0.5, forced: bool = True) -> DataFrame:
    """A row for each case of the manifest: candidates in order, the primary one, decision state and outcome flags.

    results(capture_id, signature_id, confidence, raw_matched, reference_evidence_score, rank). Candidates are ordered by
    threshold_pass, diagnostic score, confidence, evidence (all descending) and rank. The primary one is the first that
    passes; if none does, with forced, the first by confidence, evidence and rank, else none. Cases without results stay."""
    r = results.select("capture_id", F.col("signature_id").alias("candidate"), "confidence", "raw_matched", F.col("reference_evidence_score").alias("ref"), "rank")
    r = r.withColumn("threshold", threshold_column(profile, default, "candidate")).withColumn("reached", F.col("raw_matched") & (F.col("confidence") >= F.col("threshold")))
    r = r.withColumn("diag", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * (0.70 + 0.30 * F.col("ref")) + F.when(F.col("reached"), 0.05).otherwise(0.0)))).withColumn("pass", F.col("reached") & (F.col("ref") > 0))
    entry = F.struct((~F.col("pass")).alias("fails"), (-F.col("diag")).alias("d"), (-F.col("confidence")).alias("c"), (-F.col("ref")).alias("e"), "rank", F.col("candidate").alias("s"), F.col("threshold").alias("t"))
    weak = F.struct((-F.col("confidence")).alias("c"), (-F.col("ref")).alias("e"), "rank", F.col("candidate").alias("s"))
    per = r.groupBy("capture_id").agg(F.array_sort(F.collect_list(entry)).alias("cands"), F.min(weak).alias("weak"), F.count_if("pass").alias("passing"))
    d = manifest.join(per, "capture_id", "left").withColumn("passing", F.coalesce("passing", F.lit(0)))
    d = d.withColumn("primary", F.when(F.col("passing") > 0, F.col("cands")[0].s).otherwise(F.col("weak.s") if forced else F.lit(None)))
    own = F.coalesce(F.expr("try_element_at(filter(cands, x -> x.s = signature_id), 1).c"), F.lit(0.0))
    won, some, positive = F.coalesce(F.col("primary") == F.col("signature_id"), F.lit(False)), F.col("primary").isNotNull(), F.col("expected_fault_present")
    state = F.when(positive, F.when(won, "positive_expected_won_primary").when(some, "positive_expected_lost_primary").otherwise("positive_expected_no_match")).otherwise(F.when(won, "negative_false_positive").when(some, "negative_avoided_primary").otherwise("negative_no_match"))
    ambiguous = F.col("passing") >= 2
    return d.select(
        "capture_id", F.col("signature_id").alias("analyzer_id"), "family", "truth_label", "expected_fault_present", "split", "noise_tier", "waveform_intent", "test_id",
        F.coalesce("primary", F.lit("")).alias("predicted_primary"), (-own).alias("expected_confidence"), F.col("passing").alias("multi_match_count"), F.concat(state, F.when(some & ambiguous, "_ambiguous").otherwise("")).alias("conflict_state"),
        F.array_join(F.transform(F.slice(F.coalesce("cands", F.array()), 1, 3), lambda x: F.concat(x.s, F.lit("@"), F.format_number(-x.c, 2))), " | ").alias("top_3"),
        (positive == won).alias("is_correct"), (~positive & won).alias("is_false_positive"), (positive & ~won).alias("is_false_negative"), (positive & some & ~won).alias("primary_stolen"), ambiguous.alias("ambiguous"),
    )
