"""Queries over cases: references, diagnoses, decisions, power and tuning reports, and the event layer, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BASELINE, BOTH, ORACLE_SQL, TUNED, query, r
from .functions.features import pair_features
from .operators import cases, events, evidence, joins, metrics, power, timing, tuning
from .plans import rules, views
from .plans.views import MANIFEST, REFERENCES, SAMPLES

PROFILE = {"A": 0.5, "N": 0.55, "R": 0.6}
T = "CASE {} " + " ".join(f"WHEN '{s}' THEN {t}" for s, t in PROFILE.items()) + " ELSE 0.5 END"

RESULTS = f"""{REFERENCES}, best AS (SELECT capture_id, signature_id, bool_or(matched) AS matched, max(confidence) AS confidence, count(*) AS reference_count, list(struct_pack(reference_label := reference_label, confidence := confidence, matched := matched)) AS refs FROM refs0 GROUP BY ALL),
    bl AS (SELECT capture_id, signature_id, reference_label AS best_reference FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, signature_id ORDER BY confidence DESC, reference_label) AS k FROM refs0 WHERE matched) WHERE k = 1),
    results AS (SELECT *, CASE WHEN best_reference IS NOT NULL THEN 1.0 WHEN reference_count > 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS ref FROM best LEFT JOIN bl USING (capture_id, signature_id))"""
SCORED = f"""scored AS (SELECT *, matched AND confidence >= t AS pass0, least(1, greatest(0, confidence * (0.70 + 0.30 * ref) + CASE WHEN matched AND confidence >= t THEN 0.05 ELSE 0 END)) AS diag FROM (SELECT *, {T.format('signature_id')}::DOUBLE AS t FROM results)),
    ranked AS (SELECT *, pass0 AND ref > 0 AS pass, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, signature_id) AS rank FROM scored)"""
CASES = f"""{RESULTS}, {SCORED}, {MANIFEST}, ordered AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pass DESC, diag DESC, confidence DESC, ref DESC, rank) AS k, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, ref DESC, rank) AS weak FROM ranked),
    per AS (SELECT capture_id, count(*) FILTER (pass) AS passing, max(CASE WHEN k = 1 AND pass THEN signature_id END) AS strong, max(CASE WHEN weak = 1 THEN signature_id END) AS forced, string_agg(signature_id || '@' || printf('%.2f', confidence), ' | ' ORDER BY k) FILTER (k <= 3) AS top_3 FROM ordered GROUP BY 1),
    c0 AS (SELECT m.*, coalesce(p.passing, 0) AS passing, coalesce(p.strong, p.forced) AS prim, p.top_3, coalesce(o.confidence, 0) AS expected_confidence FROM manifest m LEFT JOIN per p USING (capture_id) LEFT JOIN ranked o ON o.capture_id = m.capture_id AND o.signature_id = m.signature_id),
    c1 AS (SELECT *, coalesce(prim = signature_id, false) AS won, prim IS NOT NULL AS has, expected_fault_present AS pos FROM c0),
    cases AS (SELECT *, signature_id AS analyzer_id, CASE WHEN pos THEN CASE WHEN won THEN 'positive_expected_won_primary' WHEN has THEN 'positive_expected_lost_primary' ELSE 'positive_expected_no_match' END ELSE CASE WHEN won THEN 'negative_false_positive' WHEN has THEN 'negative_avoided_primary' ELSE 'negative_no_match' END END
        || CASE WHEN has AND passing >= 2 THEN '_ambiguous' ELSE '' END AS conflict_state, pos = won AS is_correct, NOT pos AND won AS is_false_positive, pos AND NOT won AS is_false_negative, pos AND has AND NOT won AS primary_stolen, passing >= 2 AS ambiguous,
        CASE WHEN passing > 0 THEN 'passed' ELSE 'weak' END AS reference_status, signature_id || ':' || family AS target_rule FROM c1)"""
CONFLICT = "(ambiguous OR primary_stolen OR is_false_positive OR is_false_negative)"


def results(spark, sf_dir) -> DataFrame:
    """Lines as references of an order's (capture's) return flags (signatures)."""
    return cases.with_references(views.references(spark, sf_dir))


def candidates(spark, sf_dir) -> DataFrame:
    score, status = cases.reference_evidence()
    r0 = results(spark, sf_dir).select("capture_id", "signature_id", "confidence", F.col("matched").alias("raw_matched"), score.alias("reference_evidence_score"), status.alias("required_reference_status"))
    return cases.first_seen_rank(r0, "signature_id")


def case_table(spark, sf_dir) -> DataFrame:
    rows = cases.case_rows(views.manifest(spark, sf_dir), candidates(spark, sf_dir), PROFILE)
    return rows.withColumn("reference_status", F.when(F.col("multi_match_count") > 0, "passed").otherwise("weak")).withColumn("target_rule", F.concat_ws(":", "analyzer_id", "family"))


@query(f"WITH {RESULTS}, w AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY matched DESC, confidence DESC, signature_id)::INT AS rank FROM results), d AS (SELECT capture_id, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' END AS truth FROM (SELECT o_orderkey AS capture_id, o_orderstatus FROM orders)), v AS (SELECT capture_id, max(CASE WHEN rank = 1 AND matched THEN signature_id END) AS winner FROM w GROUP BY 1)"
    " SELECT w.capture_id, coalesce(truth, '') AS truth_label, signature_id, matched, round(confidence, 6) AS confidence, rank, coalesce(winner, '') AS winner, CASE WHEN winner IS NULL THEN 'no_match' ELSE 'matched' END AS decision, coalesce(signature_id = winner, false) AS is_winner, coalesce(best_reference, '') AS best_reference, reference_count,"
    " signature_id = truth AS is_truth_signature, CASE WHEN truth IS NOT NULL THEN matched AND signature_id = truth END AS is_true_positive, CASE WHEN truth IS NOT NULL THEN matched AND signature_id <> truth END AS is_false_positive, CASE WHEN truth IS NOT NULL THEN NOT matched AND signature_id <> truth END AS is_true_negative, CASE WHEN truth IS NOT NULL THEN NOT matched AND signature_id = truth END AS is_false_negative"
    " FROM w JOIN d USING (capture_id) JOIN v USING (capture_id)")
def q50_per_case(spark, sf_dir):
    found = results(spark, sf_dir)
    best = found.groupBy("capture_id").agg(F.min(F.when(F.col("matched"), F.struct((-F.col("confidence")).alias("c"), "signature_id"))).alias("b")).select("capture_id", F.col("b.signature_id").alias("winner"))
    truth = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N")
    decided = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("capture_id"), truth.alias("truth")).join(best, "capture_id")
    return cases.per_case(found, decided)


@query(f"WITH {RESULTS} SELECT capture_id, signature_id, x.reference_label AS reference_label, matched AS signature_matched, x.matched AS reference_matched, round(confidence, 6) AS signature_confidence, round(x.confidence, 6) AS reference_confidence, coalesce(x.reference_label = best_reference, false) AS is_best_reference FROM (SELECT *, unnest(refs) AS x FROM results)")
def q51_per_reference(spark, sf_dir):
    """Each reference of each result: nested results are exploded."""
    return cases.per_reference(results(spark, sf_dir))


@query(f"""WITH {RESULTS}, p AS (SELECT signature_id, x.reference_label AS reference_label, x.matched AS m, x.confidence AS c, coalesce(x.reference_label = best_reference, false) AS b FROM (SELECT *, unnest(refs) AS x FROM results))
    SELECT signature_id, reference_label, count(*) AS total_cases, count(*) FILTER (m) AS reference_matched_count, {r('avg(m::INT) AS reference_match_rate')}, count(*) FILTER (b) AS best_reference_count, {r('avg(b::INT) AS best_reference_rate', 'avg(c) AS mean_reference_confidence', 'median(c) AS median_reference_confidence')} FROM p GROUP BY ALL""")
def q52_reference_summary(spark, sf_dir):
    return cases.reference_summary(cases.per_reference(results(spark, sf_dir)))


@query(f"""WITH {RESULTS}, {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY diag DESC, confidence DESC, ref DESC, signature_id)::INT AS dr FROM ranked),
    f AS (SELECT capture_id, count(*)::INT AS n, first(signature_id ORDER BY dr) AS prim, string_agg(signature_id, ', ' ORDER BY dr) AS names, max(confidence) AS top FROM k WHERE pass GROUP BY 1),
    g AS (SELECT k.capture_id, string_agg(signature_id, ', ' ORDER BY dr) AS near, count(*) AS nn FROM k JOIN f USING (capture_id) WHERE pass AND top - confidence <= 0.10 GROUP BY 1),
    h AS (SELECT k.*, coalesce(n, 0) AS n, coalesce(prim, '') AS prim, CASE WHEN coalesce(n, 0) < 2 THEN '' WHEN nn >= 2 THEN 'multiple_high_confidence_signatures_match: ' || near ELSE 'multiple_signatures_match_above_threshold: ' || names END AS conflict_warning FROM k LEFT JOIN f USING (capture_id) LEFT JOIN g USING (capture_id)),
    s AS (SELECT h.capture_id, string_agg(signature_id, ',' ORDER BY dr) FILTER (pass AND signature_id <> prim) AS sec FROM h GROUP BY 1)
    SELECT capture_id, signature_id, {r('confidence', 't AS threshold')}, pass0 AS threshold_pass, ref AS reference_evidence_score, CASE WHEN best_reference IS NOT NULL THEN 'best_reference_available' WHEN reference_count > 0 THEN 'reference_present_but_weak' ELSE 'missing_or_not_reported' END AS required_reference_status, round(diag, 6) AS diagnostic_score, dr AS diagnostic_rank,
    CASE WHEN pass AND signature_id = prim THEN 'primary_diagnosis' WHEN pass0 THEN 'secondary_candidate' ELSE 'rejected_or_below_threshold' END AS candidate_role, prim AS primary_diagnosis, coalesce(sec, '') AS secondary_candidates, n AS multi_match_count, n >= 2 AS multi_match_ambiguity, conflict_warning, CASE WHEN pass0 THEN conflict_warning ELSE '' END AS warnings FROM h JOIN s USING (capture_id)""")
def q53_diagnoses(spark, sf_dir):
    """Diagnostic roles and warnings; evidence comes from the references."""
    return cases.diagnosed(results(spark, sf_dir), PROFILE)


@query(f"WITH {CASES} SELECT capture_id, analyzer_id, family, truth_label, expected_fault_present, split, noise_tier, waveform_intent, test_id, coalesce(prim, '') AS predicted_primary, round(expected_confidence, 6) AS expected_confidence, passing AS multi_match_count, conflict_state, coalesce(top_3, '') AS top_3, is_correct, is_false_positive, is_false_negative, primary_stolen, ambiguous FROM cases")
def q54_case_rows(spark, sf_dir):
    """Every order of the manifest with its ordered candidates and decision state; orders without lines stay."""
    return case_table(spark, sf_dir).drop("reference_status", "target_rule")


BUCKET_LIST = "[struct_pack(t := 'overall', v := 'all'), " + ", ".join(f"struct_pack(t := '{b}', v := {b}::VARCHAR)" for b in power.BUCKETS) + "]"
Z = power.Z
DISTRIBUTION = f"""{CASES}, x AS (SELECT *, unnest({BUCKET_LIST}) AS b, concat_ws('|', split, noise_tier, waveform_intent, conflict_state) AS wk, concat_ws('|', test_id, noise_tier, waveform_intent, conflict_state) AS fk FROM cases),
    wb AS (SELECT analyzer_id, t, v, min(s) AS worst FROM (SELECT analyzer_id, b.t AS t, b.v AS v, wk, avg(is_correct::INT) AS s FROM x GROUP BY ALL) GROUP BY ALL), fb AS (SELECT analyzer_id, t, v, max(n) AS top_fp FROM (SELECT analyzer_id, b.t AS t, b.v AS v, fk, count(*) FILTER (is_false_positive) AS n FROM x GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT analyzer_id, b.t AS t, b.v AS v, count(*) AS n, count(*) FILTER (is_correct) AS s, count(*) FILTER (pos AND is_correct) AS tp, count(*) FILTER (pos AND NOT is_correct) AS fn, count(*) FILTER (NOT pos AND NOT is_correct) AS fp, count(*) FILTER (NOT pos AND is_correct) AS tn, count(*) FILTER (conflict_state NOT IN ('negative_avoided_primary', 'negative_no_match')) AS states,
        count(*) FILTER (primary_stolen) AS stolen, count(*) FILTER ({CONFLICT}) AS cn, count(*) FILTER ({CONFLICT} AND is_correct) AS cw, avg(is_correct::INT) FILTER (noise_tier = 'high') AS hi, avg(is_correct::INT) FILTER (noise_tier = 'normal') AS no, count(*) FILTER (is_false_positive) AS fps FROM x GROUP BY ALL),
    m AS (SELECT g.analyzer_id, g.t AS bucket_type, g.v AS bucket_value, n AS n_cases, s AS successes, (s + 1.0::DOUBLE) / (n + 2) AS posterior_mean, sqrt((s + 1.0::DOUBLE) * (n - s + 1) / (pow(n + 2, 2) * (n + 3))) AS sd, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(fp / nullif(fp + tn, 0), 0) AS false_positive_rate,
        coalesce(fn / nullif(fn + tp, 0), 0) AS false_negative_rate, states / n AS conflict_rate, stolen / n AS primary_stolen_rate, coalesce(hi, 0) AS high_noise_success, coalesce(no, 0) AS normal_noise_success, worst AS worst_bucket_success, coalesce(top_fp / nullif(fps, 0), 0) AS fp_concentration_share, CASE WHEN cn > 0 THEN cw / cn ELSE 1 END AS conflict_resistance, cn AS conflicts
        FROM g JOIN wb ON wb.analyzer_id = g.analyzer_id AND wb.t = g.t AND wb.v = g.v JOIN fb ON fb.analyzer_id = g.analyzer_id AND fb.t = g.t AND fb.v = g.v),
    m2 AS (SELECT *, greatest(0, posterior_mean - {Z} * sd) AS credible_low, least(1, posterior_mean + {Z} * sd) AS credible_high, high_noise_success - normal_noise_success AS high_noise_delta FROM m),
    dist AS (SELECT *, 0.25 * posterior_mean + 0.05 * conflict_resistance + shared AS power_score, 0.25 * credible_low + 0.05 * (1 - conflict_rate) + shared AS lower_bound_power FROM (SELECT *, 0.20 * credible_low + 0.12 * precision + 0.12 * recall + 0.10 * specificity + 0.08 * worst_bucket_success + 0.06 * high_noise_success + 0.02 * (1 - false_positive_rate) + 0.02 * (1 - false_negative_rate) + 0.02 * (1 - fp_concentration_share) + 0.01 * (1 - abs(high_noise_delta)) + 0.01 * (1 - primary_stolen_rate) AS shared FROM m2))"""


@query(f"WITH {DISTRIBUTION} SELECT analyzer_id, bucket_type, bucket_value, n_cases, successes, {r('posterior_mean', 'credible_low', 'credible_high', 'precision', 'recall', 'specificity', 'false_positive_rate', 'false_negative_rate', 'conflict_rate', 'primary_stolen_rate', 'high_noise_success', 'normal_noise_success', 'worst_bucket_success', 'fp_concentration_share', 'conflict_resistance')}, conflicts, {r('high_noise_delta', 'power_score')} FROM dist")
def q55_success_distribution(spark, sf_dir):
    """All ten bucket types of every analyzer in one aggregation."""
    return power.success_distribution(case_table(spark, sf_dir))


@query(f"""WITH {DISTRIBUTION} SELECT row_number() OVER (ORDER BY power_score DESC, lower_bound_power DESC, posterior_mean DESC, analyzer_id)::INT AS rank, analyzer_id, {r('power_score AS mean_power', 'lower_bound_power', 'posterior_mean', 'credible_low')},
    CASE WHEN lower_bound_power >= 0.82 AND fp_concentration_share <= 0.20 AND conflict_resistance >= 0.80 AND abs(high_noise_delta) <= 0.12 THEN 'promote' WHEN lower_bound_power >= 0.70 AND precision >= 0.80 AND fp_concentration_share <= 0.28 AND worst_bucket_success >= 0.65 THEN 'keep' WHEN precision >= 0.80 AND fp_concentration_share >= 0.30 THEN 'guardrail_needed'
        WHEN lower_bound_power < 0.60 OR worst_bucket_success < 0.55 OR recall < 0.65 THEN 'do_not_trust' ELSE 'tune' END AS recommended_status FROM dist WHERE bucket_type = 'overall'""")
def q56_power_ranking(spark, sf_dir):
    return power.ranking(power.success_distribution(case_table(spark, sf_dir)))


@query(f"WITH {DISTRIBUTION} SELECT analyzer_id, bucket_type, bucket_value, n_cases, {r('successes / n_cases AS success_rate', 'credible_low')} FROM (SELECT *, row_number() OVER (PARTITION BY analyzer_id ORDER BY successes / n_cases, credible_low, n_cases DESC, bucket_type, bucket_value) AS k FROM dist WHERE bucket_type <> 'overall') WHERE k = 1")
def q57_worst_buckets(spark, sf_dir):
    return power.worst_buckets(power.success_distribution(case_table(spark, sf_dir)))


FP_LIST = "[" + ", ".join(f"struct_pack(t := '{b}', v := {b}::VARCHAR)" for b in power.FP_BUCKETS) + "]"


@query(f"""WITH {CASES}, c AS (SELECT analyzer_id, b.t AS t, b.v AS v, count(*) AS n FROM (SELECT analyzer_id, unnest({FP_LIST}) AS b FROM cases WHERE is_false_positive) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY analyzer_id ORDER BY n DESC, t DESC, v DESC) AS k FROM c),
    e AS (SELECT analyzer_id, count(*) FILTER (is_false_positive) AS false_positive_cases FROM cases GROUP BY 1) SELECT analyzer_id, false_positive_cases, round(coalesce(n / nullif(false_positive_cases, 0), 0), 6) AS fp_concentration_share, coalesce(t, '') AS top_fp_bucket_type, coalesce(v, '') AS top_fp_bucket_value, coalesce(n, 0) AS top_fp_count FROM e LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (analyzer_id)""")
def q58_fp_concentration(spark, sf_dir):
    return power.false_positive_concentration(case_table(spark, sf_dir))


@query(f"WITH {DISTRIBUTION}, nn AS (SELECT analyzer_id, count(*) FILTER (noise_tier = 'normal') AS normal_noise_cases, count(*) FILTER (noise_tier = 'high') AS high_noise_cases FROM cases GROUP BY 1) SELECT analyzer_id, {r('normal_noise_success', 'high_noise_success', 'high_noise_delta', '1 - abs(high_noise_delta) AS noise_stability_score')}, normal_noise_cases, high_noise_cases FROM dist JOIN nn USING (analyzer_id) WHERE bucket_type = 'overall'")
def q59_noise_table(spark, sf_dir):
    rows = case_table(spark, sf_dir)
    return power.noise_table(power.success_distribution(rows), rows)


@query(f"WITH {CASES} SELECT analyzer_id, count(*) FILTER ({CONFLICT}) AS conflict_cases, count(*) FILTER ({CONFLICT} AND is_correct) AS conflict_successes, {r(f'coalesce(count(*) FILTER ({CONFLICT} AND is_correct) / nullif(count(*) FILTER ({CONFLICT}), 0), 1) AS conflict_resistance')}, count(*) FILTER (primary_stolen) AS primary_stolen_cases, {r('count(*) FILTER (primary_stolen) / count(*) AS primary_stolen_rate')}, count(*) FILTER (ambiguous) AS multi_match_ambiguity_cases, {r(f'count(*) FILTER ({CONFLICT}) / count(*) AS conflict_rate')} FROM cases GROUP BY 1")
def q60_conflict_table(spark, sf_dir):
    return power.conflict_table(case_table(spark, sf_dir))


@query(f"WITH {DISTRIBUTION}, o AS (SELECT * FROM dist WHERE bucket_type = 'overall') SELECT (SELECT count(*) FROM o) AS total_analyzers, (SELECT analyzer_id FROM o ORDER BY power_score DESC, lower_bound_power DESC, analyzer_id LIMIT 1) AS strongest_by_mean, (SELECT analyzer_id FROM o ORDER BY lower_bound_power DESC, power_score DESC, analyzer_id LIMIT 1) AS strongest_by_lower_bound, (SELECT analyzer_id FROM o ORDER BY lower_bound_power, power_score, analyzer_id LIMIT 1) AS weakest")
def q61_power_summary(spark, sf_dir):
    return power.power_summary(power.ranking(power.success_distribution(case_table(spark, sf_dir))))


@query()
def q62_power_bootstrap(spark, sf_dir):
    """Tested against resampled cases and its closed form; the draws are random."""
    return power.bootstrap_power(case_table(spark, sf_dir))


@query(f"""WITH {CASES} SELECT noise_tier, count(*) AS total, count(*) FILTER (pos AND is_correct) AS tp, count(*) FILTER (NOT pos AND NOT is_correct) AS fp, count(*) FILTER (NOT pos AND is_correct) AS tn, count(*) FILTER (pos AND NOT is_correct) AS fn, {r('avg(expected_confidence) AS mean_confidence', 'coalesce(stddev_samp(expected_confidence), 0) AS std_confidence')} FROM cases GROUP BY 1""")
def q63_aggregate_rows(spark, sf_dir):
    """Outcomes and confidences by noise tier; the deviation is the sample's, 0 for one case."""
    return tuning.aggregate_rows(case_table(spark, sf_dir), "noise_tier")


@query(f"""WITH {MANIFEST}, s AS (SELECT capture_id, CASE WHEN capture_id % 7 = 0 THEN 'holdout' WHEN capture_id % 7 = 1 THEN '' ELSE NULL END AS x FROM manifest WHERE capture_id % 7 IN (0, 1)) SELECT coalesce(nullif(x, ''), split) AS split, count(*) AS n FROM manifest LEFT JOIN s USING (capture_id) GROUP BY 1""")
def q64_merge_splits(spark, sf_dir):
    """A split table laid over the manifest: of repeated captures the first row counts, empty values change nothing."""
    m = views.manifest(spark, sf_dir).withColumn("split_purpose", F.lit(""))
    of = lambda k: m.where(f"capture_id % 7 = {k}")
    rows = of(0).selectExpr("capture_id", "'holdout' AS split", "'locked' AS split_purpose", "1 AS ordinal").union(of(0).selectExpr("capture_id", "'later'", "''", "2")).union(of(1).selectExpr("capture_id", "''", "''", "1"))
    return cases.merge_splits(m, rows).groupBy("split").agg(F.count("*").alias("n"))


def tuned_cases(profile: dict[str, float], name: str) -> str:
    """SQL: CTEs of case outcomes under a profile, only passing candidates being primary."""
    t = "CASE signature_id " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in profile.items()) + " ELSE 0.5 END"
    return f"""{name}p AS (SELECT *, matched AND confidence >= {t} AND ref > 0 AS ok, least(1, greatest(0, confidence * (0.70 + 0.30 * ref) + CASE WHEN matched AND confidence >= {t} THEN 0.05 ELSE 0 END)) AS dg FROM results),
    {name}w AS (SELECT capture_id, signature_id AS prim FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY dg DESC, confidence DESC, ref DESC, rank) AS k FROM {name}p JOIN (SELECT capture_id, signature_id, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, signature_id) AS rank FROM results) USING (capture_id, signature_id) WHERE ok) WHERE k = 1),
    {name} AS (SELECT m.*, coalesce(prim, '') AS prim, coalesce(prim = signature_id, false) AS won FROM manifest m LEFT JOIN {name}w USING (capture_id)),
    {name}m AS (SELECT split, count(*) FILTER (expected_fault_present AND won) AS tp, count(*) FILTER (NOT expected_fault_present AND won) AS fp, count(*) FILTER (NOT expected_fault_present AND NOT won) AS tn, count(*) FILTER (expected_fault_present AND NOT won) AS fn FROM {name} GROUP BY 1),
    {name}r AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM {name}m),
    {name}s AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy, (recall + specificity) / 2 - 2 * greatest(0, 0.88 - precision) AS objective FROM {name}r)"""


PAIR = f"{RESULTS}, {MANIFEST}, {tuned_cases(BASELINE, 'base')}, {tuned_cases(TUNED, 'tuned')}"


def profile_cases(spark, sf_dir) -> DataFrame:
    """Case rows of both profiles; the results are read once and scored twice."""
    m, c = views.manifest(spark, sf_dir), candidates(spark, sf_dir)
    rows = [cases.case_rows(m, c, p, forced=False).withColumn("profile", F.lit(name)) for name, p in BOTH.items()]
    return rows[0].unionByName(rows[1])


@query(f"""WITH {PAIR}, z AS (SELECT split, count(*) AS total_cases, count(*) FILTER (expected_fault_present) AS positives, count(*) FILTER (NOT expected_fault_present) AS negatives, count(DISTINCT signature_id) AS signatures, count(DISTINCT family) AS families, count(*) FILTER (noise_tier = 'high') AS high_noise_cases FROM manifest GROUP BY 1)
    SELECT z.*, {r('b.accuracy AS baseline_accuracy', 't.accuracy AS tuned_accuracy', 'b.precision AS baseline_precision', 't.precision AS tuned_precision', 'b.recall AS baseline_recall', 't.recall AS tuned_recall', 'b.objective AS objective_baseline', 't.objective AS objective_tuned')}, (SELECT CASE WHEN t.objective >= b.objective THEN 'tuned' ELSE 'baseline' END FROM bases b JOIN tuneds t USING (split) WHERE split = 'dev') AS recommended_profile
    FROM z JOIN bases b USING (split) JOIN tuneds t USING (split)""")
def q65_split_summary(spark, sf_dir):
    return tuning.split_summary(views.manifest(spark, sf_dir), profile_cases(spark, sf_dir), "baseline", "tuned")


@query(f"""WITH {PAIR}, j AS (SELECT b.split, b.balanced_accuracy AS bb, t.balanced_accuracy AS tb, b.recall AS br, t.recall AS tr, b.precision AS bp, t.precision AS tp_, b.fp AS bfp, t.fp AS tfp, b.fn AS bfn, t.fn AS tfn FROM bases b JOIN tuneds t USING (split)), dev AS (SELECT * FROM j WHERE split = 'dev'), tst AS (SELECT * FROM j WHERE split = 'test'),
    f AS (SELECT prim AS k, count(*) AS n FROM tuned WHERE split = 'test' AND NOT expected_fault_present AND won GROUP BY 1), f1 AS (SELECT max(n) / sum(n) AS share FROM f), g AS (SELECT test_id AS k, count(*) AS n FROM tuned WHERE split = 'test' AND expected_fault_present AND NOT won GROUP BY 1), g1 AS (SELECT max(n) / sum(n) AS share FROM g),
    nt AS (SELECT noise_tier, (coalesce(count(*) FILTER (expected_fault_present AND won) / nullif(count(*) FILTER (expected_fault_present), 0), 0) + coalesce(count(*) FILTER (NOT expected_fault_present AND NOT won) / nullif(count(*) FILTER (NOT expected_fault_present), 0), 0)) / 2 AS ba FROM tuned GROUP BY 1), nz AS (SELECT max(ba) FILTER (noise_tier = 'normal') AS a, max(ba) FILTER (noise_tier = 'high') AS b FROM nt),
    ic AS (SELECT 'b' AS side, * FROM bases WHERE split = 'test' UNION ALL SELECT 't', * FROM tuneds WHERE split = 'test'), im AS (SELECT side, unnest([struct_pack(o := 1, m := balanced_accuracy, s := sqrt(recall * (1 - recall) / (tp + fn) + specificity * (1 - specificity) / (tn + fp)) / 2), struct_pack(o := 2, m := precision, s := sqrt(precision * (1 - precision) / (tp + fp))), struct_pack(o := 3, m := recall, s := sqrt(recall * (1 - recall) / (tp + fn)))]) AS x FROM ic),
    iv AS (SELECT b.x.m AS b, t.x.m AS t, row_number() OVER (ORDER BY b.x.o) AS k FROM im b JOIN im t ON b.x.o = t.x.o AND b.side = 'b' AND t.side = 't' WHERE abs(b.x.m - t.x.m) < 0.02 AND least(1, b.x.m + 1.96 * b.x.s, t.x.m + 1.96 * t.x.s) > greatest(0, b.x.m - 1.96 * b.x.s, t.x.m - 1.96 * t.x.s)),
    u AS (SELECT 'dev_improvement_not_transferred' AS diagnostic, tst.bb AS baseline, tst.tb AS tuned FROM dev, tst WHERE dev.tb > dev.bb AND tst.tb < tst.bb
        UNION ALL SELECT 'recall_gain_with_precision_collapse', bp, tp_ FROM tst WHERE tr >= br AND tp_ + 0.03 < bp UNION ALL SELECT 'single_analyzer_dominates_false_positives', bfp, tfp FROM tst, f1 WHERE share >= 0.30
        UNION ALL SELECT 'single_test_dominates_false_negatives', bfn, tfn FROM tst, g1 WHERE share >= 0.20 UNION ALL SELECT 'high_noise_underperforms_normal_noise', a, b FROM nz WHERE a - b >= 0.05 UNION ALL SELECT 'confidence_interval_overlap_weak_improvement', b, t FROM iv WHERE k = 1)
    SELECT diagnostic, {r('baseline', 'tuned', 'tuned - baseline AS delta')} FROM (SELECT * FROM u UNION ALL SELECT 'no_material_overfit_signals', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM u))""")
def q66_overfit(spark, sf_dir):
    return tuning.overfit_diagnostics(profile_cases(spark, sf_dir), "baseline", "tuned")


@query()
def q67_coordinate_descent(spark, sf_dir):
    """Thresholds tuned one signature at a time; tested against a plain loop."""
    steps, _ = tuning.coordinate_descent(views.manifest(spark, sf_dir), candidates(spark, sf_dir), {"A": 0.5, "N": 0.5, "R": 0.5}, [round(0.1 * i, 1) for i in range(3, 10)], 0.5, 0.9, passes=2)
    return steps


@query(f"WITH {CASES} SELECT truth_label AS truth_class, count(*) AS cases, count(*) FILTER (won) AS detected, {r('count(*) FILTER (won) / count(*) AS rate')} FROM cases GROUP BY 1")
def q68_boundary_summary(spark, sf_dir):
    """Recall of positives and false positive rate of controls by truth class."""
    rows = case_table(spark, sf_dir)
    hit = F.col("predicted_primary") == F.col("analyzer_id")
    return rows.groupBy(F.col("truth_label").alias("truth_class")).agg(F.count("*").alias("cases"), F.count_if(hit).alias("detected"), (F.count_if(hit) / F.count("*")).alias("rate"))


@query(f"""WITH {CASES}, w AS (SELECT analyzer_id AS expected, coalesce(prim, 'none') AS predicted, count(*) AS n FROM cases WHERE NOT is_correct GROUP BY ALL) SELECT expected, predicted, n, row_number() OVER (ORDER BY n DESC, expected, predicted)::INT AS rank FROM w QUALIFY rank <= 5""")
def q69_top_confusions(spark, sf_dir):
    """The five commonest wrong decisions (a top-k report)."""
    wrong = case_table(spark, sf_dir).where("NOT is_correct").groupBy(F.col("analyzer_id").alias("expected"), F.when(F.col("predicted_primary") == "", "none").otherwise(F.col("predicted_primary")).alias("predicted")).agg(F.count("*").alias("n"))
    return wrong.withColumn("rank", F.expr("row_number() OVER (ORDER BY n DESC, expected, predicted)")).where("rank <= 5")


STATE = "states AS (SELECT *, last_value(CASE WHEN v >= 60 THEN 1 WHEN v <= 40 THEN 0 WHEN n = 0 THEN CASE WHEN v >= 50 THEN 1 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS state FROM samples)"


@query(f"""WITH {SAMPLES}, {STATE}, m AS (SELECT *, lag(state) OVER w AS before, lead(t) OVER w - t AS dt, lead(v) OVER w AS ahead FROM states WINDOW w AS (PARTITION BY capture_id ORDER BY n)), p AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS pulse FROM m)
    SELECT capture_id, pulse, {r('min(t) AS start_s', 'min(CASE WHEN state = 0 AND before = 1 THEN t END) AS end_s', 'max(CASE WHEN state = 1 THEN v END) AS peak')}, round(sum(CASE WHEN state = 1 THEN dt * (v + ahead) / 2 END), 2) AS area, round(min(CASE WHEN state = 0 AND before = 1 THEN t END) - min(t), 6) AS width_s FROM p WHERE pulse > 0 GROUP BY ALL HAVING min(CASE WHEN state = 0 AND before = 1 THEN t END) IS NOT NULL""")
def q70_pulse_list(spark, sf_dir):
    return events.pulse_list(events.schmitt(views.samples(spark, sf_dir), 40.0, 60.0)).withColumn("area", F.round("area", 2))


@query(f"""WITH {SAMPLES}, o AS (SELECT *, t - lag(t) OVER (PARTITION BY capture_id ORDER BY n) AS dt FROM samples WHERE v > 60), k AS (SELECT capture_id, count(*) FILTER (dt IS NULL OR dt > 7200) AS e FROM o GROUP BY 1) SELECT capture_id, coalesce(e, 0) AS events FROM (SELECT DISTINCT capture_id FROM samples) LEFT JOIN k USING (capture_id)""")
def q71_merged_count(spark, sf_dir):
    return events.merged_count(views.samples(spark, sf_dir), "v > 60", 7200.0)


@query(f"""WITH {SAMPLES}, e AS (SELECT capture_id, min(t) + 0.2 * (max(t) - min(t)) AS u, 0.05 * (max(v) - min(v)) AS l FROM samples GROUP BY 1), x AS (SELECT *, t <= u AS pre FROM samples JOIN e USING (capture_id)), b AS (SELECT capture_id, median(v) AS b, count(*) AS k FROM x WHERE pre GROUP BY 1), d AS (SELECT *, abs(v - b) AS d FROM x JOIN b USING (capture_id)), m AS (SELECT capture_id, median(d) AS m FROM d WHERE pre GROUP BY 1),
    s AS (SELECT capture_id, any_value(m) AS m, median(abs(d - m)) AS s FROM d JOIN m USING (capture_id) WHERE pre GROUP BY 1), z AS (SELECT *, avg(d) OVER (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM d JOIN s USING (capture_id)) SELECT capture_id, round(min(CASE WHEN NOT pre AND k >= 8 AND y > greatest(m + 6 * s, l) THEN t END), 6) AS onset_s FROM z GROUP BY 1""")
def q72_activity_onset(spark, sf_dir):
    return events.activity_onset(views.samples(spark, sf_dir), 0.2)


BUSY = "busy AS (SELECT capture_id, t AS s, t + 1800 AS e FROM samples WHERE event_type = 'click'), cmd AS (SELECT capture_id, event_id AS window_id, t AS s, t + 14400 AS e FROM samples WHERE event_type = 'purchase')"


@query(f"""WITH {SAMPLES}, {BUSY}, i AS (SELECT c.capture_id, c.window_id, c.s AS ws, c.e AS we, b.s, b.e FROM cmd c JOIN busy b ON b.capture_id = c.capture_id AND b.e > c.s AND b.s < c.e UNION ALL SELECT capture_id, window_id, s, e, s, s FROM cmd UNION ALL SELECT capture_id, window_id, s, e, e, e FROM cmd),
    f AS (SELECT *, greatest(max(e) OVER (PARTITION BY capture_id, window_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ws) AS cur FROM i), x AS (SELECT capture_id, min(s) AS first FROM busy GROUP BY 1) SELECT capture_id, window_id, {r('cur AS start_s', 'least(s, we) AS end_s')} FROM f JOIN x USING (capture_id) WHERE s > cur AND least(s, we) > first AND least(s, we) - cur BETWEEN 60 AND 86400""")
def q73_window_complement(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    busy = s.where("event_type = 'click'").selectExpr("capture_id", "t AS start_s", "t + 1800 AS end_s")
    return events.complement(s.where("event_type = 'purchase'").selectExpr("capture_id", "event_id AS window_id", "t AS start_s", "t + 14400 AS end_s"), busy, 60.0, 86400.0)


@query(f"WITH {SAMPLES}, e AS (SELECT capture_id, t, 'c1' AS channel, 'high' AS label FROM samples WHERE v > 80 UNION ALL SELECT capture_id, t, 'c2', event_type FROM samples WHERE event_type = 'purchase') SELECT capture_id, round(t, 6) AS t, channel, label, row_number() OVER (PARTITION BY capture_id ORDER BY t, channel, label)::INT AS seq FROM e")
def q74_timeline(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    return events.timeline(s.where("v > 80").selectExpr("capture_id", "t", "'c1' AS channel", "'high' AS label"), s.where("event_type = 'purchase'").selectExpr("capture_id", "t", "'c2' AS channel", "event_type AS label"))


LABELS = {"view": "rose", "purchase": "fell", "click": "source", "signup": "reference", "error": "asserted"}
LABEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
ANCHORS = f"""a AS (SELECT capture_id, min(CASE WHEN l = 'rose' THEN t END) AS ro, min(CASE WHEN l = 'fell' THEN t END) AS fe, min(CASE WHEN l = 'source' THEN t END) AS so, min(CASE WHEN l = 'reference' THEN t END) AS re, min(CASE WHEN l = 'asserted' THEN t END) AS asr, min(t) AS s, max(t) AS e FROM (SELECT *, {LABEL_SQL} AS l FROM samples) GROUP BY 1),
    win AS (SELECT * FROM (SELECT capture_id, 'baseline_pre_command' AS name, s AS start_s, ro AS end_s FROM a UNION ALL SELECT capture_id, 'command_active', ro, fe FROM a UNION ALL SELECT capture_id, 'source_activity', so, coalesce(fe, e) FROM a UNION ALL SELECT capture_id, 'reference_disturbance', re, coalesce(fe, e) FROM a UNION ALL SELECT capture_id, 'post_event_recovery', greatest(fe, asr), e FROM a) WHERE end_s > start_s)"""


def anchored(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    spans = s.groupBy("capture_id").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return s, events.anchored_windows(s.selectExpr("capture_id", "t", f"{LABEL_SQL} AS label"), spans)


@query(f"WITH {SAMPLES}, {ANCHORS} SELECT capture_id, name, {r('start_s', 'end_s')} FROM win")
def q75_analysis_windows(spark, sf_dir):
    return anchored(spark, sf_dir)[1]


@query(f"WITH {SAMPLES}, {ANCHORS} SELECT capture_id, name, count(*) AS samples, {r('avg(v) AS mean', 'sqrt(avg(v * v)) AS rms')} FROM win JOIN samples USING (capture_id) WHERE t BETWEEN start_s AND end_s GROUP BY ALL")
def q76_window_samples(spark, sf_dir):
    s, windows = anchored(spark, sf_dir)
    return events.window_samples(s, windows, 7 * 86400.0)


@query(f"WITH {SAMPLES}, {ANCHORS} SELECT capture_id, {r('so - ro AS source_after_s', 're - ro AS reference_after_s', 'fe - ro AS fell_after_s')} FROM a")
def q77_role_deltas(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    return events.role_deltas(s.selectExpr("capture_id", "t", f"{LABEL_SQL} AS label"), "rose", ["source", "reference", "fell"])


@query(f"WITH {SAMPLES}, l AS (SELECT * FROM samples WHERE event_type = 'purchase'), q AS (SELECT * FROM samples WHERE event_type = 'click') SELECT l.capture_id, l.event_id, round(coalesce(exp(-min(abs(l.t - q.t)) / 3600), 0), 6) AS score FROM l LEFT JOIN q USING (capture_id) GROUP BY ALL")
def q78_nearest_time_score(spark, sf_dir):
    """exp(-distance to the nearest click / an hour); 0 without one."""
    s = views.samples(spark, sf_dir)
    return joins.nearest_time_score(s.where("event_type = 'purchase'").select("capture_id", "event_id", "t"), s.where("event_type = 'click'").select("capture_id", "t"), "capture_id", "t", 3600.0)


@query(f"""WITH {SAMPLES}, m AS (SELECT n, median(v) AS m, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM samples GROUP BY 1) SELECT n, round(any_value(m), 6) AS reference, round(median(abs(v - m)), 6) AS mad, round(avg(CASE WHEN v >= lo AND v <= hi THEN v END), 6) AS trimmed_mean, count(*) FILTER (v >= lo AND v <= hi) AS kept FROM samples JOIN m USING (n) GROUP BY 1""")
def q79_ensemble_spread(spark, sf_dir):
    return events.ensemble_spread(views.samples(spark, sf_dir))


MANY = """e AS (SELECT vec_id AS capture_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
    ref AS (SELECT label, n, avg(v) AS r FROM e GROUP BY 1, 2), labels_ AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS k, (SELECT count(DISTINCT label) FROM embeddings) AS c FROM (SELECT DISTINCT label FROM embeddings)),
    x AS (SELECT e.capture_id, ref.label AS label, e.n, e.v, ref.r FROM e JOIN labels_ a ON a.label = e.label JOIN labels_ b ON b.k = a.k OR b.k = (a.k + 1) % a.c JOIN ref ON ref.label = b.label AND ref.n = e.n)"""


@query(f"WITH {MANY} SELECT capture_id, label::VARCHAR AS reference_label, {r('coalesce(median(CASE WHEN abs(r) > 1e-9 THEN v / r END), 1) AS gain', 'coalesce(corr(v, r), 0) AS correlation', 'sqrt(avg((v - r) * (v - r))) / greatest(sqrt(avg(r * r)), 1e-12) AS residual_energy_ratio')} FROM x GROUP BY ALL")
def q80_reference_features(spark, sf_dir):
    """Each capture against each of its references: its label's mean vector and the next label's."""
    return pair_features(views.vector_pairs(spark, sf_dir)).select("capture_id", "reference_label", "gain", "correlation", "residual_energy_ratio")


RESIDUAL = "t AS (SELECT capture_id, label::VARCHAR AS reference_label, sqrt(avg((v - r) * (v - r))) / greatest(sqrt(avg(r * r)), 1e-12) AS resid, coalesce(corr(v, r), 0) AS cr FROM x GROUP BY ALL), u AS (SELECT *, resid > 0.12 AS matched, least(1, greatest(0, 0.5 * resid + 0.2 * greatest(cr, 0))) AS s FROM t), w AS (SELECT *, CASE WHEN matched THEN s ELSE least(0.45, s) END AS confidence FROM u)"


@query(f"WITH {MANY}, {RESIDUAL} SELECT capture_id, reference_label AS best_reference, round(confidence, 6) AS confidence, matched FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY NOT matched, confidence DESC, reference_label) AS k FROM w) WHERE k = 1")
def q81_best_reference(spark, sf_dir):
    """The fallback for signatures without rules, with several references a capture."""
    scored = rules.score_signatures(pair_features(views.vector_pairs(spark, sf_dir)), ["no_such_signature"])
    top = rules.ranked(scored)
    return top.select("capture_id", "best_reference", F.col("top_confidence").alias("confidence"), (F.col("decision") == "matched").alias("matched"))


EV = "e AS (SELECT l_orderkey AS capture_id, l_returnflag AS seed, l_linenumber AS site, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 50 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END AS b, l_tax * 10 AS c FROM lineitem)"


def layers(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS capture_id", "l_returnflag AS seed", "l_linenumber AS site", "CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 50 END AS a", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END AS b", "l_tax * 10 AS c")


MIXED = "0.5 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.2 * c"
HAVE = "CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + 0.2"
GEO = "CASE WHEN a = 0 OR b = 0 OR c = 0 THEN 0 ELSE exp((coalesce(ln(nullif(a, 0)), 0) + coalesce(ln(nullif(b, 0)), 0) + ln(nullif(c, 0))) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1)) END"


@query(f"WITH {EV} SELECT seed, site, count(*) AS n, {r(f'avg(({MIXED}) / ({HAVE})) AS score', f'avg({HAVE}) AS coverage', f'avg({GEO}) AS compound')} FROM e GROUP BY ALL")
def q82_layered_evidence(spark, sf_dir):
    score, coverage, compound = evidence.layered({"a": 0.5, "b": 0.3, "c": 0.2})
    rows = layers(spark, sf_dir).select("seed", "site", score.alias("s"), coverage.alias("k"), compound.alias("g"))
    return rows.groupBy("seed", "site").agg(F.count("*").alias("n"), F.avg("s").alias("score"), F.avg("k").alias("coverage"), F.avg("g").alias("compound"))


@query(f"WITH {EV} SELECT *, row_number() OVER (PARTITION BY seed ORDER BY total DESC, seed, site)::INT AS rank FROM (SELECT seed, site, round(sum(c), 6) AS total, count(*) AS measurements FROM e GROUP BY ALL)")
def q83_hypothesis_fusion(spark, sf_dir):
    """Hypotheses (seed at a site) fused over all measurements."""
    return evidence.fused(layers(spark, sf_dir), ["seed", "site"], "c")


@query(f"""WITH {SAMPLES}, l AS (SELECT event_type, capture_id % 4 AS class, count(*) AS n FROM samples GROUP BY ALL), t AS (SELECT event_type, class AS commonest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, class) AS k FROM l) WHERE k = 1)
    SELECT event_type, count(*) AS cases, count(*) FILTER (v > 10) AS valid, count(*) FILTER (v > 50) AS hits, round(count(*) FILTER (v > 50) / count(*) FILTER (v > 10), 6) AS rate, 4::BIGINT AS classes, any_value(commonest) AS commonest, round(median(v), 6) AS median FROM samples JOIN t USING (event_type) GROUP BY 1""")
def q84_population(spark, sf_dir):
    rows = views.samples(spark, sf_dir).withColumn("class", F.col("capture_id") % 4)
    return evidence.population(rows, "event_type", "class", F.col("v") > 10, F.col("v") > 50, "v")


@query(f"WITH {SAMPLES}, s AS (SELECT capture_id, event_type, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM samples GROUP BY ALL) SELECT capture_id, event_type, n, {r('mean', 'std', 'std / abs(mean) AS cv')}, CASE WHEN n >= 3 AND std / abs(mean) <= 0.05 THEN 'strongly_supported' WHEN n >= 3 AND std / abs(mean) <= 0.15 THEN 'supported' ELSE 'exploratory' END AS support FROM s")
def q85_repeatability(spark, sf_dir):
    return evidence.repeatability(views.samples(spark, sf_dir), ["capture_id", "event_type"], "v")


E3 = "e AS (SELECT label AS capture_id, 'c' || (vec_id % 3) AS channel, n, avg(v) AS v FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings) GROUP BY ALL)"


@query(f"WITH {E3} SELECT x.capture_id, x.channel AS a, y.channel AS b, {r('corr(x.v, y.v) AS correlation', 'sqrt(avg((x.v - y.v) * (x.v - y.v))) AS rms_difference')}, count(*) AS samples FROM e x JOIN e y ON x.capture_id = y.capture_id AND x.n = y.n AND x.channel < y.channel GROUP BY ALL")
def q86_channel_pairs(spark, sf_dir):
    """All pairs of channels; a channel is a third of a label's vectors, averaged."""
    e = views.table(spark, sf_dir, "embeddings").select("label", F.concat(F.lit("c"), F.col("vec_id") % 3).alias("channel"), F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "v"))
    return evidence.channel_pairs(e.groupBy(F.col("label").alias("capture_id"), "channel", "n").agg(F.avg("v").alias("v")))


@query(f"""WITH {SAMPLES}, l AS (SELECT * FROM samples WHERE event_type = 'purchase'), q AS (SELECT capture_id, t, min(v) AS v FROM samples WHERE event_type = 'click' GROUP BY ALL), a AS (SELECT l.capture_id, l.event_id, l.t, q.t AS ta, q.v AS av FROM l ASOF LEFT JOIN q ON l.capture_id = q.capture_id AND l.t >= q.t),
    b AS (SELECT a.*, q.t AS tb, q.v AS bv FROM a ASOF LEFT JOIN q ON a.capture_id = q.capture_id AND a.t <= q.t) SELECT capture_id, event_id, round(CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN av + (bv - av) * coalesce((t - ta) / nullif(tb - ta, 0), 0) END, 6) AS aligned FROM b""")
def q87_interpolated(spark, sf_dir):
    """One track resampled at the times of another."""
    s = views.samples(spark, sf_dir)
    return evidence.interpolated(s.where("event_type = 'purchase'").select("capture_id", "event_id", "t"), s.where("event_type = 'click'").select("capture_id", "t", "v")).drop("t")


@query(f"""WITH {SAMPLES}, o AS (SELECT *, n - lag(n) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM samples WHERE v > 80), u AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n) AS run FROM o), w AS (SELECT capture_id, greatest(min(n) - 2, 0) AS s, max(n) + 2 AS e FROM u GROUP BY capture_id, run),
    p AS (SELECT *, sum(CASE WHEN s <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY s, e)::BIGINT AS run FROM (SELECT *, max(e) OVER (PARTITION BY capture_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)) SELECT capture_id, run, min(s) AS start_n, max(e) AS end_n FROM p GROUP BY ALL""")
def q88_padded_runs(spark, sf_dir):
    return evidence.padded_runs(events.runs(views.samples(spark, sf_dir), "v > 80"), 2)


@query(f"WITH {SAMPLES}, f AS (SELECT capture_id, max_by(v, n) AS final FROM samples GROUP BY 1), o AS (SELECT capture_id, max(CASE WHEN abs(v - final) > 40 THEN n END) AS lo FROM samples JOIN f USING (capture_id) GROUP BY 1) SELECT capture_id, {r('any_value(final) AS final', 'min(CASE WHEN lo IS NULL OR n > lo THEN t END) AS settled_s')}, count(*) FILTER (abs(v - final) > 40) AS samples_out FROM samples JOIN f USING (capture_id) JOIN o USING (capture_id) GROUP BY 1")
def q89_settling(spark, sf_dir):
    return evidence.settling(views.samples(spark, sf_dir), 40.0)


@query(f"WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY capture_id ORDER BY n) AS dt FROM samples), m AS (SELECT capture_id, median(dt) AS typical FROM d GROUP BY 1) SELECT capture_id, {r('any_value(typical) AS typical', 'regr_slope(dt, n) AS drift')}, sum(coalesce(floor(greatest(dt / nullif(typical, 0) + 0.5, 1)) - 1, 0))::BIGINT AS missing FROM d JOIN m USING (capture_id) WHERE dt IS NOT NULL GROUP BY 1")
def q90_interval_regularity(spark, sf_dir):
    return evidence.interval_regularity(views.samples(spark, sf_dir))


@query(f"WITH {SAMPLES}, d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY capture_id ORDER BY n)) AS d, n // 10 AS w FROM samples), m AS (SELECT capture_id, w, median(d) AS sm, quantile_cont(v, 0.9) AS p, count(*) AS samples FROM d GROUP BY ALL) SELECT capture_id, w, {r('any_value(sm) AS step_median', 'any_value(p) AS level_p90')}, any_value(samples) AS samples, round(median(abs(d - sm)), 6) AS step_mad FROM d JOIN m USING (capture_id, w) GROUP BY ALL")
def q91_subwindows(spark, sf_dir):
    return evidence.subwindows(views.samples(spark, sf_dir), 10)


@query(f"""WITH {SAMPLES}, {STATE}, x AS (SELECT *, sum(CASE WHEN state <> b THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS run FROM (SELECT *, lag(state) OVER (PARTITION BY capture_id ORDER BY n) AS b FROM states)), u AS (SELECT capture_id, run, max(state) AS state, min(t) AS t, count(*) AS k FROM x GROUP BY ALL)
    SELECT capture_id, round(min(CASE WHEN state = 1 THEN t END), 6) AS first_contact_s, max(run) AS reversals, max(CASE WHEN state = 1 THEN k END) AS longest_contact, count(*) FILTER (state = 1 AND k < 2) AS short_contacts, round(max(CASE WHEN run > 0 THEN t END), 6) AS last_reversal_s FROM u GROUP BY 1""")
def q92_contact_anatomy(spark, sf_dir):
    return evidence.contact_anatomy(events.schmitt(views.samples(spark, sf_dir), 40.0, 60.0))


@query(f"""WITH {SAMPLES}, e AS (SELECT capture_id, n, sum(v) OVER w AS s, sum(v * v) OVER w AS q, greatest(3 - n, 0) AS b, greatest(4 - count(*) OVER p + n, 0) AS a, first(v) OVER o AS f, last(v) OVER o AS l FROM samples
        WINDOW w AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), p AS (PARTITION BY capture_id), o AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT capture_id, n, {r('s / 7 AS same_mean', 'sqrt(q / 7) AS same_rms', '(s + b * f + a * l) / 7 AS nearest_mean', 'sqrt((q + b * f * f + a * l * l) / 7) AS nearest_rms')} FROM e""")
def q93_edge_windows(spark, sf_dir):
    """Moving windows whose edges are zero or the end's value."""
    return timing.edge_windows(views.samples(spark, sf_dir), 3).select("capture_id", "n", "same_mean", "same_rms", "nearest_mean", "nearest_rms")


def cross(level: str, u: str = "u") -> str:
    return f"CASE WHEN p{u} < {level} AND {u} >= {level} THEN pt + ({level} - p{u}) / ({u} - p{u}) * (t - pt) END"


RAILED = "(SELECT capture_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM {0} GROUP BY 1)"
LAGS = "lag(u) OVER w AS pu, lag(t) OVER w AS pt, lag(v) OVER w AS pv"


def unit(source: str, rising: bool = True) -> str:
    start, sign = ("lo", "") if rising else ("hi", "-")
    return f"(SELECT *, {LAGS} FROM (SELECT s.*, lo, hi, {sign}(v - {start}) / greatest(hi - lo, 1e-12) AS u FROM {source} AS s JOIN {RAILED.format(source)} USING (capture_id)) WINDOW w AS (PARTITION BY capture_id ORDER BY n))"


@query(f"""WITH {SAMPLES}, a AS (SELECT *, min({cross('0.1')}) OVER (PARTITION BY capture_id) AS t10, min(CASE WHEN abs(u - 1) <= 0.25 THEN 1 ELSE 0 END) OVER h = 1 AND count(*) OVER h = 2 AS held,
        last_value(CASE WHEN u >= 0.6 THEN 1 WHEN u <= 0.4 THEN 0 WHEN n = 0 THEN (u >= 0.5)::INT END IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n) AS state FROM {unit('samples')} WINDOW h AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
    b AS (SELECT *, min(CASE WHEN {cross('0.5')} >= t10 THEN {cross('0.5')} END) OVER (PARTITION BY capture_id) AS t50 FROM a), c AS (SELECT *, min(CASE WHEN {cross('0.9')} >= t50 THEN {cross('0.9')} END) OVER (PARTITION BY capture_id) AS t90 FROM b),
    d AS (SELECT *, t >= t10 - 3600 AND t <= t90 + 36000 AS near, lag(state) OVER (PARTITION BY capture_id ORDER BY n) AS ps FROM c), e AS (SELECT *, near AND lag(near) OVER (PARTITION BY capture_id ORDER BY n) AND state <> ps AS turn FROM d),
    g AS (SELECT capture_id, lo, hi, t10, t50, t90, max(CASE WHEN t > t10 AND pt < t90 THEN abs((v - pv) / nullif(t - pt, 0)) END) AS steep, greatest(max(CASE WHEN t >= t90 THEN u END) - 1, 0) AS over, coalesce(min(CASE WHEN t >= t90 AND held THEN t END), max(t)) AS settled, count(*) FILTER (turn) AS turns FROM e GROUP BY ALL)
    SELECT capture_id, {r('lo AS low_rail', 'hi AS high_rail', 't10', 't50', 't90', 't90 - t10 AS transition_s', 'CASE WHEN t90 IS NOT NULL THEN steep END AS steepest', 'CASE WHEN t90 IS NOT NULL THEN over END AS overshoot', 'settled - t90 AS settling_s')}, greatest(turns - 1, 0) AS chatter FROM g""")
def q94_edge_timing(spark, sf_dir):
    return timing.edge_timing(views.samples(spark, sf_dir), tolerance=0.25, hold=2, before_s=3600.0, after_s=36000.0)


def channel(spark, sf_dir, kind: str) -> DataFrame:
    """A user's events of one kind as a channel of the capture, numbered anew."""
    return views.samples(spark, sf_dir).where(F.col("event_type") == kind).selectExpr("capture_id", "row_number() OVER (PARTITION BY capture_id ORDER BY n) - 1 AS n", "t", "v")


CHANNELS = ", ".join(f"c_{k} AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY n) - 1 AS n, t, v FROM samples WHERE event_type = '{k}')" for k in ("signup", "view", "click", "purchase", "error"))


def onset(source: str, share: float, hold: int) -> str:
    return f"""(SELECT capture_id, min(CASE WHEN a THEN t END) AS x FROM (SELECT capture_id, t, min(CASE WHEN abs(v - base) >= {share} * greatest(hi - lo, 1e-12) THEN 1 ELSE 0 END) OVER h = 1 AND count(*) OVER h = {hold} AS a
        FROM {source} JOIN {RAILED.format(source)} USING (capture_id) JOIN (SELECT capture_id, median(v) AS base FROM (SELECT *, count(*) OVER (PARTITION BY capture_id) AS k FROM {source}) WHERE n < greatest(4, floor(k * 0.12)) GROUP BY 1) USING (capture_id)
        WINDOW h AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {hold - 1} FOLLOWING)) GROUP BY 1)"""


@query(f"""WITH {SAMPLES}, {CHANNELS}, k AS (SELECT * FROM (SELECT capture_id, min({cross('0.5')}) AS command FROM {unit('c_signup')} GROUP BY 1) JOIN (SELECT capture_id, x AS current FROM {onset('c_view', 0.3, 2)}) USING (capture_id) JOIN (SELECT capture_id, x AS motion FROM {onset('c_click', 0.2, 2)}) USING (capture_id)
        JOIN (SELECT capture_id, min({cross('50', 'v')}) AS threshold FROM {unit('c_purchase')} GROUP BY 1) USING (capture_id) JOIN (SELECT capture_id, min({cross('0.5')}) AS output FROM {unit('c_error')} GROUP BY 1) USING (capture_id))
    SELECT capture_id, {r('command', 'current', 'motion', 'threshold', 'output', 'current - command AS command_to_current', 'motion - current AS current_to_motion', 'threshold - motion AS motion_to_threshold', 'output - threshold AS threshold_to_output', 'output - command AS total')} FROM k""")
def q95_timing_chain(spark, sf_dir):
    """Command, current, motion, threshold and output of a capture in five channels."""
    c = lambda kind: channel(spark, sf_dir, kind)
    return timing.timing_chain([timing.level_time(c("signup"), "command"), timing.onset_time(c("view"), "current", 0.3, 2, least=4), timing.onset_time(c("click"), "motion", 0.2, 2, least=4), timing.level_time(c("purchase"), "threshold", 50.0), timing.level_time(c("error"), "output")])


@query(f"""WITH {SAMPLES}, {CHANNELS}, u AS (SELECT capture_id, min({cross('0.5')}) AS on_s FROM {unit('c_click')} GROUP BY 1), f AS (SELECT capture_id, {cross('0.5')} AS off_s FROM {unit('c_click', False)}), o AS (SELECT capture_id, on_s, min(off_s) AS off_s FROM u JOIN f USING (capture_id) WHERE off_s > on_s GROUP BY ALL),
    e AS (SELECT capture_id, 'on' AS side, on_s AS t FROM o UNION ALL SELECT capture_id, 'off', off_s FROM o), q AS (SELECT capture_id, t, min(v) AS v FROM c_view GROUP BY ALL), a AS (SELECT e.*, q.t AS ta, q.v AS av FROM e ASOF LEFT JOIN q ON e.capture_id = q.capture_id AND e.t >= q.t),
    b AS (SELECT a.*, q.t AS tb, q.v AS bv FROM a ASOF LEFT JOIN q ON a.capture_id = q.capture_id AND a.t <= q.t), z AS (SELECT capture_id, side, t, CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN av + (bv - av) * coalesce((t - ta) / nullif(tb - ta, 0), 0) END AS x FROM b),
    y AS (SELECT capture_id, max(CASE WHEN side = 'on' THEN t END) AS on_s, max(CASE WHEN side = 'off' THEN t END) AS off_s, max(CASE WHEN side = 'on' THEN x END) AS on_position, max(CASE WHEN side = 'off' THEN x END) AS off_position FROM z GROUP BY 1)
    SELECT capture_id, {r('on_s', 'off_s', 'on_position', 'off_position', 'abs(off_position - on_position) AS hysteresis')} FROM y""")
def q96_switch_hysteresis(spark, sf_dir):
    """Positions (one channel) at which another switches on and off."""
    return timing.switch_hysteresis(channel(spark, sf_dir, "click"), channel(spark, sf_dir, "view"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, stddev_pop(l_quantity) / greatest(avg(l_quantity), 1e-12) AS a, stddev_pop(l_extendedprice) / greatest(avg(l_extendedprice), 1e-12) AS b FROM lineitem GROUP BY 1)
    SELECT l_suppkey, n, round(a, 6) AS l_quantity_cv, round(b, 6) AS l_extendedprice_cv, CASE WHEN n >= 6 AND a <= 0.56 AND b <= 0.6 THEN 'strongly_supported' WHEN n >= 3 AND a <= 0.58 AND b <= 0.65 THEN 'supported' ELSE 'exploratory' END AS support FROM g""")
def q97_support_ladder(spark, sf_dir):
    return evidence.support_ladder(views.table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"l_quantity": (0.56, 0.58), "l_extendedprice": (0.6, 0.65)})


@query()
def q98_bootstrap_support(spark, sf_dir):
    """Spread of resampled medians of each event type's values (tested against a loop)."""
    return evidence.bootstrap_support(views.table(spark, sf_dir, "events"), ["event_type"], "value")


REPORT = "count(*) AS total_cases, count(*) FILTER (matched) AS matched_count, count(*) FILTER (winner = signature_id) AS top1_count, round(avg(confidence), 6) AS mean_confidence, round(median(confidence), 6) AS median_confidence, round(quantile_cont(confidence, 0.05), 6) AS p05_confidence, round(quantile_cont(confidence, 0.95), 6) AS p95_confidence, round(avg(rank), 6) AS mean_rank, 0::BIGINT AS error_count"


@query(f"""WITH s AS (SELECT signature_id, {REPORT}, count(*) FILTER (is_true_positive) AS tp, count(*) FILTER (is_false_positive) AS fp, count(*) FILTER (is_true_negative) AS tn, count(*) FILTER (is_false_negative) AS fn FROM ({ORACLE_SQL['q50_per_case']}) GROUP BY 1)
    SELECT *, tp + fn AS truth_cases, {r('tp / nullif(tp + fn, 0) AS recall', 'tp / nullif(tp + fp, 0) AS precision', 'fp / nullif(fp + tn, 0) AS false_positive_rate', 'tn / nullif(tn + fp, 0) AS specificity', '(tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy')} FROM s""")
def q126_signature_report(spark, sf_dir):
    """Signatures over per-case rows, with truth."""
    return metrics.signature_report(q50_per_case(spark, sf_dir))


@query(f"WITH s AS (SELECT signature_id, {REPORT} FROM ({ORACLE_SQL['q50_per_case']}) GROUP BY 1) SELECT *, round(matched_count / total_cases, 6) AS match_rate, round(top1_count / total_cases, 6) AS top1_rate FROM s")
def q127_signature_report_without_truth(spark, sf_dir):
    return metrics.signature_report(q50_per_case(spark, sf_dir), with_truth=False)
