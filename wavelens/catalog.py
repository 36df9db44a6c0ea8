"""All queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.features import FEATURES, pair_features
from .operators import events, joins, metrics, tuning
from .plans import rules, views
from .plans.views import DECISIONS, SAMPLES, SCORES

CUTS = [round(0.05 * i, 2) for i in range(1, 20)]
SHARES = {"train": 0.6, "dev": 0.2, "test": 0.2}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to digits places: engines add in different orders."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[f.__name__].__name__ = f.__name__
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(*pairs: str) -> str:
    """Rounded SQL columns, of 'name' or 'expression AS name'."""
    out = []
    for p in pairs:
        e, _, n = p.rpartition(" AS ")
        out.append(f"round({e or p}, 6) AS {n or p}")
    return ", ".join(out)


@query(f"WITH {SAMPLES} SELECT capture_id, count(*) AS count, {r('avg(v) AS mean', 'min(v) AS min', 'max(v) AS max', 'stddev_pop(v) AS std', 'sqrt(avg(v * v)) AS rms', 'stddev_pop(v) AS rms_ac', 'max(v) - min(v) AS p2p')} FROM samples GROUP BY capture_id")
def q01_sample_stats(spark, sf_dir):
    return events.channel_stats(views.samples(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT n, {r('median(v) AS reference', 'avg(v) AS mean')}, count(*) AS captures FROM samples GROUP BY n")
def q02_pointwise_reference(spark, sf_dir):
    return events.pointwise_reference(views.samples(spark, sf_dir))


@query(f"SELECT event_type, {r('m AS median', '1.4826 * median(abs(value - m)) AS scale')}, count(*) AS count FROM events JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY event_type, m")
def q03_mad_scale(spark, sf_dir):
    return events.mad_scale(views.table(spark, sf_dir, "events").select("event_type", "value"), "event_type")


REFERENCE = "reference AS (SELECT n, median(v) AS r FROM samples GROUP BY n)"


@query(f"""WITH {SAMPLES}, {REFERENCE} SELECT capture_id, {r("coalesce(median(CASE WHEN abs(r) > 1e-9 THEN v / r END), 1) AS gain", "sqrt(avg(v * v)) / greatest(sqrt(avg(r * r)), 1e-12) AS rms_ratio", "max(abs(v)) / greatest(max(abs(r)), 1e-12) AS peak_ratio", "coalesce(corr(v, r), 0) AS correlation", "sqrt(avg((v - r) * (v - r))) / greatest(sqrt(avg(r * r)), 1e-12) AS residual_energy_ratio")}
    FROM samples JOIN reference USING (n) GROUP BY capture_id""")
def q04_pair_features(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    return events.pair_features(s, events.pointwise_reference(s).select("n", "reference"))


@query(f"""WITH {SAMPLES}, c AS (SELECT capture_id, n, v - median(v) OVER (PARTITION BY capture_id) AS c FROM samples),
    d AS (SELECT *, lag(c) OVER w AS last, c - lag(c) OVER w AS d FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY n)),
    m AS (SELECT capture_id, median(d) AS m FROM d GROUP BY 1), l AS (SELECT capture_id, greatest(1e-9, 6 * 1.4826 * median(abs(d - m))) AS l FROM d JOIN m USING (capture_id) WHERE d IS NOT NULL GROUP BY 1),
    a AS (SELECT *, abs(d) > l AS a FROM d JOIN l USING (capture_id) WHERE d IS NOT NULL), b AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY capture_id ORDER BY n), false) AS b FROM a)
    SELECT capture_id, count(*) FILTER (a AND NOT b) AS edge_segments, count(*) FILTER (c * last < 0) AS zero_crossings, round(sqrt(avg(d * d)), 6) AS derivative_rms FROM b GROUP BY 1""")
def q05_edge_features(spark, sf_dir):
    return events.edge_features(views.samples(spark, sf_dir))


@query(f"""WITH {SAMPLES}, z AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS size FROM samples), k AS (SELECT *, greatest(4, size // 4) AS k FROM z)
    SELECT capture_id, round(sqrt(avg(CASE WHEN n < k THEN v * v END)) / greatest(sqrt(avg(CASE WHEN n >= size - k THEN v * v END)), 1e-12), 6) AS initial_vs_final_rms FROM k GROUP BY 1""")
def q06_initial_vs_final(spark, sf_dir):
    return events.initial_vs_final(views.samples(spark, sf_dir))


VECTORS = """e AS (SELECT vec_id AS capture_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
    ref AS (SELECT label, n, avg(v) AS r FROM e GROUP BY 1, 2), x AS (SELECT capture_id, label, n, v, r FROM e JOIN ref USING (label, n)),
    c AS (SELECT *, v - median(v) OVER (PARTITION BY capture_id) AS c FROM x),
    w AS (SELECT capture_id, n, c * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS y FROM c),
    s AS (SELECT capture_id, k, sqrt(pow(sum(y * cos(2 * pi() * k * n / 64)), 2) + pow(sum(y * sin(2 * pi() * k * n / 64)), 2)) AS a FROM w, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2),
    f5 AS (SELECT capture_id, sum(a) FILTER (k <= 1) / (sum(a) + 1e-12) AS low_freq_ratio, sum(a) FILTER (k BETWEEN 2 AND 15) / (sum(a) + 1e-12) AS mid_freq_ratio, sum(a) FILTER (k >= 16) / (sum(a) + 1e-12) AS high_freq_ratio FROM s GROUP BY 1),
    f1 AS (SELECT capture_id, label::VARCHAR AS reference_label, coalesce(median(CASE WHEN abs(r) > 1e-9 THEN v / r END), 1) AS gain, sqrt(avg(v * v)) / greatest(sqrt(avg(r * r)), 1e-12) AS rms_ratio, max(abs(v)) / greatest(max(abs(r)), 1e-12) AS peak_ratio,
        coalesce(corr(v, r), 0) AS correlation, sqrt(avg((v - r) * (v - r))) / greatest(sqrt(avg(r * r)), 1e-12) AS residual_energy_ratio, sqrt(avg(CASE WHEN n < 16 THEN v * v END)) / greatest(sqrt(avg(CASE WHEN n >= 48 THEN v * v END)), 1e-12) AS initial_vs_final_rms FROM x GROUP BY 1, 2),
    d AS (SELECT capture_id, n, c, lag(c) OVER q AS last, v - lag(v) OVER q AS d FROM c WINDOW q AS (PARTITION BY capture_id ORDER BY n)),
    m AS (SELECT capture_id, median(d) AS m FROM d GROUP BY 1), l AS (SELECT capture_id, greatest(1e-9, 6 * 1.4826 * median(abs(d - m))) AS l FROM d JOIN m USING (capture_id) WHERE d IS NOT NULL GROUP BY 1),
    b AS (SELECT *, abs(d) > l AS a FROM d JOIN l USING (capture_id) WHERE d IS NOT NULL), b2 AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY capture_id ORDER BY n), false) AS b FROM b),
    f6 AS (SELECT capture_id, (count(*) FILTER (a AND NOT b))::DOUBLE AS edge_segments, (count(*) FILTER (c * last < 0))::DOUBLE AS zero_crossings, sqrt(avg(d * d)) AS derivative_rms FROM b2 GROUP BY 1),
    f AS (SELECT * FROM f1 JOIN f5 USING (capture_id) JOIN f6 USING (capture_id))"""


@query(f"WITH {VECTORS} SELECT capture_id, reference_label, {r(*FEATURES)} FROM f")
def q07_capture_features(spark, sf_dir):
    return pair_features(views.vectors(spark, sf_dir)).select("capture_id", "reference_label", *FEATURES)


SCORED = " UNION ALL ".join(f"SELECT capture_id, reference_label, '{s}' AS signature_id, '{rules.RULES[s][0]}' AS family, {rules.score_sql(s)[0]} AS matched, {rules.score_sql(s)[1]} AS confidence, CASE WHEN {rules.score_sql(s)[0]} THEN '{rules.RULES[s][3]}' ELSE '{rules.RULES[s][4]}' END AS reason FROM f" for s in rules.RULES)


@query(f"WITH {VECTORS}, t AS ({SCORED}) SELECT capture_id, reference_label, signature_id, family, matched, round(confidence, 6) AS confidence, reason FROM t")
def q08_rule_scores(spark, sf_dir):
    scored = rules.score_signatures(pair_features(views.vectors(spark, sf_dir)))
    return scored.select("capture_id", "reference_label", F.inline("scores"))


@query(f"""WITH {VECTORS}, t AS ({SCORED}), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY NOT matched, -confidence, signature_id) AS k FROM t)
    SELECT capture_id, max(CASE WHEN k = 1 AND matched THEN signature_id END) AS winner, CASE WHEN bool_or(k = 1 AND matched) THEN 'matched' ELSE 'no_match' END AS decision, max(CASE WHEN k = 1 THEN signature_id END) AS top_signature,
    round(max(CASE WHEN k = 1 THEN confidence END), 6) AS top_confidence, max(CASE WHEN k = 1 THEN reference_label END) AS best_reference FROM k GROUP BY 1""")
def q09_tournament(spark, sf_dir):
    """Each capture's winning signature: features, rules, best reference and ranking."""
    return rules.ranked(rules.score_signatures(pair_features(views.vectors(spark, sf_dir)))).drop("ranked_ids", "evidence", "rejections")


COUNTS = "count(*) FILTER (p AND q) AS tp, count(*) FILTER (NOT p AND q) AS fp, count(*) FILTER (NOT p AND NOT q) AS tn, count(*) FILTER (p AND NOT q) AS fn"


@query(f"""WITH {SCORES}, c AS (SELECT signature_id, count(*) AS total_cases, count(*) FILTER (q) AS matched_count, avg(confidence) AS mean_confidence, median(confidence) AS median_confidence, quantile_cont(confidence, 0.05) AS p05_confidence, quantile_cont(confidence, 0.95) AS p95_confidence, {COUNTS} FROM (SELECT *, truth = signature_id AS p, matched AS q FROM scores) GROUP BY 1)
    SELECT signature_id, total_cases, matched_count, {r('mean_confidence', 'median_confidence', 'p05_confidence', 'p95_confidence')}, tp, fp, tn, fn, {r('tp / nullif(tp + fn, 0) AS recall', 'tp / nullif(tp + fp, 0) AS precision', 'fp / nullif(fp + tn, 0) AS fpr', 'tn / nullif(tn + fp, 0) AS specificity', '(tp + tn) / total_cases AS accuracy')} FROM c""")
def q10_signature_summary(spark, sf_dir):
    return metrics.signature_summary(views.scores(spark, sf_dir))


@query(f"WITH {SCORES}, {DECISIONS} SELECT truth, coalesce(winner, 'none') AS predicted, count(*) AS n FROM decisions GROUP BY ALL")
def q11_confusion(spark, sf_dir):
    return metrics.confusion_matrix(views.decisions(views.scores(spark, sf_dir)))


@query(f"""WITH {SCORES}, n AS (SELECT DISTINCT signature_id AS s FROM scores), p AS (SELECT a.s AS sa, b.s AS sb FROM n a JOIN n b ON a.s < b.s),
    j AS (SELECT sa, sb, x.matched AS x, coalesce(y.matched, false) AS y, x.confidence AS ca, y.confidence AS cb FROM p JOIN scores x ON x.signature_id = sa LEFT JOIN scores y ON y.signature_id = sb AND y.capture_id = x.capture_id)
    SELECT sa AS signature_a, sb AS signature_b, count(*) AS total_cases, count(*) FILTER (x AND y) AS both_matched, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither,
    {r('avg(ca) FILTER (x AND y) AS mean_confidence_a_when_both', 'avg(cb) FILTER (x AND y) AS mean_confidence_b_when_both', 'count(*) FILTER (x AND y) / count(*) AS overlap_rate', 'count(*) FILTER (x AND y) / nullif(count(*) FILTER (x OR y), 0) AS jaccard_overlap')} FROM j GROUP BY ALL""")
def q12_overlap(spark, sf_dir):
    return metrics.overlap_matrix(views.scores(spark, sf_dir))


LONG = "unnest([{'feature': 'quantity', 'value': l_quantity}, {'feature': 'price', 'value': l_extendedprice}, {'feature': 'discount', 'value': l_discount}])"


@query(f"""SELECT signature_id, feature, count(*) AS count, {r('avg(value) AS mean', 'stddev_pop(value) AS std', 'min(value) AS min', *(f'quantile_cont(value, {q}) AS p{n}' for q, n in ((.05, '05'), (.25, '25'), (.5, '50'), (.75, '75'), (.95, '95'))), 'max(value) AS max')}
    FROM (SELECT signature_id, x.feature AS feature, x.value AS value FROM (SELECT l_returnflag AS signature_id, {LONG} AS x FROM lineitem)) GROUP BY ALL""")
def q13_feature_stats(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem")
    return metrics.feature_stats(items.selectExpr("l_returnflag AS signature_id", "stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount) AS (feature, value)"))


SWEEP = f"""c AS (SELECT signature_id, threshold, {COUNTS} FROM (SELECT signature_id, threshold, truth = signature_id AS p, confidence >= threshold AS q FROM scores, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in CUTS)}]) AS threshold)) GROUP BY ALL),
    sweep0 AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision, (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c),
    sweep AS (SELECT *, 2 * precision * tpr / nullif(precision + tpr, 0) AS f1, tpr - fpr AS youden_j, coalesce(tpr >= 0.3 AND fpr <= 0.6, false) AS deployable FROM sweep0)"""
RATES = r("threshold", "tpr", "fpr", "precision", "accuracy", "f1", "youden_j")


@query(f"WITH {SCORES}, {SWEEP} SELECT signature_id, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, (tp + fp + tn + fn)::BIGINT AS total_cases, (tp + fn)::BIGINT AS truth_cases, {RATES}, deployable FROM sweep")
def q14_threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(views.scores(spark, sf_dir), CUTS, 0.3, 0.6)


@query(f"WITH {SCORES}, {SWEEP} SELECT signature_id, tp, fp, tn, fn, tp + fp + tn + fn AS total_cases, tp + fn AS truth_cases, {RATES}, deployable FROM (SELECT *, row_number() OVER (PARTITION BY signature_id ORDER BY threshold DESC) AS k FROM sweep WHERE deployable) WHERE k = 1")
def q15_deployable(spark, sf_dir):
    return metrics.deployable_thresholds(metrics.threshold_sweep(views.scores(spark, sf_dir), CUTS, 0.3, 0.6))


CASES = "cases AS (SELECT truth, tier, truth <> 'N' AS p, coalesce(winner = truth, false) AS q FROM decisions)"


def cases(spark, sf_dir) -> DataFrame:
    d = views.decisions(views.scores(spark, sf_dir))
    return d.select("truth", "tier", (F.col("truth") != "N").alias("positive"), F.coalesce(F.col("winner") == F.col("truth"), F.lit(False)).alias("predicted"))


@query(f"""WITH {SCORES}, {DECISIONS}, {CASES}, g AS (SELECT tier, truth, count(*) AS total, {COUNTS} FROM cases GROUP BY GROUPING SETS ((), (truth), (tier), (tier, truth))),
    m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce((tp + tn) / nullif(total, 0), 0) AS accuracy FROM g)
    SELECT tier, truth, total, tp, fp, tn, fn, {r('precision', 'recall', 'specificity', 'accuracy', '(recall + specificity) / 2 AS balanced_accuracy')} FROM m""")
def q16_capture_metrics(spark, sf_dir):
    return metrics.capture_metrics(cases(spark, sf_dir), [[], ["truth"], ["tier"], ["tier", "truth"]])


@query(f"WITH {SCORES}, {DECISIONS} SELECT CASE WHEN truth = 'N' THEN 'N:negative_control' ELSE truth END AS expected, coalesce(winner, 'no_primary') AS predicted, count(*) AS n FROM decisions GROUP BY ALL")
def q17_confusion_pairs(spark, sf_dir):
    d = views.decisions(views.scores(spark, sf_dir))
    expected = F.when(F.col("truth") == "N", "N:negative_control").otherwise(F.col("truth"))
    return d.groupBy(expected.alias("expected"), F.coalesce("winner", F.lit("no_primary")).alias("predicted")).agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES}, d AS (SELECT *, CASE WHEN matched THEN 1.0 ELSE 0.25 END::DOUBLE AS ref FROM scores), g AS (SELECT *, least(1, greatest(0, confidence * (0.70 + 0.30 * ref) + CASE WHEN matched THEN 0.05 ELSE 0 END)) AS score FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, confidence DESC, ref DESC, signature_id)::INT AS rank, count(*) FILTER (matched) OVER (PARTITION BY capture_id) AS multi_match_count FROM g)
    SELECT capture_id, signature_id, {r('confidence', 'score')}, rank, CASE WHEN matched AND rank = min(CASE WHEN matched THEN rank END) OVER (PARTITION BY capture_id) THEN 'primary' WHEN matched THEN 'secondary_candidate' ELSE 'below_threshold' END AS role, multi_match_count, multi_match_count >= 2 AS ambiguous FROM k""")
def q18_diagnostic_rank(spark, sf_dir):
    ref = F.when(F.col("matched"), 1.0).otherwise(0.25)  # evidence of a result: a best reference if any line matches, else weak ones
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * (0.70 + 0.30 * ref) + F.when(F.col("matched"), 0.05).otherwise(0.0)))
    case = Window.partitionBy("capture_id")
    d = views.scores(spark, sf_dir).withColumn("ref", ref).withColumn("score", score)
    d = d.withColumn("rank", F.row_number().over(case.orderBy(F.desc("score"), F.desc("confidence"), F.desc("ref"), "signature_id"))).withColumn("multi_match_count", F.count_if("matched").over(case))
    first = F.min(F.when(F.col("matched"), F.col("rank"))).over(case)
    role = F.when(F.col("matched") & (F.col("rank") == first), "primary").when(F.col("matched"), "secondary_candidate").otherwise("below_threshold")
    return d.select("capture_id", "signature_id", "confidence", "score", "rank", role.alias("role"), "multi_match_count", (F.col("multi_match_count") >= 2).alias("ambiguous"))


@query(f"""SELECT o_orderstatus, o_orderpriority, split, count(*) AS n FROM (SELECT *, {metrics.allocation_sql('k', 'c', SHARES)} AS split FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS c FROM orders)) GROUP BY ALL""")
def q20_split_allocation(spark, sf_dir):
    """Sizes of a stratified split; membership is by hash."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return metrics.stratified_split(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", SHARES).groupBy("o_orderstatus", "o_orderpriority", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES}, {DECISIONS}, f AS (SELECT winner, unnest([struct_pack(dimension := 'tier', value := tier), struct_pack(dimension := 'truth', value := truth)]) AS x FROM decisions WHERE winner IS NOT NULL AND winner <> truth),
    g AS (SELECT winner AS signature_id, x.dimension AS dimension, x.value AS value, count(*) AS n FROM f GROUP BY ALL)
    SELECT signature_id, dimension, max(n) AS largest_bucket, sum(n)::BIGINT AS false_positives, round(max(n) / sum(n), 6) AS top_share FROM g GROUP BY ALL""")
def q24_fp_concentration(spark, sf_dir):
    wrong = views.decisions(views.scores(spark, sf_dir)).where("winner IS NOT NULL AND winner <> truth")
    long = wrong.selectExpr("winner AS signature_id", "stack(2, 'tier', tier, 'truth', truth) AS (dimension, value)")
    counts = long.groupBy("signature_id", "dimension", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("signature_id", "dimension").agg(F.max("n").alias("largest_bucket"), F.sum("n").alias("false_positives"), (F.max("n") / F.sum("n")).alias("top_share"))


@query(f"""WITH {SCORES}, {DECISIONS}, s AS (SELECT truth AS analyzer, tier, count(*) FILTER (winner = truth) AS successes, count(*) AS n FROM decisions GROUP BY ALL), b AS (SELECT *, successes + 1.0::DOUBLE AS alpha, n - successes + 1.0::DOUBLE AS beta FROM s), m AS (SELECT *, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) AS sd FROM b)
    SELECT analyzer, tier, successes, n, {r('alpha', 'beta', 'mean AS posterior_mean', 'greatest(0, mean - 1.959963984540054 * sd) AS lower', 'least(1, mean + 1.959963984540054 * sd) AS upper')} FROM m""")
def q25_beta_posterior(spark, sf_dir):
    s = views.decisions(views.scores(spark, sf_dir)).groupBy(F.col("truth").alias("analyzer"), "tier").agg(F.count_if(F.coalesce(F.col("winner") == F.col("truth"), F.lit(False))).alias("successes"), F.count("*").alias("n"))
    a, b = F.col("successes") + 1.0, F.col("n") - F.col("successes") + 1.0
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    z = 1.959963984540054
    return s.select("*", a.alias("alpha"), b.alias("beta"), mean.alias("posterior_mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("lower"), F.least(F.lit(1.0), mean + z * sd).alias("upper"))


STATE = "states AS (SELECT *, last_value(CASE WHEN v >= 60 THEN 1 WHEN v <= 40 THEN 0 WHEN n = 0 THEN CASE WHEN v >= 50 THEN 1 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS state FROM samples)"


@query(f"""WITH {SAMPLES}, {STATE}, m AS (SELECT *, lag(state) OVER w AS before, lead(t) OVER w AS next_t FROM states WINDOW w AS (PARTITION BY capture_id ORDER BY n))
    SELECT capture_id, count(*) FILTER (state = 1 AND before = 0) AS rising, count(*) FILTER (state = 0 AND before = 1) AS falling, round(coalesce(sum(CASE WHEN state = 1 THEN next_t - t END), 0), 3) AS high_s FROM m GROUP BY 1""")
def q27_schmitt(spark, sf_dir):
    return rounded(events.pulses(events.schmitt(views.samples(spark, sf_dir), 40.0, 60.0)), 3)


@query(f"""WITH {SAMPLES}, o AS (SELECT *, n - lag(n) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM samples WHERE v > 50), u AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS run FROM o)
    SELECT capture_id, run, min(n) AS start_n, max(n) AS end_n, count(*) AS length FROM u GROUP BY ALL""")
def q28_runs(spark, sf_dir):
    return events.runs(views.samples(spark, sf_dir), "v > 50", close=1)


@query(f"""WITH {SAMPLES}, o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY capture_id ORDER BY n) <= 3600 THEN 0 ELSE 1 END AS s FROM samples), g AS (SELECT *, sum(s) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS episode FROM o),
    e AS (SELECT capture_id, episode, count(*) AS events, min(t) AS start_s, max(t) AS end_s FROM g GROUP BY ALL HAVING count(*) >= 2)
    SELECT capture_id, episode, events, {r('start_s', 'end_s')}, row_number() OVER (PARTITION BY capture_id ORDER BY events DESC, end_s - start_s DESC, start_s) = 1 AS is_primary FROM e""")
def q29_episodes(spark, sf_dir):
    return events.episodes(views.samples(spark, sf_dir), 3600.0, 2)


@query(f"""WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY capture_id ORDER BY n) AS dt FROM samples), m AS (SELECT capture_id, median(dt) AS typical FROM d GROUP BY 1), o AS (SELECT *, CASE WHEN dt IS NULL OR dt > 5 * typical THEN 1 ELSE 0 END AS opens FROM d JOIN m USING (capture_id)),
    b AS (SELECT *, sum(opens) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS burst FROM o) SELECT capture_id, burst, count(*) AS events, {r('min(t) AS start_s', 'max(t) AS end_s', 'max(CASE WHEN opens = 0 THEN dt END) AS longest_gap_s')} FROM b GROUP BY ALL""")
def q30_burst_groups(spark, sf_dir):
    return events.burst_groups(views.samples(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT capture_id, n, {r('avg(v) OVER w AS moving_mean', 'sqrt(avg(v * v) OVER w) AS moving_rms')} FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def q31_moving_rms(spark, sf_dir):
    return events.moving_rms(views.samples(spark, sf_dir), 2).select("capture_id", "n", "moving_mean", "moving_rms")


@query(f"""WITH {SAMPLES}, a AS (SELECT *, min(CASE WHEN v > 20 THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = 5 AS a FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT capture_id, min(CASE WHEN a THEN n END) AS first_n, round(min(CASE WHEN a THEN t END), 6) AS first_s FROM a GROUP BY 1""")
def q32_sustained(spark, sf_dir):
    return events.sustained(views.samples(spark, sf_dir), "v > 20", 5)


@query(f"""WITH {SAMPLES}, l AS (SELECT capture_id, event_id, t FROM samples WHERE event_type = 'purchase'), q AS (SELECT capture_id, t, max(v) AS v FROM samples WHERE event_type = 'click' GROUP BY ALL)
    SELECT l.capture_id, l.event_id, {r('l.t AS t', 'CASE WHEN l.t - q.t <= 86400 THEN q.v END AS asof_v', 'CASE WHEN l.t - q.t <= 86400 THEN q.t END AS asof_t')} FROM l ASOF LEFT JOIN q ON l.capture_id = q.capture_id AND l.t >= q.t""")
def q33_asof(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    return joins.asof(s.where("event_type = 'purchase'").select("capture_id", "event_id", "t"), s.where("event_type = 'click'").select("capture_id", "t", "v"), "capture_id", "t", "v", 86400.0)


PULSES = "p AS (SELECT capture_id, event_id, event_type, t AS start_s, t + abs(v) * 3600 AS end_s FROM samples), a AS (SELECT * FROM p WHERE event_type = 'purchase'), b AS (SELECT * FROM p WHERE event_type = 'click')"


def pulse_sides(spark, sf_dir):
    p = views.samples(spark, sf_dir).selectExpr("capture_id", "event_id", "event_type", "t AS start_s", "t + abs(v) * 3600 AS end_s")
    side = lambda kind, x: p.where(f"event_type = '{kind}'").selectExpr("capture_id", f"event_id AS {x}_id", f"start_s AS {x}_start", f"end_s AS {x}_end")
    return side("purchase", "source"), side("click", "output")


@query(f"WITH {SAMPLES}, {PULSES} SELECT a.capture_id, a.event_id AS source_id, b.event_id AS output_id, round(b.start_s - a.start_s, 6) AS latency_s FROM a JOIN b ON a.capture_id = b.capture_id AND b.start_s BETWEEN a.start_s AND a.end_s")
def q34_interval_join(spark, sf_dir):
    a, b = pulse_sides(spark, sf_dir)
    return joins.interval_join(a, b, "capture_id", "source_start", "source_end", "output_start", 3600.0).selectExpr("capture_id", "source_id", "output_id", "output_start - source_start AS latency_s")


@query(f"WITH {SAMPLES}, {PULSES} SELECT b.capture_id, b.event_id AS output_id, count(*) AS sources FROM a JOIN b ON a.capture_id = b.capture_id AND a.start_s <= b.end_s AND b.start_s <= a.end_s GROUP BY ALL HAVING count(*) >= 2")
def q35_overlap_groups(spark, sf_dir):
    a, b = pulse_sides(spark, sf_dir)
    both = joins.overlap_join(a, b, "capture_id", ("source_start", "source_end"), ("output_start", "output_end"), 3600.0)
    return both.groupBy("capture_id", "output_id").agg(F.count("*").alias("sources")).where("sources >= 2")


@query(f"""WITH {SAMPLES}, {PULSES}, j AS (SELECT a.capture_id, a.event_id AS source_id, b.event_id AS o, abs(a.start_s - b.start_s) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.start_s - b.start_s), b.event_id) AS k FROM a LEFT JOIN b ON a.capture_id = b.capture_id AND abs(a.start_s - b.start_s) <= 7200)
    SELECT capture_id, source_id, o AS nearest_output_id, round(d, 6) AS distance FROM j WHERE k = 1""")
def q36_nearest_tolerance(spark, sf_dir):
    a, b = pulse_sides(spark, sf_dir)
    return joins.nearest(a, b, "capture_id", "source_id", "source_start", "output_start", 7200.0, "output_id").select("capture_id", "source_id", "nearest_output_id", "distance")


@query(f"WITH {SAMPLES} SELECT a.capture_id, round(median((b.v - a.v) / (b.t / 3600 - a.t / 3600)), 6) AS slope, count(*) AS pairs FROM samples a JOIN samples b ON a.capture_id = b.capture_id AND a.t < b.t GROUP BY ALL")
def q37_theil_sen(spark, sf_dir):
    """Slope by the hour of each capture's whole track; its pairs grow with the square of a capture."""
    return events.theil_sen(views.samples(spark, sf_dir).withColumn("h", F.col("t") / 3600), "capture_id", "h", "v")


@query(f"WITH {SAMPLES} SELECT a.capture_id, round(median((b.v - a.v) / (b.n - a.n)), 6) AS slope, count(*) AS pairs FROM samples a JOIN samples b ON a.capture_id = b.capture_id AND a.n < b.n GROUP BY ALL")
def q48_theil_sen_track(spark, sf_dir):
    """Slope by the sample of each capture's whole track."""
    return events.theil_sen(views.samples(spark, sf_dir), "capture_id", "n", "v")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, rank::INT AS rank, round(l_extendedprice, 6) AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10")
def q39_topk_per_group(spark, sf_dir):
    """Ten largest of each group; the window's limit also applies before the shuffle."""
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    items = views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return items.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("SELECT event_type, round(sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)), 6) AS coherence, round(atan2(avg(sin(a)), avg(cos(a))), 6) AS mean_angle, count(*) AS count FROM (SELECT event_type, (value - floor(value)) * 2 * pi() AS a FROM events) GROUP BY 1")
def q40_circular_coherence(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_type", ((F.col("value") - F.floor("value")) * 2 * F.pi()).alias("a"))
    return events.circular(rows, "event_type", "a")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT root, b, hops + 1 FROM w JOIN e ON node = a) SELECT root, hops, count(*) AS nodes FROM w GROUP BY ALL""")
def q42_graph_reach(spark, sf_dir):
    """Nodes by distance from each region, along region, nation and supplier edges."""
    from .operators.graph import reach

    t = lambda name: views.table(spark, sf_dir, name)
    edges = t("nation").selectExpr("concat('r', n_regionkey) AS a", "concat('n', n_nationkey) AS b").union(t("supplier").selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)"))
    found = reach(edges, t("region").selectExpr("concat('r', r_regionkey) AS root"))
    return found.groupBy("root", "hops").agg(F.count("*").alias("nodes"))


BASELINE, TUNED = {"A": 0.5, "N": 0.5, "R": 0.5}, {"A": 0.55, "N": 0.6, "R": 0.45}


def profile_metrics(profiles: dict[str, dict[str, float]]) -> str:
    """SQL: measured, the metrics of every profile by tier."""
    rows = ", ".join(f"('{p}', '{s}', {t}::DOUBLE)" for p, of in profiles.items() for s, t in of.items())
    return f"""th AS (SELECT * FROM (VALUES {rows}) AS x(profile, signature_id, threshold)), passing AS (SELECT *, confidence >= threshold AS h FROM scores JOIN th USING (signature_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY profile, capture_id ORDER BY h DESC, confidence DESC, signature_id) AS k FROM passing),
    decided AS (SELECT profile, capture_id, any_value(truth) AS truth, any_value(tier) AS tier, max(CASE WHEN k = 1 AND h THEN signature_id END) AS winner, count(*) FILTER (h) AS hits FROM placed GROUP BY ALL),
    counted AS (SELECT profile, tier, count(*) AS total, {COUNTS}, count(*) FILTER (hits >= 2) AS conflict_cases FROM (SELECT *, truth <> 'N' AS p, coalesce(winner = truth, false) AS q FROM decided) GROUP BY ALL),
    rated AS (SELECT *, (tp + tn) / total AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, conflict_cases / total AS conflict_rate FROM counted),
    measured AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS false_positive_rate, coalesce(fn / nullif(fn + tp, 0), 0) AS false_negative_rate FROM rated)"""


def measured(spark, sf_dir, profiles: dict[str, dict[str, float]]) -> DataFrame:
    d = tuning.decide(views.scores(spark, sf_dir), profiles)
    hit = F.coalesce(F.col("winner") == F.col("truth"), F.lit(False))
    return tuning.full_metrics(d.select("profile", "tier", (F.col("truth") != "N").alias("positive"), hit.alias("predicted"), (F.col("hits") >= 2).alias("conflict")), "profile", "tier")


BOTH = {"baseline": BASELINE, "tuned": TUNED}
FAMILY = {"A": "acceptance", "N": "normal", "R": "return"}


@query(f"""WITH {SCORES}, m AS (SELECT *, count(*) FILTER (matched) OVER (PARTITION BY capture_id) >= 2 AS amb, truth = signature_id AS p, matched AS q FROM scores)
    SELECT signature_id, CASE signature_id {' '.join(f"WHEN '{s}' THEN '{f}'" for s, f in FAMILY.items())} END AS family, count(*) AS total, {COUNTS}, count(*) FILTER (amb) AS ambiguous_cases FROM m GROUP BY 1""")
def q19_session_summary(spark, sf_dir):
    family = F.when(F.col("signature_id") == "A", FAMILY["A"]).when(F.col("signature_id") == "N", FAMILY["N"]).otherwise(FAMILY["R"])
    return tuning.session_summary(views.scores(spark, sf_dir), family)


@query(f"""WITH {SCORES}, {profile_metrics(BOTH)}, l AS (SELECT profile, tier, unnest([{', '.join(f"struct_pack(metric := '{m}', value := {m}::DOUBLE)" for m in tuning.METRICS)}]) AS x FROM measured),
    w AS (SELECT tier, x.metric AS metric, max(CASE WHEN profile = 'baseline' THEN x.value END) AS baseline, max(CASE WHEN profile = 'tuned' THEN x.value END) AS tuned FROM l GROUP BY ALL)
    SELECT tier, metric, {r('baseline', 'tuned', 'tuned - baseline AS delta')} FROM w""")
def q21_profile_compare(spark, sf_dir):
    return tuning.compare_profiles(measured(spark, sf_dir, BOTH), "tier", "baseline", "tuned")


@query(f"""WITH {SCORES}, {profile_metrics(BOTH)} SELECT profile, tier, {r('balanced_accuracy - 2 * greatest(0, 0.88 - precision) AS balanced_default', 'precision - 2 * greatest(0, 0.85 - recall) AS conservative_precision',
    'recall - 2 * greatest(0, 0.85 - precision) AS sensitive_fault_finding', 'f1 - 0.25 * conflict_rate AS field_triage')} FROM measured""")
def q22_objective(spark, sf_dir):
    return tuning.objectives(measured(spark, sf_dir, BOTH)).select("profile", "tier", *tuning.GATED, "field_triage")


VARIANTS = tuning.reverted(BASELINE, TUNED)


@query(f"""WITH {SCORES}, {profile_metrics(VARIANTS)} SELECT v.profile AS variant, v.tier AS tier, {r('v.precision AS precision', 'v.recall AS recall', 'v.f1 AS f1', 'v.f1 - t.f1 AS f1_change')}
    FROM measured v JOIN measured t ON t.tier = v.tier AND t.profile = 'tuned' WHERE v.profile <> 'tuned'""")
def q23_ablation(spark, sf_dir):
    """What each changed threshold contributes: all variants are evaluated in one pass."""
    tuned = F.max(F.when(F.col("profile") == "tuned", F.col("f1"))).over(Window.partitionBy("tier"))
    m = measured(spark, sf_dir, VARIANTS).withColumn("f1_change", F.col("f1") - tuned)
    return m.where("profile <> 'tuned'").select(F.col("profile").alias("variant"), "tier", "precision", "recall", "f1", "f1_change")


@query(f"""WITH {SCORES}, {SWEEP}, b AS (SELECT *, max(coalesce(youden_j, 0)) OVER (PARTITION BY signature_id) AS best FROM sweep)
    SELECT signature_id, {r('max(best) AS best_score', 'min(CASE WHEN coalesce(youden_j, 0) >= best - 0.01 THEN threshold END) AS selected_threshold', 'max(threshold) - min(threshold) AS width')}, count(*) FILTER (coalesce(youden_j, 0) >= best - 0.01) AS near_best FROM b GROUP BY 1""")
def q26_threshold_robustness(spark, sf_dir):
    return tuning.threshold_robustness(metrics.threshold_sweep(views.scores(spark, sf_dir), CUTS, 0.3, 0.6), "youden_j")


@query(f"""WITH {SAMPLES} SELECT capture_id, n, round((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0), 6) AS dv_dt FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY n)""")
def q38_gradient(spark, sf_dir):
    return events.gradient(views.samples(spark, sf_dir)).select("capture_id", "n", "dv_dt")


@query(f"""WITH s AS (SELECT l.toxic = 1 AS p, least(1, d.n_chars / 4000) AS c FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL),
    g AS (SELECT threshold, count(*) FILTER (p AND c >= threshold) AS tp, count(*) FILTER (NOT p AND c >= threshold) AS fp, count(*) FILTER (NOT p AND c < threshold) AS tn, count(*) FILTER (p AND c < threshold) AS fn FROM s, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in CUTS)}]) AS threshold) GROUP BY 1)
    SELECT {r('threshold')}, tp, fp, tn, fn, {r('tp / nullif(tp + fn, 0) AS tpr', 'fp / nullif(fp + tn, 0) AS fpr')} FROM g""")
def q41_label_thresholds(spark, sf_dir):
    """A document's length as the score of its toxic label, over all thresholds."""
    docs, labels = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), views.table(spark, sf_dir, "labels").where("toxic IS NOT NULL")
    scored = labels.join(docs, "doc_id").where("n_chars IS NOT NULL").selectExpr("'toxic' AS signature_id", "if(toxic = 1, 'toxic', 'other') AS truth", "least(1e0, n_chars / 4000) AS confidence")
    sweep = metrics.threshold_sweep(scored, CUTS)
    return sweep.select("threshold", *(F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")), "tpr", "fpr")


@query(f"""WITH {SAMPLES}, m AS (SELECT *, CASE WHEN bool_and(coalesce(v >= 50, false)) OVER a AND count(*) OVER a = 2 THEN 1 WHEN bool_and(coalesce(v <= 30, true)) OVER b AND count(*) OVER b = 3 THEN 0 END AS mark FROM samples
        WINDOW a AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), b AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS state FROM m), p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY capture_id ORDER BY n), 0) AS before FROM s),
    e AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n)::BIGINT AS event FROM p),
    g AS (SELECT capture_id, event, min(n) - 1 AS start_n, max(CASE WHEN state = 0 THEN n - 2 END) AS closed_n, max(n) AS last_n FROM e WHERE state = 1 OR before = 1 GROUP BY ALL)
    SELECT capture_id, event, start_n, coalesce(closed_n, last_n) AS end_n, closed_n IS NULL AS is_open FROM g WHERE coalesce(closed_n, last_n) - start_n >= 2""")
def q43_hysteresis(spark, sf_dir):
    return events.hysteresis(views.samples(spark, sf_dir), 50.0, 30.0, 2, 3, 2)


@query(f"""WITH RECURSIVE {SAMPLES}, r AS (SELECT capture_id, event_id AS id, t, row_number() OVER (PARTITION BY capture_id ORDER BY t, event_id) AS k FROM samples WHERE event_type = 'purchase'),
    l AS (SELECT capture_id, list(struct_pack(t := t, id := event_id)) AS c FROM samples WHERE event_type = 'click' GROUP BY 1),
    w AS (SELECT capture_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS reference_id, NULL::STRUCT(d DOUBLE, t DOUBLE, id BIGINT) AS best FROM l
        UNION ALL SELECT capture_id, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.id) END, id, best FROM (SELECT w.capture_id, r.k, w.used, r.id,
            list_sort(list_transform(list_filter(l.c, lambda x: abs(x.t - r.t) <= 7200 AND NOT list_contains(w.used, x.id)), lambda x: struct_pack(d := abs(x.t - r.t), t := x.t, id := x.id)))[1] AS best
            FROM w JOIN r ON r.capture_id = w.capture_id AND r.k = w.k + 1 JOIN l ON l.capture_id = w.capture_id))
    SELECT capture_id, reference_id, best.id AS candidate_id, round(best.d, 6) AS lag_s FROM w WHERE best IS NOT NULL""")
def q44_greedy_match(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    side = lambda kind: s.where(f"event_type = '{kind}'").selectExpr("capture_id", "event_id AS id", "t")
    return events.greedy_match(side("purchase"), side("click"), 7200.0)


@query()
def q45_bootstrap(spark, sf_dir):
    return tuning.bootstrap(cases(spark, sf_dir).withColumn("conflict", F.lit(False)), "tier")


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT capture_id, t, row_number() OVER (PARTITION BY capture_id ORDER BY t) AS i FROM samples),
    z AS (SELECT a.capture_id, a.i, a.t, count(*) AS k, max(b.t) AS end_s FROM o a JOIN o b ON a.capture_id = b.capture_id AND b.i >= a.i AND b.t <= a.t + 86400 GROUP BY ALL),
    w AS (SELECT capture_id, i, t, k, end_s FROM z WHERE i = 1 UNION ALL SELECT z.capture_id, z.i, z.t, z.k, z.end_s FROM w JOIN z ON z.capture_id = w.capture_id AND z.i = CASE WHEN w.k >= 3 THEN w.i + w.k ELSE w.i + 1 END)
    SELECT capture_id, round(t, 6) AS start_s, round(end_s, 6) AS end_s, k AS edges FROM w WHERE k >= 3""")
def q47_chatter_windows(spark, sf_dir):
    return events.chatter(views.samples(spark, sf_dir), 86400.0, 3)


from . import kernels, reports, roundtrips  # noqa: E402, F401 - they add their queries
