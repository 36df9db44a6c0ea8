"""Queries over captures and their references (alignment, spectra, propagation) and over ranks, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import REFERENCE, VECTORS, query, r
from .functions.features import pair_features
from .operators import alignment, events, propagation, ranks
from .operators.quantiles import quantiles
from .plans import analyzers, views
from .plans.views import SAMPLES


def reference_pairs(spark, sf_dir) -> DataFrame:
    """Each capture's samples against the ensemble's median waveform."""
    s = views.samples(spark, sf_dir)
    return s.join(events.pointwise_reference(s).select("n", "reference"), "n").select("capture_id", "n", F.col("reference").alias("x"), F.col("v").alias("y"))


PAIRS = f"{SAMPLES}, {REFERENCE}, pairs AS MATERIALIZED (SELECT capture_id, n, r - avg(r) OVER c AS x, v - avg(v) OVER c AS y, avg(r) OVER c AS mx, avg(v) OVER c AS my, count(*) OVER c AS size FROM samples JOIN reference USING (n) WINDOW c AS (PARTITION BY capture_id))"
WIDTHS = (5, 9)


def _affine(width: int) -> str:
    half = width // 2
    mean = lambda e, name: f"(sum({e}) OVER w + greatest(0, {half} - n) * first_value({e}) OVER c + greatest(0, n + {half} - size + 1) * last_value({e}) OVER c) / {width} AS {name}"
    return f"""m{width} AS (SELECT capture_id, n, size, mx, my, {mean('x', 'ax')}, {mean('y', 'ay')}, {mean('x * x', 'axx')}, {mean('y * y', 'ayy')}, {mean('x * y', 'axy')} FROM pairs
            WINDOW w AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), c AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        v{width} AS (SELECT *, greatest(axx - ax * ax, 0) AS vx, greatest(ayy - ay * ay, 0) AS vy, axy - ax * ay AS cov FROM m{width}),
        f{width} AS (SELECT capture_id, greatest(0.03 * median(vx), 1e-9) AS floor FROM v{width} GROUP BY 1),
        k{width} AS (SELECT *, vx > floor AND n >= {half} AND n < size - {half} AS valid, cov / (vx + 1e-9) AS b FROM v{width} JOIN f{width} USING (capture_id)),
        a{width} AS (SELECT capture_id, n, {width} AS width, CASE WHEN valid THEN b END AS gain, CASE WHEN valid THEN ay + my - b * (ax + mx) END AS "offset", CASE WHEN valid THEN least(1, greatest(-1, cov / (sqrt(vx * vy) + 1e-9))) END AS correlation,
            CASE WHEN valid THEN sqrt(vy + pow(ay + my, 2)) / (sqrt(vx + pow(ax + mx, 2)) + 1e-9) END AS rms_ratio, valid FROM k{width})"""


@query(f"""WITH {PAIRS}, {', '.join(map(_affine, WIDTHS))} SELECT capture_id, n, width, {r('gain', '"offset" AS "offset"', 'correlation', 'rms_ratio')}, valid FROM ({' UNION ALL '.join(f'SELECT * FROM a{w}' for w in WIDTHS)})""")
def q99_local_affine(spark, sf_dir):
    """Sliding least squares of each capture against the ensemble's waveform, at two widths."""
    pairs = reference_pairs(spark, sf_dir)
    return reduce(DataFrame.unionByName, (alignment.local_affine(pairs, w).withColumn("width", F.lit(w)) for w in WIDTHS))


LAGS = 8
LAGGED = f"{PAIRS}, s AS (SELECT a.capture_id, b.n - a.n AS lag, count(*) AS m, sum(a.x) AS sx, sum(b.y) AS sy, sum(a.x * a.x) AS sxx, sum(b.y * b.y) AS syy, sum(a.x * b.y) AS sxy FROM pairs a JOIN pairs b ON a.capture_id = b.capture_id AND b.n - a.n BETWEEN -{LAGS} AND {LAGS} GROUP BY ALL)"


@query(f"""WITH {LAGGED}, c AS (SELECT capture_id, lag, (sxy - sx * sy / m) / (sqrt(greatest(sxx - sx * sx / m, 0) * greatest(syy - sy * sy / m, 0)) + 1e-12) AS c FROM s WHERE m >= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY c DESC, lag) AS k FROM c) SELECT capture_id, lag::INT AS lag, round(c, 6) AS correlation FROM k WHERE k = 1""")
def q100_best_lag(spark, sf_dir):
    """Samples by which each capture lags the ensemble's waveform, by correlation."""
    return alignment.best_lag(reference_pairs(spark, sf_dir), LAGS)


@query(f"""WITH {LAGGED}, f AS (SELECT *, sxy / (sxx + 1e-18) AS k FROM s), g AS (SELECT *, 1 - (syy - 2 * k * sxy + k * k * sxx) / (syy - sy * sy / m + 1e-18) AS r2, pow(sxy / (sqrt(sxx * syy) + 1e-18), 2) AS wc2 FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY r2 + 0.25 * wc2 DESC, lag) AS i FROM g) SELECT capture_id, {r('k AS gain', 'greatest(-1, least(1, r2)) AS r2', 'lag / 50.0 AS lag_s', 'wc2')} FROM o WHERE i = 1""")
def q101_best_lag_gain(spark, sf_dir):
    """Lag and unknown gain of each capture against the ensemble's waveform, at 50 samples a second."""
    return alignment.best_lag_gain(reference_pairs(spark, sf_dir), LAGS, 50.0)


@query("""WITH q AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rank_correlation FROM q GROUP BY 1""")
def q102_rank_correlation(spark, sf_dir):
    """Rank correlation of quantity and discount by return flag; both are full of ties."""
    return ranks.rank_correlation(views.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query("""SELECT event_type, user_id, n, average_rank FROM (SELECT event_type, user_id, count(*) OVER (PARTITION BY event_type) AS n, rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2.0 AS average_rank, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events) WHERE i = 1""")
def q103_average_ranks(spark, sf_dir):
    """Average rank of each user's first event of a type among all values of the type."""
    rows = views.table(spark, sf_dir, "events").withColumn("v", F.round("value"))
    first = rows.groupBy("event_type", "user_id").agg(F.min_by("v", F.struct("ts", "event_id")).alias("v"))
    placed = ranks.average_ranks(rows, ["event_type"], "v").select(F.col("__g.event_type").alias("event_type"), F.col("__v").alias("v"), F.col("__rank").alias("average_rank"), F.col("__size").alias("n"))
    return first.join(placed, ["event_type", "v"]).select("event_type", "user_id", "n", "average_rank")


RATE, BAND = 3200.0, (5.0, 1600.0)


def channel_pairs(spark, sf_dir) -> DataFrame:
    """Vectors as two channels, their even and odd components, less the label's mean; a label is an ensemble."""
    v = views.vectors(spark, sf_dir).withColumn("r", F.expr("zip_with(primary, reference, (a, b) -> a - b)"))
    half = lambda j: F.expr(f"transform(sequence(0, size(r) DIV 2 - 1), i -> r[2 * i + {j}])")
    return v.select(F.col("reference_label").alias("ensemble"), "capture_id", half(0).alias("r1"), half(1).alias("r2"))


SPECTRUM = f"""e AS (SELECT vec_id AS capture_id, label::VARCHAR AS ensemble, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
    x AS (SELECT capture_id, ensemble, n % 2 + 1 AS ch, n // 2 AS i, v - avg(v) OVER (PARTITION BY ensemble, n) AS v FROM e),
    y AS (SELECT capture_id, ensemble, ch, i, (v - avg(v) OVER (PARTITION BY capture_id, ch)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM x),
    f AS (SELECT capture_id, ensemble, ch, k, sum(y * cos(2 * pi() * k * i / 32)) AS re, -sum(y * sin(2 * pi() * k * i / 32)) AS im FROM y, (SELECT unnest(range(17)) AS k) GROUP BY ALL),
    g AS (SELECT a.capture_id, a.ensemble, a.k, a.k * {RATE} / 32 AS hz, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2, sqrt(a.re * a.re + a.im * a.im) / 16 * w AS a1, sqrt(b.re * b.re + b.im * b.im) / 16 * w AS a2
        FROM (SELECT *, CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS w FROM f WHERE ch = 1) a JOIN f b ON a.capture_id = b.capture_id AND a.k = b.k AND b.ch = 2),
    c AS MATERIALIZED (SELECT ensemble, k, hz, count(*) AS captures, avg(a1) AS mean_a1, avg(a2) AS mean_a2, avg(re1 * re2 + im1 * im2) AS re, avg(re1 * im2 - im1 * re2) AS im, avg(re1 * re1 + im1 * im1) AS s1, avg(re2 * re2 + im2 * im2) AS s2 FROM g GROUP BY ALL),
    spectrum AS (SELECT *, (re * re + im * im) / greatest(s1 * s2, 2.220446049250313e-16) AS coherence, degrees(atan2(im, re)) AS phase_deg FROM c)"""


@query(f"WITH {SPECTRUM} SELECT ensemble, k::INT AS k, captures, {r('hz', 'mean_a1', 'mean_a2', 'coherence')}, round(cos(radians(phase_deg)), 6) AS phase_cos, round(sin(radians(phase_deg)), 6) AS phase_sin FROM spectrum")
def q104_cross_spectrum(spark, sf_dir):
    """Coherence and phase of two channels at each spectral line over a label's captures."""
    from .operators import spectra

    out = spectra.cross_spectrum(spectra.lines(channel_pairs(spark, sf_dir), RATE))
    return out.select("ensemble", "k", "captures", "hz", "mean_a1", "mean_a2", "coherence", F.cos(F.radians("phase_deg")).alias("phase_cos"), F.sin(F.radians("phase_deg")).alias("phase_sin"))


@query(f"""WITH {SPECTRUM}, m AS (SELECT *, greatest(mean_a1, mean_a2) AS v, median(greatest(mean_a1, mean_a2)) OVER (PARTITION BY ensemble) AS floor FROM spectrum WHERE hz BETWEEN {BAND[0]} AND {BAND[1]}),
    t AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM m WINDOW w AS (PARTITION BY ensemble ORDER BY k)), p AS (SELECT * FROM t WHERE before < v AND after < v AND v >= 1.0 * floor),
    o AS (SELECT p.ensemble, p.k, coalesce(max(m.k) FILTER (m.k < p.k AND m.v > p.v), -1) AS lo, coalesce(min(m.k) FILTER (m.k > p.k AND m.v > p.v), 999) AS hi FROM p JOIN m USING (ensemble) GROUP BY ALL),
    q AS (SELECT p.ensemble, p.k FROM p JOIN o USING (ensemble, k) JOIN m ON m.ensemble = p.ensemble AND m.k BETWEEN lo AND hi GROUP BY p.ensemble, p.k, p.v, p.floor HAVING p.v - greatest(min(m.v) FILTER (m.k <= p.k), min(m.v) FILTER (m.k >= p.k)) >= 0.02 * p.floor),
    l AS (SELECT ensemble, capture_id, median(a1) AS f1, median(a2) AS f2 FROM g WHERE hz BETWEEN {BAND[0]} AND {BAND[1]} GROUP BY ALL),
    z AS (SELECT g.ensemble, g.k, a1 > 1.2 * f1 AS on1, a2 > 1.2 * f2 AS on2, a2 / greatest(a1, 2.220446049250313e-16) AS ratio FROM g JOIN q USING (ensemble, k) JOIN l USING (ensemble, capture_id)),
    s AS (SELECT ensemble, k, avg(on1::INT) AS occupancy1, avg(on2::INT) AS occupancy2, median(ratio) FILTER (on1) AS gain FROM z GROUP BY ALL), d AS (SELECT z.ensemble, z.k, median(abs(ratio - gain)) AS mad FROM z JOIN s USING (ensemble, k) WHERE on1 GROUP BY ALL)
    SELECT ensemble, {r('hz', 'mean_a1', 'mean_a2', 'gain', 'mad / gain AS gain_mad', 'coherence', 'occupancy1', 'occupancy2')}, CASE WHEN coherence >= 0.85 AND occupancy1 >= 0.5 AND occupancy2 >= 0.5 AND abs(phase_deg) <= 20 THEN 'common-mode'
        WHEN coherence >= 0.85 AND occupancy1 >= 0.5 AND occupancy2 >= 0.5 AND abs(phase_deg) >= 160 THEN 'differential / opposite-polarity' WHEN occupancy1 >= 0.5 AND occupancy2 < 0.25 THEN 'channel 1 local' WHEN occupancy2 >= 0.5 AND occupancy1 < 0.25 THEN 'channel 2 local'
        WHEN coherence >= 0.85 THEN 'shared, non-common phase relation' ELSE 'unclassified residual' END AS label FROM q JOIN spectrum USING (ensemble, k) JOIN s USING (ensemble, k) LEFT JOIN d USING (ensemble, k)""")
def q105_common_mode(spark, sf_dir):
    """Classes of the spectral peaks of each label's captures (random data: low limits)."""
    from .operators import spectra

    return spectra.common_mode(channel_pairs(spark, sf_dir), RATE, BAND, height=1.0, prominence=0.02, distance_hz=1.0, occupied=1.2).drop("phase_deg")


#: Purchases as source pulses and clicks as outputs, hours long; a sample each five hours.
WAY = propagation.Path(threshold=100.0, rate=1 / 18_000, latency_max_s=21_600.0, late_s=86_400.0, slack_s=43_200.0, before_s=600.0, look_back_s=432_000.0)


def sent(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = views.samples(spark, sf_dir)
    side = lambda kind: s.where(f"event_type = '{kind}'").selectExpr("capture_id", "event_id AS id", "t AS rise_s", "t + abs(v) * 3600 AS fall_s", "abs(v) * 3600 AS width_s")
    amplitude = quantiles(s.where("event_type = 'purchase'"), ["capture_id"], "v", [0.01, 0.99]).select("capture_id", (F.col("q")[1] - F.col("q")[0]).alias("amplitude"))
    base = quantiles(s, ["capture_id"], "v", [0.05]).select("capture_id", F.col("q")[0].alias("base"))
    return side("purchase"), side("click"), s.select("capture_id", "t", "v"), base.join(amplitude, "capture_id", "left").select("capture_id", "amplitude", "base")


WAYS = f"""{SAMPLES}, src AS (SELECT capture_id, event_id AS id, t AS rise, t + abs(v) * 3600 AS fall, abs(v) * 3600 AS width FROM samples WHERE event_type = 'purchase'), outs AS (SELECT capture_id, event_id AS output, t AS o_rise, t + abs(v) * 3600 AS o_fall, abs(v) * 3600 AS o_width FROM samples WHERE event_type = 'click'),
    sc AS (SELECT capture_id, quantile_cont(v, 0.99) FILTER (event_type = 'purchase') - quantile_cont(v, 0.01) FILTER (event_type = 'purchase') AS amplitude, quantile_cont(v, 0.05) AS base FROM samples GROUP BY 1),
    near AS (SELECT src.capture_id, src.id, s.v, s.t >= rise - 600 AS after FROM src JOIN samples s ON s.capture_id = src.capture_id AND s.t BETWEEN rise - 600 - 432000 AND rise + 86400),
    lv AS (SELECT capture_id, id, max(v) FILTER (after) AS peak, median(v) FILTER (NOT after) AS baseline FROM near GROUP BY ALL), mad AS (SELECT near.capture_id, near.id, 1.4826 * median(abs(v - baseline)) AS mad FROM near JOIN lv USING (capture_id, id) WHERE NOT after GROUP BY ALL),
    held AS (SELECT src.capture_id, src.id, output, o_rise, count(*) OVER (PARTITION BY src.capture_id, output) AS k FROM src JOIN outs ON outs.capture_id = src.capture_id AND o_rise <= rise + 43200 AND o_fall >= fall + 21600 - 43200),
    mg AS (SELECT capture_id, id, arg_min(output, (o_rise, output)) AS merged FROM held WHERE k >= 2 GROUP BY ALL),
    pr AS (SELECT src.capture_id, src.id, output, o_rise, o_width, o_rise <= rise + 21600 AS due FROM src JOIN outs ON outs.capture_id = src.capture_id AND o_rise BETWEEN rise AND rise + 86400),
    met AS (SELECT capture_id, id, count(*) FILTER (due) AS n, string_agg(output::VARCHAR, ',' ORDER BY o_rise, output) FILTER (due) AS dues, arg_min(output, (o_rise, output)) FILTER (due) AS first_due, arg_min(output, (o_rise, output)) FILTER (NOT due) AS late FROM pr GROUP BY ALL),
    a AS (SELECT src.*, coalesce(n, 0) AS n, dues, late, merged, coalesce(merged, first_due, late) AS pick, coalesce(peak, 0) AS peak, coalesce(baseline, 0) AS baseline, greatest(coalesce(mad, 0), 1e-12) AS noise, coalesce(amplitude, 0) AS amplitude, base, median(width) OVER (PARTITION BY src.capture_id) / 2 AS lim,
        CASE WHEN width / 18000 < 2 THEN 'inadequate' WHEN width / 18000 < 5 THEN 'limited' WHEN width / 18000 < 10 THEN 'usable' ELSE 'strong' END AS acquisition
        FROM src LEFT JOIN met USING (capture_id, id) LEFT JOIN mg USING (capture_id, id) LEFT JOIN lv USING (capture_id, id) LEFT JOIN mad USING (capture_id, id) LEFT JOIN sc USING (capture_id)),
    b AS (SELECT a.*, o_rise, o_rise - rise AS latency_s, o_width, o_width / greatest(width, 1e-12) AS width_ratio FROM a LEFT JOIN outs ON outs.capture_id = a.capture_id AND outs.output = pick),
    c AS MATERIALIZED (SELECT *, CASE WHEN merged IS NOT NULL THEN 'pulse merging' WHEN n > 1 THEN 'pulse splitting' WHEN pick IS NULL THEN CASE WHEN acquisition = 'inadequate' THEN 'possible acquisition miss' WHEN peak - baseline <= greatest(5 * noise, 0.03 * amplitude) THEN 'complete pulse non-propagation'
        WHEN peak < 100 THEN 'subthreshold pulse suppression' ELSE 'unresolved pulse miss' END WHEN n = 0 THEN 'late pulse propagation' WHEN o_width < lim OR width_ratio < 0.5 THEN 'pulse-width collapse' WHEN width_ratio > 1.5 THEN 'pulse stretching' ELSE 'valid pulse propagation' END AS outcome,
        CASE WHEN merged IS NOT NULL THEN merged::VARCHAR WHEN n > 1 THEN dues ELSE coalesce(pick::VARCHAR, '') END AS matched, CASE WHEN amplitude - base > 0 AND peak - base > 0 THEN (peak - base) / (amplitude - base) END AS ratio FROM b),
    d AS (SELECT *, CASE WHEN outcome IN ('complete pulse non-propagation', 'subthreshold pulse suppression', 'possible acquisition miss', 'unresolved pulse miss') AND ratio < 0.98 THEN -width / ln(greatest(1e-12, 1 - ratio)) END AS tau_s FROM c)"""


@query(f"""WITH {WAYS}, rg AS (SELECT d.capture_id, d.id, s.t, s.v - base AS s, count(*) OVER (PARTITION BY d.capture_id, d.id) AS c FROM d JOIN samples s ON s.capture_id = d.capture_id AND s.t BETWEEN o_rise AND o_rise + 43200 WHERE outcome = 'pulse splitting'),
    rt AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a FROM rg WINDOW w AS (PARTITION BY capture_id, id ORDER BY t)), tp AS (SELECT *, lead(s) OVER (PARTITION BY capture_id, id ORDER BY t) AS nx FROM rt WHERE c >= 20 AND s > b AND s >= a AND s > 0),
    rq AS (SELECT capture_id, id, median(ln(s / nx)) AS dd, count(*) AS k FROM tp WHERE s > nx GROUP BY ALL), qq AS (SELECT capture_id, id, pi() / sqrt(dd * dd + 1e-12) AS q FROM rq WHERE k >= 2 AND dd > 0)
    SELECT capture_id, id, outcome, CASE WHEN outcome IN ('pulse merging', 'pulse splitting') THEN CASE WHEN acquisition IN ('strong', 'usable') THEN 'high' ELSE 'limited' END WHEN outcome = 'possible acquisition miss' THEN 'unresolved' WHEN outcome = 'subthreshold pulse suppression' THEN CASE WHEN (peak - baseline) / noise >= 8 THEN 'high' ELSE 'moderate' END
        WHEN outcome = 'unresolved pulse miss' THEN 'moderate' ELSE CASE WHEN acquisition = 'strong' THEN 'high' ELSE 'moderate' END END AS confidence, acquisition, matched, {r('latency_s', 'width_ratio', 'peak', 'tau_s', '1 / (2 * pi() * tau_s) AS cutoff_hz', 'CASE WHEN q BETWEEN 0.2 AND 100 THEN q END AS q')} FROM d LEFT JOIN qq USING (capture_id, id)""")
def q106_pulse_outcomes(spark, sf_dir):
    """What became of each purchase (source pulse) among the capture's clicks (outputs)."""
    return propagation.outcomes(*sent(spark, sf_dir), WAY).drop("mechanism")


@query(f"""WITH {WAYS}, u AS (SELECT capture_id, outcome, matched, unnest(string_split(matched, ',')) AS output FROM d WHERE matched <> ''), k AS (SELECT capture_id, count(DISTINCT output) AS used, count(DISTINCT CASE WHEN outcome = 'pulse merging' THEN matched END) AS merged_groups FROM u GROUP BY 1),
    m AS (SELECT capture_id, outcome, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, outcome) AS i FROM d GROUP BY capture_id, outcome), z AS (SELECT capture_id, count(*) AS outputs FROM outs GROUP BY 1)
    SELECT d.capture_id, count(*) AS expected, count(*) FILTER (NOT miss) AS matched, count(*) FILTER (miss) AS missed, count(*) FILTER (d.outcome = 'pulse splitting') AS split, coalesce(any_value(merged_groups), 0) AS merged_groups, coalesce(any_value(outputs), 0) - coalesce(any_value(used), 0) AS extra_outputs,
        round(count(*) FILTER (NOT miss) / count(*), 6) AS detection_ratio, count(*) FILTER (acquisition IN ('inadequate', 'limited')) AS acquisition_limited, any_value(m.outcome) AS dominant
        FROM (SELECT *, outcome IN ('complete pulse non-propagation', 'subthreshold pulse suppression', 'possible acquisition miss', 'unresolved pulse miss') AS miss FROM d) d LEFT JOIN k USING (capture_id) LEFT JOIN z USING (capture_id) JOIN m ON m.capture_id = d.capture_id AND i = 1 GROUP BY d.capture_id""")
def q107_propagation_summary(spark, sf_dir):
    """Each capture's counts of outcomes."""
    sources, outputs, signal, scales = sent(spark, sf_dir)
    return propagation.summary(propagation.outcomes(sources, outputs, signal, scales, WAY), outputs)


def loud(batch):
    return batch.assign(matched=batch.rms_ratio >= 1, confidence=(batch.rms_ratio / 2).clip(0, 1), reason="louder than its reference")[["capture_id", "matched", "confidence", "reason"]]


def peaky(batch):
    """Two modes: above and below the reference's peak."""
    import pandas as pd

    up = batch.assign(mode="over", matched=batch.peak_ratio > 1.1, confidence=(batch.peak_ratio / 3).clip(0, 1))
    down = batch.assign(mode="under", matched=batch.peak_ratio < 0.9, confidence=(1 - batch.peak_ratio).clip(0, 1))
    return pd.concat([up, down])[["capture_id", "mode", "matched", "confidence"]]


def fragile(batch):
    """Cannot take captures whose number ends in 7."""
    if (batch.capture_id % 10 == 7).any():
        raise ValueError("ends in 7")
    return batch.assign(matched=batch.correlation > 0, confidence=batch.correlation.clip(0, 1))[["capture_id", "matched", "confidence"]]


def own_signatures() -> analyzers.Registry:
    registry = analyzers.Registry()
    registry.register_signature("loud", "level", loud)
    registry.register_signature("peaky", "level", peaky)
    registry.register_signature("fragile", "shape", fragile)
    return registry


ANALYZED = f"""{VECTORS}, modes_of AS (SELECT capture_id, 'loud' AS signature_id, NULL AS mode, rms_ratio >= 1 AS matched, least(1, greatest(0, rms_ratio / 2)) AS confidence, NULL AS error FROM f
    UNION ALL SELECT capture_id, 'peaky', 'over', peak_ratio > 1.1, least(1, greatest(0, peak_ratio / 3)), NULL FROM f UNION ALL SELECT capture_id, 'peaky', 'under', peak_ratio < 0.9, least(1, greatest(0, 1 - peak_ratio)), NULL FROM f
    UNION ALL SELECT capture_id, 'fragile', NULL, capture_id % 10 <> 7 AND correlation > 0, CASE WHEN capture_id % 10 = 7 THEN 0 ELSE least(1, greatest(0, correlation)) END, CASE WHEN capture_id % 10 = 7 THEN 'x' END FROM f),
    best_of AS (SELECT *, row_number() OVER (PARTITION BY capture_id, signature_id ORDER BY NOT matched, -confidence, coalesce(mode, '')) AS k, count(*) OVER (PARTITION BY capture_id, signature_id) AS modes FROM modes_of)"""


@query(f"WITH {ANALYZED} SELECT capture_id, signature_id, mode, matched, round(confidence, 6) AS confidence, error IS NOT NULL AS failed, modes FROM best_of WHERE k = 1")
def q108_own_analyzers(spark, sf_dir):
    """Registered analyzers with modes and failures: each capture's best mode of each signature."""
    found = analyzers.analyze(pair_features(views.vectors(spark, sf_dir)), own_signatures())
    return analyzers.best_modes(found).select("capture_id", "signature_id", "mode", "matched", "confidence", F.col("error").isNotNull().alias("failed"), "modes")


@query(f"""WITH {ANALYZED}, top_of AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY NOT matched, -confidence, signature_id) AS i FROM best_of WHERE k = 1)
    SELECT capture_id, max(CASE WHEN i = 1 AND matched THEN signature_id END) AS winner, CASE WHEN bool_or(i = 1 AND matched) THEN 'matched' ELSE 'no_match' END AS decision, max(CASE WHEN i = 1 THEN signature_id END) AS top_signature, round(max(CASE WHEN i = 1 THEN confidence END), 6) AS top_confidence, count(*) AS signatures, count(error) AS errors FROM top_of GROUP BY 1""")
def q109_own_decisions(spark, sf_dir):
    return analyzers.decide(analyzers.best_modes(analyzers.analyze(pair_features(views.vectors(spark, sf_dir)), own_signatures())))


@query(f"""WITH {SAMPLES}, m AS (SELECT *, CASE WHEN v >= 80 THEN 1 WHEN v <= 30 THEN 0 WHEN n = 0 THEN CASE WHEN v >= 55 THEN 1 ELSE 0 END END AS mark FROM samples), s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS state FROM m),
    e AS (SELECT *, lag(state) OVER (PARTITION BY capture_id ORDER BY n) AS was FROM s), p AS (SELECT *, sum(CASE WHEN state = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS pulse FROM e)
    SELECT capture_id, pulse::BIGINT AS pulse, {r('min(t) AS start_s', 'min(CASE WHEN state = 0 AND was = 1 THEN t END) AS end_s', 'max(CASE WHEN state = 1 THEN v END) AS peak')} FROM p WHERE pulse > 0 GROUP BY capture_id, pulse HAVING count(*) FILTER (state = 0 AND was = 1) > 0""")
def q110_pulse_table(spark, sf_dir):
    """Pulses by a table function over partitions."""
    analyzers.register_pulse_table(spark, "wavelens_pulses", 30.0, 80.0)
    return spark.sql("SELECT * FROM wavelens_pulses(TABLE({samples}) PARTITION BY capture_id ORDER BY n)", samples=views.samples(spark, sf_dir).select("capture_id", "n", "t", "v"))
