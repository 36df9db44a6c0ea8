"""Planted pulses of each of the ten outcomes."""

import math

import numpy as np
import pytest

from wavelens.operators import propagation

RATE = 10_000.0
WAY = propagation.Path(threshold=0.5, rate=RATE)


def scene(spark):
    """A capture for each outcome: a source of 1 ms at 0.2 s (10 samples), what the output does, and noise of 0.001."""
    rng = np.random.default_rng(3)
    sources, outputs, signal, scales = [], [], [], []
    plans = {
        "valid pulse propagation": ([(0, 1.0)], [(0.5, 1.1)], 1.0), "late pulse propagation": ([(0, 1.0)], [(9, 1.0)], 1.0), "pulse-width collapse": ([(0, 1.0)], [(0.5, 0.3)], 1.0), "pulse stretching": ([(0, 1.0)], [(0.5, 4.0)], 1.0),
        "pulse splitting": ([(0, 1.0)], [(0.5, 0.6), (2, 0.6)], 1.0), "pulse merging": ([(0, 1.0), (3, 1.0)], [(0.5, 9.0)], 1.0), "complete pulse non-propagation": ([(0, 1.0)], [], 0.0), "subthreshold pulse suppression": ([(0, 1.0)], [], 0.3),
        "possible acquisition miss": ([(0, 0.1)], [], 0.0), "unresolved pulse miss": ([(0, 1.0)], [], 0.9),
    }
    for capture, (name, (ins, outs, level)) in enumerate(plans.items()):
        sources += [(capture, i, 0.2 + a / 1e3, 0.2 + (a + w) / 1e3) for i, (a, w) in enumerate(ins)]
        outputs += [(capture, 10 + i, 0.2 + a / 1e3, 0.2 + (a + w) / 1e3) for i, (a, w) in enumerate(outs)]
        for k in range(3000):
            t = k / RATE
            on = any(0.2 + a / 1e3 <= t < 0.2 + (a + w) / 1e3 for a, w in outs) or not outs and 0.2 <= t < 0.201
            signal.append((capture, t, float(level * on + rng.normal(0, 0.001))))
        scales.append((capture, 1.0, 0.0))
    kind = "capture_id long, id long, rise_s double, fall_s double"
    return list(plans), [spark.createDataFrame(x, k) for x, k in ((sources, kind), (outputs, kind), (signal, "capture_id long, t double, v double"), (scales, "capture_id long, amplitude double, base double"))]


def test_ten_outcomes(spark):
    names, frames = scene(spark)
    rows = propagation.outcomes(*frames, WAY).orderBy("capture_id", "id").collect()
    got = {}
    for r in rows:
        got.setdefault(r.capture_id, []).append(r)
    assert [r.outcome for c in sorted(got) for r in got[c]] == [n for n in names for _ in range(2 if n == "pulse merging" else 1)]
    by = {names[c]: rs[0] for c, rs in got.items()}
    assert (by["pulse splitting"].matched, by["pulse merging"].matched, by["valid pulse propagation"].matched, by["unresolved pulse miss"].matched) == ("10,11", "10", "10", "")
    assert by["valid pulse propagation"].latency_s == pytest.approx(0.0005) and by["valid pulse propagation"].width_ratio == pytest.approx(1.1) and by["valid pulse propagation"].confidence == "high"
    assert by["possible acquisition miss"].acquisition == "inadequate" and by["possible acquisition miss"].confidence == "unresolved"
    low = by["subthreshold pulse suppression"]
    assert low.tau_s == pytest.approx(-0.001 / math.log(1 - low.peak)) and low.cutoff_hz == pytest.approx(1 / (2 * math.pi * low.tau_s)) and low.mechanism == "low-pass attenuation"
    assert by["valid pulse propagation"].tau_s is None


def test_summary_and_empty(spark):
    names, frames = scene(spark)
    s = {names[r.capture_id]: r for r in propagation.summary(propagation.outcomes(*frames, WAY), frames[1]).collect()}
    merged, late, gone = s["pulse merging"], s["late pulse propagation"], s["complete pulse non-propagation"]
    assert (merged.expected, merged.matched, merged.merged_groups, merged.extra_outputs, merged.dominant) == (2, 2, 1, 0, "pulse merging")
    assert (late.missed, late.detection_ratio, gone.missed, gone.detection_ratio, s["pulse splitting"].split) == (0, 1.0, 1, 0.0, 1)
    none = [f.where("false") for f in frames]
    assert propagation.outcomes(*none, WAY).count() == 0
    alone = propagation.outcomes(frames[0], *none[1:], WAY)
    assert alone.count() == 11 and {r.outcome for r in alone.collect()} == {"complete pulse non-propagation", "possible acquisition miss"}


def test_bandwidth_and_ring(spark):
    slow = propagation.Path(threshold=0.5, rate=RATE, bandwidth=100.0)
    df = spark.createDataFrame([(w,) for w in (0.0001, 0.0003, 0.0007, 0.002)], "width double")
    grades = lambda p: [r[0] for r in df.selectExpr(propagation.acquisition("width", p)).collect()]
    assert grades(WAY) == ["inadequate", "limited", "usable", "strong"] and grades(slow) == ["inadequate", "limited", "limited", "usable"]
    t = np.arange(400) / RATE
    ring = np.exp(-t * 60) * np.cos(2 * np.pi * 200 * t)
    signal = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, ring, strict=True)], "capture_id long, t double, v double")
    starts = spark.createDataFrame([(1, 5, 0.0, 0.0)], "capture_id long, id long, start_s double, base double")
    assert propagation.ring_q(starts, signal, 0.04).first().q == pytest.approx(math.pi / (60 / 200), rel=0.05)


def test_pulse_without_width(spark):
    """Its time constant is 0 and its cutoff infinite, as the SQL has them; so are quotients by zero in general."""
    sources = spark.createDataFrame([(1, 0, 0.2, 0.2), (1, 1, 0.3, 0.301)], "capture_id long, id long, rise_s double, fall_s double")
    signal = spark.createDataFrame([(1, k / 1000, 0.3 if k in (200, 300) else 0.0) for k in range(400)], "capture_id long, t double, v double")
    scales = spark.createDataFrame([(1, 1.0, 0.0)], "capture_id long, amplitude double, base double")
    thin = propagation.outcomes(sources, sources.where("false"), signal, scales, WAY).orderBy("id").collect()
    assert (thin[0].tau_s, thin[0].cutoff_hz) == (0.0, math.inf)
    assert thin[1].tau_s == pytest.approx(-0.001 / math.log(0.7)) and thin[1].cutoff_hz == pytest.approx(1 / (2 * math.pi * thin[1].tau_s))
    pairs = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in pairs.selectExpr(propagation.quotient("a", "b")).collect()]
    assert got[:3] == [0.5, math.inf, -math.inf] and math.isnan(got[3]) and got[4:] == [None, None]


def test_widths_at_a_limit(spark):
    """A pulse of exactly two samples is not one of fewer, wherever it lies: fall_s - rise_s would round it below."""
    sources = spark.createDataFrame([(1, 0, 1.1, 1.1002, 0.0002)], "capture_id long, id long, rise_s double, fall_s double, width_s double")
    empty = [spark.createDataFrame([], k) for k in ("capture_id long, id long, rise_s double, fall_s double", "capture_id long, t double, v double", "capture_id long, amplitude double, base double")]
    assert 1.1002 - 1.1 < 0.0002 and propagation.outcomes(sources, *empty, WAY).first().acquisition == "limited"


def test_queries_at_limits(spark, tmp_path):
    """Purchases and clicks of values 0, 5, 10 and 20, some across powers of two of seconds, so widths are zero or meet limits: rows as DuckDB's."""
    import duckdb

    from wavelens.catalog import ORACLE_SQL, QUERIES

    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i // 7 * 12_000_000_000 + i * i * 12_347 % 999_983) AS ts, i % 7 AS user_id, ['purchase', 'view', 'click', 'purchase'][1 + i * 3 // 7 % 4] AS event_type, [10.0, 0.0, 20.0, 5.0, 10.0][1 + i % 5]::DOUBLE AS value, '' AS props FROM (SELECT unnest(range(240)) AS i)) TO '{tmp_path}/events.parquet'""")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("q106_pulse_outcomes", "q107_propagation_summary"):
        got = QUERIES[name](spark, str(tmp_path))
        want = c.sql(ORACLE_SQL[name])
        rows = lambda df: sorted(map(repr, df))
        assert rows(tuple(r[k] for k in want.columns) for r in got.collect()) == rows(want.fetchall())
