"""Windows with edges, edge timing, chains, support ladders and summary writers against plain loops."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.operators import evidence, timing
from wavelens.sources import writers

KIND = "capture_id bigint, n bigint, t double, v double"


def frame(spark, captures):
    return spark.createDataFrame([(c, i, float(t), None if v is None else float(v)) for c, (ts, vs) in captures.items() for i, (t, v) in enumerate(zip(ts, vs, strict=True))], KIND)


def test_edge_windows(spark):
    rng = np.random.default_rng(1)
    data = {c: (np.arange(k), rng.normal(3, 1, k)) for c, k in ((1, 1), (2, 2), (3, 5), (4, 40))}
    for half in (0, 2, 3):
        got = {(r.capture_id, r.n): r for r in timing.edge_windows(frame(spark, data), half).collect()}
        for c, (_, v) in data.items():
            for n in range(len(v)):
                at = np.arange(n - half, n + half + 1)
                near = v[at.clip(0, len(v) - 1)]
                same = np.where((at >= 0) & (at < len(v)), near, 0)
                r = got[c, n]
                assert np.allclose([r.same_mean, r.same_rms, r.nearest_mean, r.nearest_rms], [same.mean(), math.sqrt((same**2).mean()), near.mean(), math.sqrt((near**2).mean())])
    assert timing.edge_windows(frame(spark, {1: ([0, 1], [None, 2.0])}), 1).orderBy("n").first().nearest_mean == pytest.approx(2 / 3)


def test_edge_timing(spark):
    t = np.arange(200) * 0.001
    ramp = np.clip((t - 0.05) / 0.02, 0, 1)
    over = ramp + np.where((t > 0.07) & (t < 0.075), 0.3, 0)
    data = {1: (t, 24 * ramp), 2: (t, 24 * over), 3: (t, 24 - 24 * ramp), 4: (t, np.full(200, 5.0)), 5: (t[:1], [1.0])}
    up = {r.capture_id: r for r in timing.edge_timing(frame(spark, data)).collect()}
    assert up[1].t10 == pytest.approx(0.052) and up[1].t50 == pytest.approx(0.06) and up[1].t90 == pytest.approx(0.068) and up[1].transition_s == pytest.approx(0.016)
    assert up[1].overshoot == pytest.approx(0) and up[1].steepest == pytest.approx(1200) and up[1].chatter == 0 and up[1].settling_s == pytest.approx(0.001, abs=1e-9)
    assert up[2].overshoot == pytest.approx(0.3, abs=0.02) and up[2].settling_s > up[1].settling_s
    assert up[3].t90 is None and up[4].t10 is None and up[5].t50 is None and up[4].overshoot is None and up[4].chatter == 0
    down = {r.capture_id: r for r in timing.edge_timing(frame(spark, data), rising=False).collect()}
    assert down[3].t50 == pytest.approx(0.06) and down[3].overshoot == pytest.approx(0) and down[1].t50 is None
    assert timing.edge_timing(frame(spark, data).limit(0)).count() == 0


def test_chain_and_hysteresis(spark):
    t = np.arange(300) * 0.01
    step = lambda at: (t >= at).astype(float)
    command, current, position = ({1: (t, step(0.5))}, {1: (t, step(0.8))}, {1: (t, np.clip(t - 1, 0, 1))})
    stages = [timing.level_time(frame(spark, command), "command"), timing.onset_time(frame(spark, current), "current", 0.12, 3), timing.onset_time(frame(spark, position), "motion", 0.05, 3), timing.level_time(frame(spark, position), "threshold", 0.6)]
    r = timing.timing_chain(stages).first()
    assert (r.command, r.current, r.threshold) == (pytest.approx(0.495), pytest.approx(0.8), pytest.approx(1.6)) and r.motion == pytest.approx(1.05, abs=0.011) and r.total == pytest.approx(1.105)
    out = {1: (t, step(1.3) - step(1.8)), 2: (t, step(2.0))}
    both = timing.switch_hysteresis(frame(spark, out), frame(spark, position | {2: (t, t)})).collect()
    assert [x.capture_id for x in both] == [1] and both[0].hysteresis == pytest.approx(0.5) and both[0].on_position == pytest.approx(0.295)


def test_support(spark):
    rows = [("a", 10.0, 5.0)] * 6 + [("b", 10.0, 5.0)] * 5 + [("c", 10.0, 5.0)] * 2 + [("d", x, 5.0) for x in (5.0, 10.0, 15.0)] + [(None, 1.0, None)] * 4
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.support for r in evidence.support_ladder(df, ["k"], {"x": (0.15, 0.35), "y": (0.2, 0.45)}).collect()}
    assert got == {"a": "strongly_supported", "b": "supported", "c": "exploratory", "d": "exploratory", None: "exploratory"}


def test_bootstrap_support(spark):
    rng = np.random.default_rng(5)
    groups = {"tight": rng.normal(100, 2, 41), "even": rng.normal(10, 3, 40), "wide": rng.lognormal(0, 2, 15), "ties": rng.integers(1, 5, 30).astype(float), "two": np.array([1.0, 2.0]), None: np.full(9, 3.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("tight", None), ("tight", float("nan"))], "k string, x double")
    got = {r.k: r for r in evidence.bootstrap_support(df, ["k"], "x", rounds=20_000).collect()}
    for k in ("tight", "even", "wide", "ties", "two"):
        meds = np.median(groups[k][rng.integers(0, len(groups[k]), (40_000, len(groups[k])))], axis=1)
        assert got[k].spread == pytest.approx(np.std(meds) / abs(np.median(meds)), rel=0.05)
    assert (got["tight"].n, got["tight"].support, got["wide"].support, got["two"].support) == (41, "strongly_supported", "exploratory", "exploratory")
    assert got[None].spread == 0 and got[None].support == "strongly_supported" and evidence.bootstrap_support(df.limit(0), ["k"], "x").count() == 0


def test_summary_writers(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, "sag|x", 0.5), (1, 2, None, 0.25), (2, 1, "swell", 1.0)], "capture_id bigint, rank int, signature_id string, confidence double")
    writers.write_campaign(str(tmp_path / "c"), ranked, {"b": "2", "a": "1"}, spark.createDataFrame([("w",)], "warning string"))
    read = lambda name: spark.read.json(f"{tmp_path}/c/{name}").collect()
    assert {r.capture_id: r.markdown for r in read("reports")}[1] == "# Report: 1\n\n| rank | signature_id | confidence |\n| --- | --- | --- |\n| 1 | sag\\|x | 0.5 |\n| 2 |  | 0.25 |\n"
    assert sorted((r.name, r.value) for r in read("run_config")) == [("a", "1"), ("b", "2")] and read("problems")[0].warning == "w"
    assert [json.loads(r.document)["results"][0]["rank"] for r in read("campaign_documents")] == [1, 1]
    out = writers.write_summary_tables(str(tmp_path / "s"), {"tracks": ranked, "pairs": ranked.where(F.lit(False)), "notes": spark.createDataFrame([('a "b"\nc',)], "x string")})
    assert sorted(out.collect()) == [("notes", 1, 1), ("pairs", 0, 4), ("tracks", 3, 4)]
    with pytest.raises(ValueError, match="no table"):
        writers.write_summary_tables(str(tmp_path / "n"), {})
