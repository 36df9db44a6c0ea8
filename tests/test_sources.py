"""Readers with bad and empty fields, writers by round trip, streams against batch."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wavelens import roundtrips
from wavelens.operators import cases, quantiles, tuning
from wavelens.sources import campaign, scope, writers
from wavelens.streaming import sessions


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿capture_id,signature_id,family,truth_label,expected_fault_present,noise_tier,variant\nc1,sag,pq,positive,TRUE,normal,a\nc2,sag,pq,,0,,"b, c"\n')
    rows = {r.capture_id: r for r in campaign.manifest(spark, str(p)).collect()}
    assert rows["c1"].expected_fault_present is True and rows["c2"].expected_fault_present is False
    assert rows["c2"].waveform_intent == "b, c" and rows["c2"].noise_tier == "" and rows["c2"].truth_label == ""
    p.write_text("capture_id,signature_id\nc1,sag\n")
    with pytest.raises(ValueError, match="family"):
        campaign.manifest(spark, str(p))
    p.write_text("capture_id,signature_id,family,truth_label,expected_fault_present,noise_tier\nc1,outer-bearing,x,y,1,z\n")
    with pytest.raises(ValueError, match="mechanical"):
        campaign.manifest(spark, str(p))


def test_results(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("capture_id,signature_id,confidence,matched\nc1,a,0.5,yes\nc1,b,bad,no\nc1,c,0.5,true\nc2,a,nan,\n")
    rows = {(r.capture_id, r.signature_id): r for r in campaign.results(spark, str(p)).collect()}
    assert [rows["c1", s].rank for s in "acb"] == [1, 2, 3] and rows["c1", "b"].confidence == 0.0 and rows["c2", "a"].confidence == 0.0
    assert rows["c1", "a"].raw_matched and not rows["c2", "a"].raw_matched and rows["c1", "a"].reference_evidence_score == 1.0 and rows["c1", "a"].threshold_profile == "unknown"
    p.write_text("capture_id,signature_id,confidence,rank,reference_evidence_score\nc1,a,0.5,x,\n")
    r = campaign.results(spark, str(p)).first()
    assert (r.rank, r.reference_evidence_score, r.raw_matched) == (0, 0.0, True)


def test_mixed_headers_and_quoted_fields(spark, tmp_path):
    """Files are read by their own header; what the writer puts into fields comes back."""
    d = tmp_path / "r"
    d.mkdir()
    (d / "b.csv").write_text("capture_id,signature_id,confidence\nc1,s1,0.5\nc1,s2,0.5\n")
    (d / "a.csv").write_text('\ufeffsignature_id,capture_id,confidence,rank,warnings\ns3,c1,0.9,4,"a ""b"", c\nnext | line"\n')
    (d / "empty.csv").write_text("")
    rows = campaign.results(spark, str(d)).orderBy("ordinal").collect()
    assert [(r.capture_id, r.signature_id, r.confidence, r["rank"], r.warnings) for r in rows] == [("c1", "s3", 0.9, 4, 'a "b", c\nnext | line'), ("c1", "s1", 0.5, 1, ""), ("c1", "s2", 0.5, 2, "")]
    (d / "c.csv").write_text("capture_id,confidence\nc1,1\n")
    with pytest.raises(ValueError, match="signature_id"):
        campaign.results(spark, str(d))
    df = spark.createDataFrame([("c1", "s", "0.5", 'x\n"y", z|w', ""), ("c2", "s, t", "1", "plain", None)], "capture_id string, signature_id string, confidence string, warnings string, note string")
    writers.write_table(df, str(tmp_path / "w"))
    back = campaign.read_csv(spark, str(tmp_path / "w")).select(df.columns).collect()
    assert sorted(map(tuple, back)) == sorted((*r[:4], r[4] or "") for r in df.collect())
    with pytest.raises(ValueError, match="header"):
        campaign.read_csv(spark, str(d / "empty.csv"))


def test_scope_with_long_preamble_and_quoted_names(spark, tmp_path):
    for k in (1, 2):
        lines = [f"note {i},{k}" if i % 2 else "text" for i in range(200)] + ['Seconds,"ch 1, raw",CH2'] + [f"{i / 10},{i * k},{'x' if i == 3 else i}" for i in range(30)]
        (tmp_path / f"s{k}.csv").write_text("\n".join(lines) + "\n")
    assert scope.header_rows(spark, str(tmp_path)) == 200
    rows = scope.analog(spark, str(tmp_path)).collect()
    assert {r.channel for r in rows} == {"ch 1, raw", "CH2"} and len(rows) == 2 * (30 + 29)
    assert sorted(r.v for r in rows if r.channel == "ch 1, raw" and r.capture_id.endswith("s2.csv")) == [2.0 * i for i in range(30)]


def test_scores_and_registry(spark, tmp_path):
    s, j = tmp_path / "s.csv", tmp_path / "s.json"
    s.write_text("capture_id,truth_label,signature_id,confidence\nc1,a,a,0.4\nc1,a,b,oops\n")
    j.write_text(json.dumps({"loaded_signatures": ["x", "y"]}))
    assert {r[0] for r in campaign.campaign_scores(spark, str(s))[1].collect()} == {"a", "b"}
    assert {r[0] for r in campaign.campaign_scores(spark, str(s), str(j))[1].collect()} == {"x", "y"}
    for name, text in {"good": '﻿{"seed_id": "sag", "family": "power_quality", "status": "ready", "entrypoint": "m:f"}', "old": '{"seed_id": "swell", "family": "power_quality", "status": "old", "entrypoint": "m:f"}', "bad": "no json", "gear": '{"seed_id": "gear_mesh", "family": "power_quality", "status": "ready", "entrypoint": "m:f"}', "dist": '{"seed_id": "built"}'}.items():
        (tmp_path / "seeds" / name).mkdir(parents=True)
        (tmp_path / "seeds" / name / "seed_manifest.json").write_text(text)
    specs, failures = campaign.registry(spark, str(tmp_path / "seeds"), ["ready"])
    assert [r.seed_id for r in specs.collect()] == ["sag"] and sorted(r.error for r in failures.collect()) == ["not a specification", "skipped: gear_mesh"]
    entries = spark.createDataFrame([("sag", "power_quality"), ("gear", "x"), ("y", None)], "seed_id string, family string")
    assert sorted(tuple(r) for r in campaign.registry_errors(entries).collect()) == [("gear", "invalid family x"), ("gear", "mechanical-only id"), ("y", "invalid family null")]
    found, warned = campaign.capture_files(spark, str(tmp_path / "seeds"), [".csv"])
    assert found.count() == 0 and warned.count() == 5


def test_scope(spark, tmp_path):
    p = tmp_path / "scope.csv"
    p.write_text("Model,X100\nRate,1000\nSeconds,CH1,CH2,CH3\n0.0,1,5,a\n0.1,2,5,b\nbroken row\n0.2,x,5,c\n0.3,4,5,\n")
    rows = scope.analog(spark, str(p)).orderBy("n").collect()
    assert [(r.channel, r.n, r.t, r.v) for r in rows] == [("CH1", 0, 0.0, 1.0), ("CH1", 1, 0.1, 2.0), ("CH1", 2, 0.3, 4.0)]
    q = tmp_path / "plain.csv"
    q.write_text("a,b\n5,0\n3,1\n4,2\n")
    assert {r.channel for r in scope.analog(spark, str(q)).collect()} == {"a"}  # b rises, so it is the time
    t = tmp_path / "tracks.csv"
    t.write_text("sec,c1,c2\n0,50,60\n1,51,\n")
    got = {(r.capture_id, r.n): r.v for r in scope.tracks(spark, str(t)).collect()}
    assert got == {("c1", 0): 50.0, ("c1", 1): 51.0, ("c2", 0): 60.0, ("c2", 1): None}
    both = scope.tracks(spark, str(t))
    assert scope.aligned(both).count() == 4
    with pytest.raises(ValueError, match="time vector"):
        scope.aligned(both.withColumn("t", F.expr("if(capture_id = 'c2', t + 1, t)")))


def test_evidence(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "a", 1, 0.9), ("c1", "b", 2, 0.1), ("c2", "a", 1, None)], "capture_id string, signature_id string, rank int, confidence double")
    found = writers.write_evidence(f"file://{tmp_path}/e", {"per_case": rows}, rows, {"seed": "1", "a": "b"})
    files = {r.file: r for r in found.collect()}
    assert any(f.startswith("per_case/part-") for f in files) and any(f.startswith("config/") for f in files)
    import hashlib

    for f, r in files.items():
        content = (tmp_path / "e" / f).read_bytes()
        assert r.sha256 == hashlib.sha256(content).hexdigest() and r.bytes == len(content)
    docs = [json.loads(json.loads(x)["document"]) for p in Path(tmp_path / "e" / "ranked_results").glob("part-*") for x in p.read_text().splitlines()]
    assert {d["capture_id"]: [x["signature_id"] for x in d["results"]] for d in docs} == {"c1": ["a", "b"], "c2": ["a"]}
    back = campaign.read_csv(spark, f"{tmp_path}/e/per_case")
    assert sorted((r.capture_id, r.signature_id, r.confidence) for r in back.collect()) == [("c1", "a", "0.9"), ("c1", "b", "0.1"), ("c2", "a", "")]
    m = spark.createDataFrame([({"b": 1, "a": 2},)], "m map<string,int>").select(writers.stable_json("m").alias("j")).first().j
    assert m == '{"a":2,"b":1}'


def test_thresholds_written(spark, tmp_path):
    scores = spark.createDataFrame([(i, "a", 0.1 * i, "a" if i > 5 else "b") for i in range(10)], "capture_id long, signature_id string, confidence double, truth string")
    writers.write_thresholds(scores, f"file://{tmp_path}/t", [0.3, 0.55, 0.8])
    assert campaign.read_csv(spark, f"{tmp_path}/t/threshold_evaluation").count() == 3
    assert [r.threshold for r in campaign.read_csv(spark, f"{tmp_path}/t/deployable_thresholds").collect()] == ["0.55"]


def test_store(spark, tmp_path):
    store = writers.ValidationStore(spark, f"file://{tmp_path}/store")
    assert store.cases().count() == 0 and store.summary().count() == 0
    kind = "capture_id string, file_path string, truth_label string, expected_signature string, notes string"
    store.upsert(spark.createDataFrame([("c1", "f1", "positive", "a", ""), ("c2", "f2", "negative", "b", None)], kind))
    store.upsert(spark.createDataFrame([("c2", "f3", "positive", "a", "new")], kind))
    assert sorted((r.capture_id, r.file_path) for r in store.cases().collect()) == [("c1", "f1"), ("c2", "f3")]
    rows = lambda *x: spark.createDataFrame(x, "capture_id string, signature_id string, matched boolean, confidence double")
    store.record("s1", rows(("c1", "a", True, 0.9)))
    store.record("s2", rows(("c1", "a", True, 0.9), ("c1", "b", True, 0.6), ("c2", "a", False, 0.1), ("c2", "b", False, 0.2)))
    got = {r.signature_id: (r.tp, r.fp, r.tn, r.fn) for r in store.summary().collect()}
    assert got == {"a": (1, 0, 0, 1), "b": (0, 1, 1, 0)} and store.summary("s1").count() == 1
    store.record("s2", rows(("c1", "a", False, 0.0)))
    assert store.summary("s2").first().fn == 1
    store.export(f"file://{tmp_path}/out")
    assert campaign.read_csv(spark, f"{tmp_path}/out/cases").count() == 2


def test_streams(spark, tmp_path):
    rows = [(c, f"2024-01-01 00:00:{s:02d}", v) for c, s, v in [(1, 0, 10.0), (1, 1, 60.0), (1, 2, 45.0), (1, 3, 20.0), (1, 40, 70.0), (2, 0, 80.0), (2, 50, 1.0)]]
    batch = spark.createDataFrame(rows, "capture_id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(name, make, mode="append"):
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stats = {(r.capture_id, r.start.second): (r["count"], r.mean) for r in run("stats", lambda s: sessions.windowed_stats(s, "10 seconds", "1 seconds"), "complete")}
    assert stats[1, 0] == (4, 33.75) and stats[2, 50] == (1, 1.0)
    eps = {(r.capture_id, r.events) for r in run("eps", lambda s: sessions.gap_sessions(s, "5 seconds", "1 seconds"), "complete")}
    assert eps == {(1, 4), (1, 1), (2, 1)}
    changes = sorted((r.capture_id, r.ts.second, r.state) for r in run("changes", lambda s: sessions.hysteresis_changes(s, 50.0, 30.0)))
    assert changes == [(1, 1, 1), (1, 3, 0), (1, 40, 1), (2, 0, 1), (2, 50, 0)]
    pairs = run("pairs", lambda s: sessions.interval_pairs(s.where("v >= 60").selectExpr("capture_id", "ts", "v AS source_id"), s.where("v < 60").selectExpr("capture_id", "ts", "v AS output_id"), "1 seconds", "2 seconds", "1 seconds"))
    assert sorted((r.source_id, r.output_id) for r in pairs) == [(60.0, 20.0), (60.0, 45.0)]
    assert len(run("seen", lambda s: sessions.first_seen(s, ["capture_id"], "100 seconds"))) == 2


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(0, 1, 500), "b": np.r_[np.zeros(300), 1e9, rng.normal(5, 1e-6, 50)], None: np.array([3.0]), "c": rng.integers(0, 3, 200).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and np.allclose(got[g][1], np.quantile(vs, shares))


def test_coordinate_descent(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    signatures, cands = ["a", "b", "c"], [0.3, 0.4, 0.5, 0.6, 0.7]
    manifest = [(i, signatures[i % 3], bool(rng.random() < 0.6)) for i in range(150)]
    results = [(i, s, float(np.round(rng.random(), 3)), bool(rng.random() < 0.9), float(rng.choice([1.0, 0.25, 0.0])), k + 1) for i in range(150) for k, s in enumerate(signatures)]
    start = {s: 0.5 for s in signatures}

    def outcome(profile):
        tp = fp = tn = fn = 0
        for i, expected, positive in manifest:
            ok = [(min(1.0, c * (0.70 + 0.30 * e) + 0.05), c, e, -k, s) for j, s, c, m, e, k in results if j == i and m and e > 0 and c >= profile[s]]
            won = bool(ok) and max(ok)[4] == expected
            tp, fp, tn, fn = tp + (positive and won), fp + (not positive and won), tn + (not positive and not won), fn + (positive and not won)
        p, r, s = (a / b if b else 0.0 for a, b in ((tp, tp + fp), (tp, tp + fn), (tn, tn + fp)))
        return (float(p >= 0.6), float(r >= 0.5), r, p, s + (r + s) / 2), (tp, fp, tn, fn)

    want, trials = dict(start), []
    for k in range(3):
        before = dict(want)
        for s in sorted(want):
            best, top = want[s], outcome(want)[0]
            for t in cands:
                score, counts = outcome(want | {s: t})
                trials.append((k + 1, s, t, *counts))
                if score > top:
                    best, top = t, score
            want[s] = best
        if want == before:
            break
    m = spark.createDataFrame(manifest, "capture_id long, signature_id string, expected_fault_present boolean")
    r = spark.createDataFrame(results, "capture_id long, signature_id string, confidence double, raw_matched boolean, reference_evidence_score double, rank int")
    got, profile = tuning.coordinate_descent(m, r, start, cands, 0.6, 0.5, passes=3)
    assert profile == want and [tuple(x) for x in got.collect()] == trials


def test_case_states(spark):
    """Every state, cases without results, and the choice of the primary."""
    kind = "capture_id string, signature_id string, family string, truth_label string, expected_fault_present boolean, split string, noise_tier string, waveform_intent string, test_id string"
    of = lambda i, s, p: (i, s, "f", "t", p, "test", "normal", "w", i)
    m = spark.createDataFrame([of("1", "a", True), of("2", "a", True), of("3", "a", True), of("4", "a", False), of("5", "a", False), of("6", "a", False), of("7", "a", True)], kind)
    r = spark.createDataFrame([("1", "a", 0.9, True, 1.0, 1), ("1", "b", 0.8, True, 1.0, 2), ("2", "b", 0.9, True, 1.0, 1), ("2", "a", 0.95, True, 0.0, 2), ("4", "a", 0.9, True, 1.0, 1), ("5", "b", 0.9, True, 1.0, 1), ("7", "a", 0.2, False, 0.25, 1)], "capture_id string, signature_id string, confidence double, raw_matched boolean, reference_evidence_score double, rank int")
    states = {x.capture_id: (x.conflict_state, x.predicted_primary) for x in cases.case_rows(m, r, {}).collect()}
    assert states == {"1": ("positive_expected_won_primary_ambiguous", "a"), "2": ("positive_expected_lost_primary", "b"), "3": ("positive_expected_no_match", ""), "4": ("negative_false_positive", "a"), "5": ("negative_avoided_primary", "b"), "6": ("negative_no_match", ""), "7": ("positive_expected_won_primary", "a")}
    assert {x.capture_id: x.predicted_primary for x in cases.case_rows(m, r, {}, forced=False).collect()}["7"] == ""


def test_power_bootstrap(spark):
    """The draws centre on the power of the cases themselves, by the batch report."""
    import numpy as np

    from wavelens.operators import power

    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        positive, right = bool(rng.random() < 0.5), bool(rng.random() < 0.8)
        rows.append((str(i), "a", positive, "s", "high" if i % 2 else "normal", "w", "t", "x", right, not positive and not right, positive and not right, False, False, "k", "f", "r", "q"))
    kind = "capture_id string, analyzer_id string, expected_fault_present boolean, split string, noise_tier string, waveform_intent string, test_id string, conflict_state string, is_correct boolean, is_false_positive boolean, is_false_negative boolean, primary_stolen boolean, ambiguous boolean, truth_label string, family string, reference_status string, target_rule string"
    df = spark.createDataFrame(rows, kind)
    b = power.bootstrap_power(df).first()
    assert b.power_score_ci_low < b.power_score_estimate < b.power_score_ci_high and b.power_score_ci_high - b.power_score_ci_low < 0.15
    whole = power.success_distribution(df).where("bucket_type = 'overall'").first()
    assert abs(whole.power_score - b.power_score_estimate) < 0.05


def test_overlap_join_on_planted_rows(spark):
    from wavelens.operators import joins

    a = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 9.0, 9.5), (2, 3, 0.0, 100.0)], "capture_id long, a_id long, a0 double, a1 double")
    b = spark.createDataFrame([(1, 1, 10.0, 12.0), (1, 2, 9.2, 30.0), (2, 3, 101.0, 102.0)], "capture_id long, b_id long, b0 double, b1 double")
    got = sorted((r.a_id, r.b_id) for r in joins.overlap_join(a, b, "capture_id", ("a0", "a1"), ("b0", "b1"), 4.0).collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_reject_reasons(spark):
    """Captures that cannot be analysed keep their row and match nothing."""
    from wavelens.functions.features import pair_features
    from wavelens.plans import rules

    ok = [float(i % 5) for i in range(16)]
    rows = [("a", "r", 100.0, ok, ok), ("b", "r", 0.0, ok, ok), ("c", "r", 100.0, ok[:4], ok[:4]), ("d", "r", 100.0, ok, ok[:9]), ("e", "r", 100.0, [float("nan"), *ok[1:]], ok), ("f", "r", None, None, None), ("g", "r", 100.0, [None, *ok[1:]], ok)]
    out = rules.score_signatures(pair_features(spark.createDataFrame(rows, "capture_id string, reference_label string, rate double, primary array<double>, reference array<double>")), ["pq_voltage_sag", "unknown_one"])
    got = {r.capture_id: (r.reject_reason, [(s.matched, s.confidence) for s in r.scores]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": None, "b": "sample_rate", "c": "too_short", "d": "reference_length", "e": "not_finite", "f": "sample_rate", "g": "not_finite"}
    assert all(v[1] == [(False, 0.0), (False, 0.0)] for k, v in got.items() if k != "a")
    assert got["a"][1][1] == (False, 0.2)


def test_joins_of_long_intervals(spark):
    """Intervals far longer than the width asked for: all pairs, and few rows a bucketed interval."""
    import random

    from wavelens.operators import joins

    rng = random.Random(7)
    spans = lambda: [(c, i, s, s + rng.choice([0.0, 0.5, 90.0, 3000.0])) for i in range(60) for c, s in [(rng.randrange(3), rng.uniform(0, 5000))]]
    left, right = spans(), spans()
    a, b = spark.createDataFrame(left, "capture_id long, a_id long, a0 double, a1 double"), spark.createDataFrame(right, "capture_id long, b_id long, b0 double, b1 double")
    got = [(r.a_id, r.b_id) for r in joins.overlap_join(a, b, "capture_id", ("a0", "a1"), ("b0", "b1"), 0.5).collect()]
    assert sorted(got) == sorted((i, j) for c, i, s, e in left for d, j, t, f in right if c == d and s <= f and t <= e)
    met = [(r.a_id, r.b_id) for r in joins.interval_join(a, b, "capture_id", "a0", "a1", "b0", 0.5).collect()]
    assert sorted(met) == sorted((i, j) for c, i, s, e in left for d, j, t, _ in right if c == d and s <= t <= e)
    width = joins._width(0.5, (a, "a0", "a1"))
    assert joins._bucketed(a, "a0", "a1", width, "x").count() <= 3 * len(left) and joins._width(2.0, (a.where("false"), "a0", "a1")) == 2.0


def test_first_lines_without_a_sort_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n﻿x,y\n" + "1,2\n" * 5000)
    (tmp_path / "b.csv").write_text('z,"q"\n3,4\n')
    (tmp_path / "c.csv").write_text("")
    text = spark.read.text(str(tmp_path)).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    found = campaign._first_lines(text)
    assert {r.f.rsplit("/", 1)[1]: r.value for r in found.collect()} == {"a.csv": "﻿x,y", "b.csv": 'z,"q"'}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan
    assert sorted(len(g.columns) for g in campaign.read_groups(spark, str(tmp_path))) == [4, 4]


def test_capture_documents_take_the_scores_once(spark):
    plan = roundtrips.q119_capture_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1
