"""Order-dependent operators against plain loops over the same rows."""

import math

import numpy as np
import pytest

from wavelens.operators import events, tuning


def captures(seed=3, captures=6, n=120):
    rng = np.random.default_rng(seed)
    return [(c, i, float(round(t, 3)), v) for c in range(captures) for i, (t, v) in enumerate(zip(np.cumsum(rng.exponential(1.0, n)), (rng.normal(0, 1, n).cumsum() * 8 + 40).tolist(), strict=True))]


def loop_events(values, enter, leave, enter_n, leave_n, least):
    out, run, start, on = [], [], None, False
    for i, v in enumerate(values):
        bad = v is None or math.isnan(v)
        meets = (bad or v <= leave) if on else (not bad and v >= enter)
        run = run + [i] if meets else []
        if len(run) == (leave_n if on else enter_n):
            if on:
                out.append((start, run[0], False))
            start, on, run = run[0], not on, []
    if on:
        out.append((start, len(values) - 1, True))
    return [e for e in out if e[1] - e[0] >= least]


def test_hysteresis(spark):
    rows = captures()
    rows = [(c, i, t, None if i % 37 == 5 else float("nan") if i % 41 == 7 else v) for c, i, t, v in rows]
    df = spark.createDataFrame(rows, "capture_id bigint, n bigint, t double, v double")
    for enter_n, leave_n, least in ((1, 1, 1), (2, 3, 2), (4, 2, 5)):
        got = sorted((r.capture_id, r.start_n, r.end_n, r.is_open) for r in events.hysteresis(df, 45.0, 30.0, enter_n, leave_n, least).collect())
        want = sorted((c, *e) for c in range(6) for e in loop_events([r[3] for r in rows if r[0] == c], 45.0, 30.0, enter_n, leave_n, least))
        assert got == want and got


def test_greedy_match(spark):
    rows = [(c, i, t) for c, i, t, _ in captures()]
    df = spark.createDataFrame(rows, "capture_id bigint, id bigint, t double")
    refs, cands = df.where("id % 3 = 0"), df.where("id % 3 <> 0").selectExpr("capture_id", "id", "t + 0.25 AS t")
    want = []
    for c in range(6):
        free = [(t + 0.25, i) for x, i, t in rows if x == c and i % 3]
        for rid, at in ((i, t) for x, i, t in rows if x == c and i % 3 == 0):
            near = min((f for f in free if abs(f[0] - at) <= 1.0), key=lambda f: (abs(f[0] - at), f), default=None)
            if near:
                free.remove(near)
                want.append((c, rid, near[1]))
    got = [(r.capture_id, r.reference_id, r.candidate_id) for r in events.greedy_match(refs, cands, 1.0).collect()]
    assert sorted(got) == sorted(want) and got
    assert events.greedy_match(refs.limit(0), cands.limit(0), 1.0).count() == 0


def test_chatter(spark):
    rows = [(c, t) for c, _, t, _ in captures()]
    want = []
    for c in range(6):
        left = [t for x, t in rows if x == c]
        while left:
            inside = [t for t in left if t - left[0] <= 2.0]
            if len(inside) >= 3:
                want.append((c, inside[0], inside[-1], len(inside)))
            left = left[len(inside) if len(inside) >= 3 else 1 :]
    got = [tuple(r) for r in events.chatter(spark.createDataFrame(rows, "capture_id bigint, t double"), 2.0, 3).collect()]
    assert sorted(got) == want and got


def test_bootstrap(spark):
    rows = [("a", i % 3 > 0, i % 5 > 0, False) for i in range(300)] + [("b", True, True, False)] * 20 + [(None, False, False, True)]
    out = tuning.bootstrap(spark.createDataFrame(rows, "tier string, positive boolean, predicted boolean, conflict boolean"), "tier").collect()
    by = {(r.tier, r.metric): r for r in out}
    assert len(by) == len(out) == 3 * len(tuning.METRICS)
    r = by["a", "accuracy"]
    truth = np.mean([p == q for g, p, q, _ in rows if g == "a"])
    spread = 1.96 * math.sqrt(truth * (1 - truth) / 300)
    assert r.estimate == pytest.approx(truth) and r.ci_low == pytest.approx(truth - spread, abs=0.01) and r.ci_high == pytest.approx(truth + spread, abs=0.01)
    assert (by["b", "recall"].ci_low, by["b", "recall"].ci_high, by[None, "precision"].estimate) == (1.0, 1.0, 0.0)


def test_theil_sen_whole_track(spark):
    """The query reaches a capture's end: all its pairs count."""
    from wavelens.catalog import QUERIES
    from wavelens.plans import views

    sf = "/root/testdata/sf0.001"
    sizes = {r.capture_id: r["count"] for r in views.samples(spark, sf).groupBy("capture_id").count().collect()}
    got = {r.capture_id: r.pairs for r in QUERIES["q48_theil_sen_track"](spark, sf).collect()}
    assert max(sizes.values()) > 40 and got == {c: n * (n - 1) // 2 for c, n in sizes.items() if n > 1}


def test_reach_is_whole(spark):
    """Nodes beyond the rounds allowed are an error, not left out."""
    from wavelens.operators.graph import reach

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "a string, b string")
    roots = spark.createDataFrame([("n0",)], "root string")
    assert {r.node: r.hops for r in reach(edges, roots, most=5).collect()} == {f"n{i}": i for i in range(5)}
    with pytest.raises(RuntimeError):
        reach(edges, roots, most=3)
