"""Registered analyzers: failures stay results, modes compete, the contract is checked."""

import pandas as pd
import pytest

from wavelens.plans import analyzers


def captures(spark):
    return spark.createDataFrame([(i, float(i)) for i in range(40)], "capture_id long, x double").repartition(3)


def registry(**functions):
    out = analyzers.Registry()
    for name, f in functions.items():
        out.register_signature(name, "test", f)
    return out


def test_failures_are_results(spark):
    def steady(b):
        return pd.DataFrame({"capture_id": b.capture_id, "matched": b.x > 20, "confidence": b.x / 40, "reason": "x"})

    def fails(b):
        if (b.x == 13).any():
            raise RuntimeError("no thirteen")
        return steady(b)

    def unsound(b):
        return pd.DataFrame({"capture_id": b.capture_id, "matched": True, "confidence": b.x / 20})

    def empty(b):
        return pd.DataFrame({"capture_id": [], "matched": [], "confidence": []})

    found = analyzers.analyze(captures(spark), registry(steady=steady, fails=fails, unsound=unsound, empty=empty)).collect()
    by = {(r.signature_id, r.capture_id): r for r in found}
    assert len(found) == len(by) == 160
    assert by["fails", 13].error == "RuntimeError('no thirteen')" and by["fails", 13].reason == analyzers.FAILED and by["fails", 13].matched is False
    assert sum(r.error is not None for r in found if r.signature_id == "fails") == 1 and all(by["steady", i].error is None for i in range(40))
    assert [by["unsound", i].error is None for i in (5, 20, 21)] == [True, True, False] and all(by["empty", i].error for i in range(40))
    decided = {r.capture_id: r for r in analyzers.decide(analyzers.best_modes(analyzers.analyze(captures(spark), registry(steady=steady, fails=fails)))).collect()}
    assert (decided[13].winner, decided[13].errors, decided[30].winner, decided[30].signatures) == (None, 1, "fails", 2)
    assert analyzers.analyze(captures(spark).where("false"), registry(steady=steady)).count() == 0


def test_modes_and_names(spark):
    def modes(b):
        one = lambda m, f: pd.DataFrame({"capture_id": b.capture_id, "mode": m, "matched": f, "confidence": 0.5})
        return pd.concat([one("b", b.x > 10), one("a", b.x > 20), one("c", False)])

    best = {r.capture_id: r for r in analyzers.best_modes(analyzers.analyze(captures(spark), registry(modes=modes))).collect()}
    assert [best[i].mode for i in (5, 15, 30)] == ["a", "b", "a"] and all(r.modes == 3 for r in best.values()) and not best[5].matched
    with pytest.raises(ValueError, match="already"):
        r = registry(one=modes)
        r.register_signature("one", "test", modes)


def test_pulse_table(spark):
    analyzers.register_pulse_table(spark, "some_pulses", 1.0, 3.0)
    rows = [(c, n, float(n), float(v)) for c, vs in {1: [0, 3, 2, 4, 1, 0, 5], 2: [5, 0, 3, 0], 3: [2, 0, 2, 2.9]}.items() for n, v in enumerate(vs)]
    out = spark.sql("SELECT * FROM some_pulses(TABLE({df}) PARTITION BY capture_id ORDER BY n)", df=spark.createDataFrame(rows, "capture_id long, n long, t double, v double"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1.0, 4.0, 4.0), (2, 1, 2.0, 3.0, 3.0)]


def test_analyzers_see_slices(spark):
    """Frames that a retry keeps do not grow with Arrow's batches: no batch an analyzer sees is longer than a slice."""
    registry = analyzers.Registry()
    registry.register_signature("size", "x", lambda batch: batch.assign(matched=True, confidence=0.5, reason=str(len(batch)))[["capture_id", "matched", "confidence", "reason"]])
    found = analyzers.analyze(spark.range(3000).withColumnRenamed("id", "capture_id").coalesce(1), registry).collect()
    assert sorted(r.capture_id for r in found) == list(range(3000)) and all(r.error is None for r in found)
    assert max(int(r.reason) for r in found) == 256
