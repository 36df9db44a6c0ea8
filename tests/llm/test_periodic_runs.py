"""Periodic runs against a search of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from wavelens.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def all_runs(words):
    """(start, length, period) by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q) and not any(start == s and length == m for s, m in out):
                out[start, length] = q
            i += 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, replaced=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if replaced and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_transforms():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        x = rng.integers(0, periodic_runs.PRIME, (size, 5)).astype(np.uint64)
        there = periodic_runs.transform(x)
        assert (periodic_runs.back(there) * np.uint64(pow(size, -1, periodic_runs.PRIME)) % periodic_runs.P == x).all()
        y = rng.integers(0, 1000, (size, 5)).astype(np.uint64)
        product = periodic_runs.back(there * periodic_runs.transform(y)[periodic_runs._opposite(size)] % periodic_runs.P)
        for t in range(size):
            want = sum(int(x[(i + t) % size, 0]) * int(y[i, 0]) for i in range(size)) * size % periodic_runs.PRIME
            assert int(product[t, 0]) == want


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_planted_texts(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.integers(1, 7)):
            n = int(rng.integers(0, 160))
            words = rng.integers(1, rng.integers(2, 6), n)
            if n > 10 and rng.random() < 0.7:
                a = int(rng.integers(0, n))
                words[a:] = np.resize(words[a : a + int(rng.integers(1, max(2, (n - a) // 3 + 1)))], n - a)
            texts.append(words if rng.random() < 0.9 else np.ones(n, np.int64))
        text, *rest = periodic_runs.runs(np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]))
        got = [[] for _ in texts]
        for t, *run in zip(text.tolist(), *(x.tolist() for x in rest), strict=True):
            got[t].append(tuple(run))
        assert got == [all_runs(t.tolist()) for t in texts]


def test_find_runs(spark):
    odd = ["", None, " \n ", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "x" + " a b c" * 9 + " y y y y y y", "é é é  " * 7, "ab\x1cab " * 6, ("w1 w2 w3 w1 w2 " * 5 + "z ") * 6]
    rows = [(i, t, "en", i, "clash") for i, t in enumerate(odd)] + [(4, odd[4], None, 1, "again"), (None, "q r " * 9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_runs int, period string")
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text").where("length(text) < 6000")
    both = docs.select("doc_id", "text").union(real)
    got = sorted(map(str, (tuple(r) for r in periodic_runs.find_runs(both).drop("runs").collect())))
    assert got == sorted(str(expected(r.doc_id, r.text)) for r in both.collect())
    plain = periodic_runs.find_runs(docs, repeat=None)
    assert sorted(str(tuple(r)[:8]) for r in plain.collect()) == sorted(str(expected(r[0], r[1], False)) for r in rows)
    assert [tuple(r) for r in plain.where("doc_id = 7").first().runs] == [(1, 27, 3), (28, 6, 1)]
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def test_long_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 5000, 30_000)]
    words[4000:24_000] = (words[4000:7001] * 7)[:20_000]
    texts = [" ".join(words), "same " * 60_000, "s t " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(docs, repeat=None).collect()}
    assert (4000, 20_000, 3001) in got[0] and got[1] == [(0, 60_000, 1)] and got[2] == [(0, 60_000, 2)]
