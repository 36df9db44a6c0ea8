"""Collocations against plain counts, and against SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from wavelens.llm import collocations
from wavelens.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(rows, depth=3, least=10, top=2000):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    n, found = Counter(), {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    for (lang, w), a in counts.items():
        n[lang] += a if len(w) == 1 else 0
    longer = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                longer[lang, w[s : s + m]] = max(longer[lang, w[s : s + m]], a)
    out = []
    for (lang, w), a in found.items():
        score, _, l, r = min((10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * longer[lang, w] < 50 * a:
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked, at = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


ODD = ["", None, "  ", ".,;", "new york " * 30, "New York city\tnew york City! " * 12, "a\x00b c\x01d " * 11, "un deux trois quatre. " * 15 + "deux trois, " * 40, "É é É é " * 10, "日本 語 " * 12, "x " * 5000, "the end\nthe end\r\x0bthe\x0cend " * 9, "z \x1f y " * 10, ("1 2 " + "7" * 5000 + " 1 ") * 12]


def odd(spark):
    rows = [(i, t, "en" if i % 3 else "fr" if i % 2 else None, "clash") for i, t in enumerate(ODD)] + [(4, ODD[4], "en", "again"), (None, ODD[6], "und", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, w1 string")


@pytest.mark.parametrize("budget", [250_000, 400, 20])
def test_collocations(spark, budget):
    docs = odd(spark).select("lang", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text"))
    got = sorted(tuple(r) for r in collocations.collocations(docs, budget=budget).collect())
    assert got == plain([tuple(r) for r in docs.collect()]) and {x[0] for x in got} >= {"en", "fr", "und"}


def test_depth_and_top(spark):
    docs = odd(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    for depth, top, budget in ((4, 3, 50), (2, 1, 30), (5, 100, 10_000)):
        assert sorted(tuple(r) for r in collocations.collocations(docs, depth=depth, top=top, budget=budget).collect()) == plain(rows, depth, top=top)
    assert collocations.collocations(docs.where("false")).count() == 0


def test_packed():
    rows = np.array([[3, 1, 0], [3, 2, 4], [1, 0, 0]])
    words, got, times = collocations.unpacked(collocations.packed([b"a", b"b", b"c", b"d", b"unused"], rows, np.array([5, 1, 1 << 40])))
    assert words == [b"a", b"b", b"c", b"d"] and (got == rows).all() and times.tolist() == [5, 1, 1 << 40]


def test_slices_of_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 500)
    got = collocations.collocations(odd(spark), budget=100)
    assert sorted(tuple(r) for r in got.collect()) == plain([(r.lang, r.text) for r in odd(spark).collect()])


def test_what_sql_gives(spark):
    documents = odd(spark).select("lang", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")).toArrow()  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["op13_collocations"])
    got = collocations.collocations(spark.createDataFrame(documents))
    assert want.columns == got.columns and sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
