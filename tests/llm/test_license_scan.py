"""License scans against a plain scan for phrases, SQL, and edited notices."""

import re

import duckdb

from wavelens.llm import license_scan
from wavelens.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(text):
    """What phrases alone give, by comparing words at each place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    places = sorted((i, label) for label, phrase in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


NOTICE = dict(reversed([x for x in license_scan.NOTICES]))
MIT = NOTICE["mit-text"]
ODD = ["", None, " .. ", "CC-BY cc by by CC_BY", "the MIT/License, MIT\nlicense", "mit licenſe; mit licenKe gnu general publiÉ license", "GNU General Public License" + " gnu general public license" * 30, "été ÉTÉ 日本 cc by ccby", "cc by " * 20000, MIT.upper(), "x " * 50 + MIT.replace("hereby granted", "granted") + " y" * 20, MIT.replace("to any person", "to any good old person").replace("associated", "related"), " ".join(MIT.split()[:12]), " ".join(MIT.split()[::-1]), (MIT + " ") * 3, "of the terms of the of the software to deal in the"]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, "en", "clash", 1.5) for i, t in enumerate(ODD)] + [(3, ODD[3], None, "again", 0.0), (None, "An Apache license", None, None, None)], "doc_id long, text string, lang string, labels string, score double")
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text")
    both = docs.select("doc_id", "text").union(real)
    out = license_scan.scan(both).collect()
    assert len(out) == both.count()
    want = sorted(str((r.doc_id, *plain(r.text))) for r in both.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (not r.n_base or r.score == 1) for r in out)
    by = {r.doc_id: r for r in out}
    assert [("mit-text" in by[i].labels) for i in (9, 10, 11, 12, 13, 14, 15)] == [True, True, True, False, False, True, False]
    assert by[9].score == 1 and 0.8 <= by[11].score < 1 and 0 < by[12].score < 0.8 and by[13].score < 0.8
    assert license_scan.scan(docs).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert license_scan.scan(docs.where("false")).count() == 0
    spans = license_scan.found_spans(docs.where("doc_id IN (10, 14)")).where("NOT phrase").orderBy("doc_id", "start").collect()
    n = len(MIT.split())
    assert [(r.doc_id, r.start, r.end) for r in spans] == [(10, 50, 50 + n - 1), (14, 0, n), (14, n, 2 * n), (14, 2 * n, 3 * n)]


def test_scan_gives_what_sql_gives(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if t is None or len(t) < 50_000], "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    documents = docs.toArrow()  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["op12_license_scan"])
    got = license_scan.scan(docs)
    assert want.columns == got.columns
    key = lambda r: str(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.fetchall()))
