"""Every query that has SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from wavelens.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


#: Queries beyond SQL, and the tests that hold what they call against plain versions.
TESTED = {"q45_bootstrap": "test_bootstrap", "q62_power_bootstrap": "test_power_bootstrap", "q67_coordinate_descent": "test_coordinate_descent", "q98_bootstrap_support": "test_bootstrap_support"}


def test_every_query_has_sql_or_a_test():
    named = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert {q for q in QUERIES if q not in ORACLE_SQL} == set(TESTED) and set(ORACLE_SQL) <= set(QUERIES)
    assert all(f"def {t}(" in named for t in TESTED.values())


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
