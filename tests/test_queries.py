"""Every query with SQL against DuckDB; the others for their rows."""

import os

import duckdb
import pytest

import __spark_entry__
from corpuslab.plans import analysis, counts, evaluation, gates, models, rows, selection, text

DIR = "/root/testdata/sf0.001"
PARTS = (text, counts, selection, gates, evaluation, models, rows, analysis)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in PARTS for k, s in p.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        found.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return found


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 87
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
