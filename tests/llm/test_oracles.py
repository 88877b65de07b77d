"""Every query with SQL, against DuckDB."""

import duckdb
import pytest

from corpuslab.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect())
    right = sorted(tuple(map(str, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert left == right
