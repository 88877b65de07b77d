"""Queries over all of their input, against SQL without cuts or brute force."""

import os
import re

import duckdb
import pytest

from corpuslab.plans import evaluation, gates, text

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for f in os.listdir(DIR):
        found.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return found


def test_all_turns_are_columns(spark, con):
    want = set(con.sql("SELECT conv_id, turn, max(md5(text)) FROM conversations GROUP BY 1, 2").fetchall())
    got = gates.turns_pivot(spark, DIR)
    assert got.columns == ["conv_id", *(f"turn_{k}" for (k,) in con.sql("SELECT DISTINCT turn FROM conversations ORDER BY 1").fetchall())]
    assert {(r["conv_id"], int(c[5:]), r[c]) for r in got.collect() for c in got.columns[1:] if r[c] is not None} == want


def test_spearman_over_all_rows(spark, con):
    want = con.sql(evaluation.ORACLE["spearman"].replace(" WHERE l_orderkey % 5 = 0", "")).fetchall()[0]
    got = evaluation.spearman(spark, DIR).first()
    assert got["n"] == want[0] == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert got["rho"] == pytest.approx(want[1], abs=1e-6)


def test_token_lists_are_whole(spark, con, tmp_path):
    """All tokens of all documents, also with quotes of either kind and without text."""
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall() + [(-1, "it's a \"b\" c"), (-2, ""), (-3, None), (-4, "x " * 100 + "can't")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in text.token_list_parse(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        words = [] if t is None else t.split(" ")
        assert not any("'" in w and '"' in w for w in words)
        assert got[k]["n_items"] == len(words) + 1 and got[k]["last_item"] == "don't"
        written = " ".join(f'"{w}"' if "'" in w else f"'{w}'" for w in [*words, "don't"])
        assert got[k]["n_single"] == len(re.findall("'([^']+)'", written))


def test_term_weights_of_five_thousand_terms(spark, con):
    want = con.sql(evaluation.ORACLE["tfidf_weights"].replace("LIMIT 200)", "LIMIT 5000)")).fetchall()
    got = evaluation.tfidf_weights(spark, DIR).collect()
    assert len({r["token"] for r in got}) == len({t for _, t, _ in want}) > 200
    assert {(r["doc_id"], r["token"]): r["weight"] for r in got} == {(d, t): pytest.approx(w, abs=2e-6) for d, t, w in want}


def test_bootstrap_of_two_thousand_replicates(spark, con):
    want = con.sql(evaluation.ORACLE["bootstrap_ci"].replace("range(1, 201)", "range(1, 2001)")).fetchall()[0]
    assert tuple(evaluation.bootstrap_ci(spark, DIR).first()) == pytest.approx(want, abs=1e-4)
