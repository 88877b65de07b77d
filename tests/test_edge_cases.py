"""Nulls, ties, repeated rows and empty input of aggregations, vectors and models."""

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import aggregates as A
from corpuslab.operators import ml, stats
from corpuslab.operators import vectors as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([("a", "x", 1, ["p", "q", "p"]), ("a", None, 7, None), (None, "x", None, [None, "p"]), (None, "y", 3, []), ("b", "y", 3, ["q"]), ("b", "y", 3, ["q"])], "g string, k string, v int, items array<string>")


def test_counts(spark, odd):
    assert rows(A.value_counts(odd, "g")) == [("a", 2, 33.3333), ("b", 2, 33.3333), (None, 2, 33.3333)] and A.value_counts(odd.limit(0), "g").count() == 0
    table = A.crosstab(odd, "g", "k", ["x", "z"])
    assert rows(table) == [("a", 1, 0), ("b", 0, 0), (None, 1, 0)]
    assert rows(A.row_shares(table, "g")) == [("a", 100.0, 0.0), ("b", None, None), (None, 100.0, 0.0)]
    assert rows(A.explode_counts(odd, F.col("items"))) == [("p", 2), ("q", 3), (None, 1)]
    assert rows(A.histogram(odd, "v", [(0, 3), (3, 5)], "g")) == [("a", "0-3", 1), ("b", "0-3", 2), (None, "0-3", 1)]
    assert rows(A.co_occurrence(odd, "g", F.col("items"))) == [("p", "q", 1), ("q", "p", 1)]


def test_tops_and_rates(spark, odd):
    top = A.top_k(odd.select("g", "k", "v"), 1, "v", "k", "g")
    assert rows(top) == [("a", None, 7), ("b", "y", 3), (None, "y", 3)]
    assert A.top_k(odd.select("k", "v"), 2, "v", "k").collect()[0]["v"] == 7 and A.top_k(odd.limit(0), 2, "v", "k").count() == 0
    lift = A.feature_lift(odd, F.col("v") == 3, {"x": F.col("k") == "x", "never": F.lit(False)})
    assert rows(lift) == [("never", 0, None, 0.6, None), ("x", 2, 0.0, 1.0, -1.0)]
    assert rows(A.rates(odd, {"three": F.col("v") == 3}, "g", least=2)) == [("a", 2, 0.0), ("b", 2, 100.0), (None, 2, 100.0)]


def test_vectors_and_sweep(spark):
    h = spark.createDataFrame([(0, "A", 1, [1.0, 0.0]), (0, "C", 0, [0.0, 1.0]), (0, "A", 1, None), (0, None, None, [5.0, 5.0]), (1, "A", 1, [2.0, 2.0])], "layer int, grp string, y int, h array<double>")
    v = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [1.0, 0.0])], "vector string, layer int, v array<double>")
    z = {r["layer"]: r["z"] for r in V.axis_gap(h, v, "grp", "A", "C").collect()}
    assert z[0] == pytest.approx(2.0) and z[1] is None
    means = V.group_means(h.where("h is not null"), "grp", 2)
    probe = V.centroid_probe(means, "grp", "A", "C")
    swept = V.sweep(h.where("grp is not null"), v, probe, spark.createDataFrame([(0.0,), (-9.0,)], "alpha double"), "y")
    got = {(r["layer"], r["alpha"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in swept.collect()}
    assert got == {(0, 0.0): (1, 0, 0, 1), (0, -9.0): (0, 0, 1, 1)}
    assert V.sweep(h.limit(0), v, probe, spark.createDataFrame([(0.0,)], "alpha double"), "y").count() == 0


def test_models(spark):
    df = spark.createDataFrame([(k, [float(k % 2), 1.0 + k % 3]) for k in range(12)] + [(99, None)], "id long, x array<double>")
    assert [r["k"] for r in ml.kmeans(df, "x", (2, 3)).collect()] == [2, 3]
    near = ml.nearest_to_centre(ml.clustered(df, "x", 2), "id", 1).collect()
    assert len(near) == 2 and all(r["id"] != 99 for r in near)
    assert ml.pca(df, "x", 1).count() == 12 and ml.singular_values(df, "x", 2).count() == 2
    z = ml.standardised(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "id int, a double, b double"), ["a", "b"])
    assert rows(z) == [(1, -1.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]
    t = ml.tf_idf(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None), (4, [])], "id int, t array<string>"), "id", F.col("t"), 1, 1, 1.0)
    assert rows(t) == [(1, "a", 1.0), (2, "a", 1.0)]


def test_stats(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (0, 2.0, 4.0), (None, 3.0, 5.0), (1, None, 1.0)], "t int, a double, b double")
    assert stats.spearman(df, "a", "b").first()["n"] == 3
    got = stats.bootstrap_delta(df, F.col("t"), F.lit(1), F.lit(1), 50).first()
    assert (got["lo"], got["med"], got["hi"]) == (0.0, 0.0, 0.0) and stats.bootstrap_delta(df.limit(0), F.col("t"), F.lit(1), F.lit(0), 5).first()["med"] == 0.0
