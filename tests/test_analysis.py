"""Ranks, hot joins, draws, probes and text spaces against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import aggregates, order, probes, select, stats, topics
from corpuslab.operators.joins import pair_rows, spread_join


def test_running_counts_and_quantiles(spark):
    """One group of nearly all rows, all values distinct in it; ties, nulls, a null group, an empty table."""
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(50)] + [(None, 1.0), (None, None), ("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    seen = {}
    for r in order.running_counts(df, "v", "g").collect():
        assert r["before"] == sum(x < r["v"] for x in by[r["g"]]) and r["c"] == by[r["g"]].count(r["v"]) and r["total"] == len(by[r["g"]])
        seen[r["g"]] = seen.get(r["g"], 0) + 1
    assert seen == {g: len(set(v)) for g, v in by.items()}
    found = order.quantiles(df, "v", {"q1": 0.1, "q2": 0.5, "q3": 1.0}, "g").collect()
    assert len(found) == len(by)
    for r in found:
        assert [r["q1"], r["q2"], r["q3"]] == pytest.approx(np.quantile(by[r["g"]], [0.1, 0.5, 1.0]).tolist(), abs=1e-12)
    nearest = {r["g"]: (r["n"], r["q1"], r["q2"], r["q3"]) for r in aggregates.rank_quartiles(df, "v", "g").collect()}
    assert nearest == {g: (len(v), *(sorted(v)[k * len(v) // 4] for k in (1, 2, 3))) for g, v in by.items()}
    told = {r["g"]: r for r in aggregates.describe(df, "v", "g").collect()}
    assert told["c"]["n"] == 0 and told["c"]["p50"] is None and told[None]["n"] == 1 and told["a"]["p50"] == pytest.approx(np.median(by["a"]), abs=1e-6)
    assert order.running_counts(df.limit(0), "v", "g").count() == 0 and order.running_counts(df, "v").agg(F.max("total")).first()[0] == 3052


def test_no_task_has_all_values_of_a_group(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), F.rand(3).alias("v"))
    plan = order.running_counts(df, "v", "g")
    held = order.stored(plan.withColumn("task", F.spark_partition_id()))
    assert held.count() == 20_000
    parts = order.stored(df.groupBy("g", "v").agg(F.count("*").alias("c")).repartitionByRange(4, "g", "v").withColumn("part", F.spark_partition_id())).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 8000


@pytest.mark.parametrize("cell", [3, 10_000])
def test_spread_join(spark, cell):
    """A key in a third of the rows of both sides, keys that are hot on one side, nulls, rows that are alike."""
    rng = random.Random(2)
    left = [("hot", k % 7) for k in range(40)] + [("one", k) for k in range(20)] + [(None, 1), (None, 1), ("no", 3)] + [(f"k{rng.randrange(9)}", k) for k in range(30)]
    right = [("hot", str(k % 5)) for k in range(30)] + [("one", "x"), ("two", "y"), (None, "z")] + [(f"k{rng.randrange(9)}", str(k)) for k in range(30)]
    a, b = spark.createDataFrame(left, "k string, x int").repartition(3), spark.createDataFrame(right, "k string, y string").repartition(4)
    want = sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    assert sorted(map(tuple, spread_join(a, b, ["k"], cell).select("k", "x", "y").collect())) == want
    assert sorted(map(tuple, pair_rows(a, b, ["k"], most=cell).select("k", "x", "y").collect())) == want
    assert spread_join(a.limit(0), b, ["k"], cell).count() == 0


def test_hot_cells_are_of_like_size(spark):
    a = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    b = spark.range(300).select(F.lit("hot").alias("k"), F.col("id").alias("y"))
    joined = spread_join(a, b, ["k"], 200).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
    assert sum(sizes) == 900_000 and len(sizes) > 1


def test_triples_of_a_hot_text(spark):
    ab = [("t", "en")] * 60 + [("u", "de"), ("t", " "), (" ", "en"), (None, "en"), ("t", None)]
    ac = [("t", "s1")] * 30 + [("t", "s2")] * 20 + [("u", "s1"), ("u", "")]
    got = select.triples(spark.createDataFrame(ab, "a string, b string"), spark.createDataFrame(ac, "a string, c string"), "a", "b", "c").collect()
    assert Counter(map(tuple, got)) == {("t", "en", "s1"): 1800, ("t", "en", "s2"): 1200, ("u", "de", "s1"): 1}


def test_spearman_matrix(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 400), "b": rng.random(400), "c": rng.integers(0, 2, 400) * 1.0, "flat": 1.0})
    pdf["d"] = pdf["a"] * 2 + rng.random(400)
    rows = [tuple(float(x) for x in r) for r in pdf.itertuples(index=False)] + [(None, 0.5, 1.0, 1.0, 3.0), (1.0, None, None, None, None)]
    got = stats.spearman_matrix(spark.createDataFrame(rows, "a double, b double, c double, flat double, d double"), list("abcd") + ["flat"]).collect()
    ranks = pdf.rank()
    assert len(got) == 10 and {r["n"] for r in got} == {400}
    for r in got:
        if "flat" in (r["a"], r["b"]):
            assert r["rho"] is None
        else:
            assert r["rho"] == pytest.approx(np.corrcoef(ranks[r["a"]], ranks[r["b"]])[0, 1], abs=1e-6)
    none = stats.spearman_matrix(spark.createDataFrame([], "a int, b int"), ["a", "b"]).first()
    assert none["n"] == 0 and none["rho"] is None


def test_spearman_matrix_keeps_rows_whole(spark):
    """Ranks by broadcasts and by joins are the same; a value of most rows is not one task's."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": np.where(rng.random(45_000) < 0.7, 7.0, rng.random(45_000)), "b": rng.random(45_000), "c": rng.integers(0, 3, 45_000) * 1.0})
    df = spark.createDataFrame(pdf)
    ranks = pdf.rank()
    for few in (100_000, 100, 2):
        for r in stats.spearman_matrix(df, list("abc"), few).collect():
            assert r["n"] == 45_000 and r["rho"] == pytest.approx(np.corrcoef(ranks[r["a"]], ranks[r["b"]])[0, 1], abs=1e-6)
    rows = df.withColumn("row", F.monotonically_increasing_id())
    known = order.mid_ranks(df, "a").withColumnRenamed("rank", "ra")
    dealt = stats.with_ranks(rows, known, "a", "ra", 1000)
    assert sorted(r["ra"] for r in dealt.select("ra").collect()) == sorted(ranks["a"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in dealt.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()) < 25_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_binomial_quantile():
    for n, p in ((1, 0.5), (7, 0.1), (40, 0.97), (400, 0.3)):
        upto = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        for u in np.linspace(0.0005, 0.9995, 400):
            assert stats.binomial_quantile(float(u), n, p) == int(np.searchsorted(upto, u))
    assert stats.binomial_quantile(0.7, 0, 0.5) == 0 == stats.binomial_quantile(0.99, 9, 0.0) and stats.binomial_quantile(0.01, 9, 1.0) == 9
    n = 10**10
    assert abs(stats.binomial_quantile(0.8413447, n, 0.25) - (n * 0.25 + math.sqrt(n * 3 / 16))) < 0.01 * math.sqrt(n)


def test_multinomial_moments(spark):
    counts = [30, 0, 12, 50, 1, 0, 7, 100]
    df = spark.createDataFrame([tuple(counts)], ", ".join(f"w{k} long" for k in range(8)))
    drawn = np.array([r[1:] for r in stats.multinomial_draws(df, [f"w{k}" for k in range(8)], 4000).collect()])
    n, p = sum(counts), np.array(counts) / sum(counts)
    assert (drawn.sum(axis=1) == n).all() and (drawn[:, [1, 5]] == 0).all()
    assert np.abs(drawn.mean(axis=0) - n * p).max() < 0.5
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(drawn.T, bias=True) - want).max() < 3.5
    empty = stats.multinomial_draws(df.limit(1).select(*[F.lit(0).alias(f"w{k}") for k in range(8)]), [f"w{k}" for k in range(8)], 3).collect()
    assert [sum(r[1:]) for r in empty] == [0, 0, 0]


def test_exact_p():
    def slow(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0

    for b, c in ((0, 0), (0, 5), (3, 3), (10, 40), (200, 260), (500, 420)):
        assert stats.exact_p(b, c) == pytest.approx(slow(b, c), rel=1e-9)
    assert stats.exact_p(10**9, 10**9 + 30_000) == pytest.approx(math.erfc((30_000 - 1) / math.sqrt(2 * 10**9) / math.sqrt(2)), rel=1e-3)


def fitted(h, y, c=1.0):
    """One probe by plain Newton steps on scaled features."""
    mean, spread = h.mean(axis=0), h.std(axis=0)
    x = np.column_stack([(h - mean) / np.where(spread > 0, spread, 1), np.ones(len(h))])
    theta, free = np.zeros(x.shape[1]), np.append(np.ones(h.shape[1]), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + np.diag(free), c * x.T @ (p - y) + free * theta)
    w = theta[:-1] / np.where(spread > 0, spread, 1)
    return w, theta[-1] - w @ mean


def test_probes_of_all_layers_and_folds(spark):
    rng = np.random.default_rng(4)
    rows = []
    for layer in range(3):
        h = rng.standard_normal((240, 5)) * [1, 10, 0.1, 1, 0] + [0, 5, 0, 0, 2]
        y = (h[:, 0] * layer + rng.standard_normal(240) > 0.3).astype(int)
        rows += [(layer, [float(v) for v in x], int(t), k % 4) for k, (x, t) in enumerate(zip(h, y, strict=True))]
    df = spark.createDataFrame([*rows, (0, None, 1, 0), (None, [0.0] * 5, 1, 0), (1, [0.0] * 5, None, 1)], "layer int, h array<double>, y int, fold int").repartition(5)
    found = probes.fit_probes(df, 4, c=0.7)
    assert found.count() == 15
    for r in found.collect():
        own = [x for x in rows if x[0] == r["layer"] and x[3] != r["fold"]]
        w, bias = fitted(np.array([x[1] for x in own]), np.array([x[2] for x in own]), 0.7)
        assert r["n"] == len(own) and np.abs(np.array(r["w"]) - w).max() < 1e-6 and abs(r["bias"] - bias) < 1e-6
    curve = {r["layer"]: r for r in probes.probe_curve(df.dropna(), found).collect()}
    assert curve[2]["held_out"] > curve[0]["held_out"] and curve[2]["fitted"] > 0.8
    apart = spark.createDataFrame([(0, [float(k)], int(k > 5)) for k in range(10)], "layer int, h array<double>, y int")
    assert probes.fit_probes(apart).first()["w"][0] > 0 and probes.fit_probes(apart.limit(0)).count() == 0
    alone = probes.fit_probes(apart.where("y = 1")).first()
    assert abs(alone["w"][0]) < 1e-3 and alone["bias"] > 5
    with pytest.raises(ValueError):
        probes.fit_probes(apart.unionByName(spark.createDataFrame([(0, [1.0, 2.0], 1)], apart.schema)))


def matrix(rng, n, m):
    """Sparse rows: four subjects of unlike weight with terms of their own, and some noise."""
    subject, of = rng.integers(0, 4, n), np.arange(m) % 4
    weight = np.outer(1 + rng.random(n) * 0.2, 1 + rng.random(m) * 0.2) * np.array([8.0, 5.0, 3.0, 2.0])[of]
    return np.where(subject[:, None] == of, weight, 0) + np.where(rng.random((n, m)) < 0.02, 0.1, 0)


def test_truncated_svd(spark):
    rng = np.random.default_rng(5)
    a = matrix(rng, 150, 40)
    a[7] = 0
    rows = [(k, f"t{j:02}", float(a[k, j])) for k in range(150) for j in range(40) if a[k, j]]
    weights = spark.createDataFrame(rows, "doc long, token string, weight double").repartition(4)
    sparse, terms = topics.sparse_rows(weights, spark.range(150).withColumnRenamed("id", "doc"), "doc", 40)
    used = [int(t[1:]) for t in terms]
    space = topics.truncated_svd(sparse, terms, 4, extra=8)
    _, s, vt = np.linalg.svd(a[:, used], full_matrices=False)
    assert space.values == pytest.approx(s[:4].tolist(), rel=1e-3)
    assert np.linalg.norm(vt[:4] - vt[:4] @ space.vectors @ space.vectors.T) < 1e-3  # the same subspace
    points = {r["id"]: r["x"] for r in topics.reduced(sparse, space).collect()}
    x = np.array([points[k] for k in range(150)])
    assert np.allclose(x, a[:, used] @ space.vectors) and not x[7].any()
    assert space.explained == pytest.approx((x.var(axis=0) / a.var(axis=0).sum()).tolist())
    few = topics.truncated_svd(sparse, terms, 100)
    assert len(few.values) == len(terms) and few.explained.sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        topics.sparse_rows(weights, spark.range(150).withColumnRenamed("id", "doc"), "doc", 5)
    nothing, none = topics.sparse_rows(weights.limit(0), spark.range(2).withColumnRenamed("id", "doc"), "doc", 5)
    assert not none and not len(topics.truncated_svd(nothing, none, 3).values)


def test_silhouette_and_profiles(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((30, 2)), rng.standard_normal((20, 2)) + 4, rng.standard_normal((1, 2)) - 9])
    c = [0] * 30 + [1] * 20 + [2]
    gaps = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = []
    for k in range(51):
        means = {j: gaps[k][np.array(c) == j].mean() for j in range(3)}
        inside = gaps[k][np.array(c) == c[k]].sum() / max(1, c.count(c[k]) - 1)
        outside = min(v for j, v in means.items() if j != c[k])
        want.append(0 if c.count(c[k]) == 1 else (outside - inside) / max(inside, outside))
    df = spark.createDataFrame([(k, x[k].tolist(), c[k]) for k in range(51)], "id long, x array<double>, c int")
    assert topics.sampled_silhouette(df, "x", "c", "id") == pytest.approx(np.mean(want))
    assert math.isnan(topics.sampled_silhouette(df.withColumn("c", F.lit(0)), "x", "c", "id"))
    rows = spark.createDataFrame([(1, 0, 1, 4, ["a", "b", "a"]), (2, 0, 0, 6, ["b"]), (3, 1, None, 2, []), (4, None, 1, 9, ["z"])], "id long, c int, hit int, n int, items array<string>")
    weights = spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.5), (1, "y", 0.9), (4, "z", 1.0)], "id long, token string, weight double")
    got = {r["cluster"]: r for r in topics.profiles(rows, "c", "id", weights, {"hit": F.col("hit")}, F.col("n"), F.col("items"), 1, 2).collect()}
    assert got.keys() == {0, 1}
    assert tuple(got[0])[1:] == (2, 66.6667, 50.0, 5.0, "b(100%)", "x, y") and tuple(got[1])[1:] == (1, 33.3333, None, 2.0, "", "")
