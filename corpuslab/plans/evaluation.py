"""Queries: metrics, tests, vectors, sweeps, ablations, error taxonomy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import stats as D
from ..operators import vectors as V
from ..operators.select import first_per_group
from .tables import DOCS, POSTS, docs, folder, posts, stored, table

QUERIES, ORACLE = {}, {}
SIZE = 8  # eight layers of eight dimensions


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts with the label y (toxic) and four rules' predictions."""
    p = posts(spark, sf_dir)
    parity = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2
    cue = F.col("has_cue")
    return p.select(
        "doc_id", "lang", "source", "low", "n", F.col("toxic").cast("int").alias("y"), (F.col("n") > 300).cast("int").alias("b0"), parity.alias("b1"), cue.alias("e1"), F.greatest(cue, (F.col("quality") == 0).cast("int")).alias("e2"),
        F.when(F.col("quality") == 1, "implicit_hate").otherwise("explicit_hate").alias("subtype"),
    )


PRED = f"""{POSTS}, e AS (SELECT doc_id, lang, source, low, n, CAST(toxic AS INTEGER) AS y, CAST(n > 300 AS INTEGER) AS b0, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)) AS INTEGER) % 2 AS b1, has_cue AS e1,
greatest(has_cue, CAST(quality = 0 AS INTEGER)) AS e2, CASE WHEN quality = 1 THEN 'implicit_hate' ELSE 'explicit_hate' END AS subtype FROM p)"""


def _counts_sql(p: str, where: str = "TRUE") -> str:
    return f"count(*) FILTER (WHERE y = 1 AND {p} = 1 AND {where}) AS tp, count(*) FILTER (WHERE y = 0 AND {p} = 1 AND {where}) AS fp, count(*) FILTER (WHERE y = 1 AND {p} = 0 AND {where}) AS fn, count(*) FILTER (WHERE y = 0 AND {p} = 0 AND {where}) AS tn"


_R = "coalesce({0} / nullif({1}, 0), 0)".format
_F1, _F0 = _R("(2.0 * tp)", "(2 * tp + fp + fn)"), _R("(2.0 * tn)", "(2 * tn + fp + fn)")


@query(f"WITH {PRED}, c AS (SELECT lang, {_counts_sql('e1')} FROM e GROUP BY 1) SELECT *, round({_R('(1.0 * tp + tn)', '(tp + fp + fn + tn)')}, 6) AS accuracy, round({_R('1.0 * tp', '(tp + fp)')}, 6) AS precision, round({_R('1.0 * tp', '(tp + fn)')}, 6) AS recall, round({_F1}, 6) AS f1, round(({_F1} + {_F0}) / 2, 6) AS macro_f1 FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, D15, V18 by language."""
    return D.metrics(D.confusion(predictions(spark, sf_dir), F.col("y"), F.col("e1"), "lang"))


@query(f"WITH {PRED} SELECT coalesce(avg(e1) FILTER (WHERE y = 1 AND b0 = 0), 0) AS recovery_e1, coalesce(avg(e2) FILTER (WHERE y = 1 AND b0 = 0), 0) AS recovery_e2, count(*) FILTER (WHERE y = 1 AND b0 = 0) AS n_missed FROM e")
def fn_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16."""
    missed = (F.col("y") == 1) & (F.col("b0") == 0)
    rate = lambda c: F.coalesce(F.avg(F.when(missed, F.col(c))), F.lit(0.0))
    return predictions(spark, sf_dir).agg(rate("e1").alias("recovery_e1"), rate("e2").alias("recovery_e2"), F.count_if(missed).alias("n_missed"))


@query(f"""WITH {PRED}, c AS (SELECT count(*) FILTER (WHERE b0 = y AND e1 <> y) AS b_only_first, count(*) FILTER (WHERE b0 <> y AND e1 = y) AS c_only_second FROM e),
k AS (SELECT *, b_only_first + c_only_second AS n, least(b_only_first, c_only_second) AS k FROM c), i AS (SELECT k.*, unnest(range(0, k + 1)) AS i FROM k)
SELECT b_only_first, c_only_second, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM i GROUP BY 1, 2""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return D.mcnemar(predictions(spark, sf_dir), F.col("y"), F.col("b0"), F.col("e1"))


def _draws_sql(replicates: int, seed: int) -> str:
    """Multinomial draws of the eight cells: b7s has w0 to w7 drawn for each replicate r."""
    cells = ", ".join(f"count(*) FILTER (WHERE y * 4 + b0 * 2 + e1 = {k}) AS w{k}" for k in range(8))
    total = " + ".join(f"w{k}" for k in range(8))
    out = [f"c AS (SELECT {cells} FROM e)", f"b0s AS (SELECT *, {total} AS rest, {total} AS mass FROM c, (SELECT unnest(range(1, {replicates + 1})) AS r))"]
    for k in range(7):
        u = f"CAST(('0x' || substr(md5(CAST(r AS VARCHAR) || '|{k}|{seed}'), 1, 7)) AS BIGINT) / 268435456.0"
        out.append(f"""bg{k} AS (SELECT r, u, k, sum(exp(lgamma(rest + 1) - lgamma(k + 1) - lgamma(rest - k + 1) + k * ln(p) + (rest - k) * ln(1 - p))) OVER (PARTITION BY r ORDER BY k) AS upto
FROM (SELECT r, rest, CAST(w{k} AS DOUBLE) / mass AS p, {u} AS u, unnest(range(0, rest + 1)) AS k FROM b{k}s WHERE w{k} > 0 AND w{k} < mass))""")
        out.append(f"bd{k} AS (SELECT r, min(k) AS d FROM bg{k} WHERE upto >= u GROUP BY 1)")
        out.append(f"b{k + 1}s AS (SELECT * EXCLUDE (d, n, rest, mass) REPLACE (n AS w{k}), rest - n AS rest, mass - w{k} AS mass FROM (SELECT b{k}s.*, d, CASE WHEN w{k} = 0 THEN 0 WHEN w{k} = mass THEN rest ELSE coalesce(d, rest) END AS n FROM b{k}s LEFT JOIN bd{k} USING (r)))")
    return ",\n".join(out)


def _macro_of(at: int) -> str:
    w = lambda t, p: "(" + " + ".join(f"w{k}" for k in range(8) if k >> 2 == t and (k >> (1 - at)) & 1 == p) + ")"
    f = lambda a, b, c: f"coalesce(2.0 * {a} / nullif(2 * {a} + {b} + {c}, 0), 0)"
    return f"({f(w(1, 1), w(0, 1), w(1, 0))} + {f(w(0, 0), w(1, 0), w(0, 1))}) / 2"


@query(f"""WITH {PRED}, {_draws_sql(2000, 42)}, bf AS (SELECT * REPLACE (rest AS w7) FROM b7s), dd AS (SELECT {_macro_of(1)} - {_macro_of(0)} AS d FROM bf)
SELECT round(quantile_cont(d, 0.025), 4) AS lo, round(quantile_cont(d, 0.5), 4) AS med, round(quantile_cont(d, 0.975), 4) AS hi FROM dd""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18."""
    return D.bootstrap_delta(predictions(spark, sf_dir), F.col("y"), F.col("b0"), F.col("e1"), 2000)


@query(f"""WITH {PRED}, c AS (SELECT CAST(count(*) FILTER (WHERE e1 = 1 AND lang = 'en') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE e1 = 0 AND lang = 'en') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE e1 = 1 AND lang <> 'en') AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE e1 = 0 AND lang <> 'en') AS DOUBLE) AS d FROM e),
k AS (SELECT round((a + b + c + d) * pow(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 6) AS chi2, round(a * d / nullif(b * c, 0), 6) AS odds FROM c),
x AS (SELECT *, sqrt(chi2) AS x FROM k) SELECT chi2, odds, round({D.tail_formula("x")}, 6) AS p FROM x""")
def chi2_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2."""
    en, cue = F.col("lang") == "en", F.col("e1") == 1
    c = predictions(spark, sf_dir).agg(F.count_if(cue & en).alias("a"), F.count_if(~cue & en).alias("b"), F.count_if(cue & ~en).alias("c"), F.count_if(~cue & ~en).alias("d"))
    a = [F.col(x) for x in "abcd"]
    found = c.select(F.round(D.chi_square(*a), 6).alias("chi2"), F.round(D.odds_ratio(*a), 6).alias("odds"))
    return D.with_tails(found, F.sqrt("chi2")).withColumn("p", F.round("p", 6))


_RANKED = "SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x"


@query(f"""WITH {POSTS}, x AS (SELECT n AS v, has_cue AS g FROM p), k AS ({_RANKED}), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY v)),
s AS (SELECT CAST(sum(g) AS BIGINT) AS n1, CAST(count(*) - sum(g) AS BIGINT) AS n0, sum(CASE WHEN g = 1 THEN r END) AS r FROM k), u AS (SELECT *, r - n1 * (n1 + 1) / 2.0 AS u, n1 + n0 AS n FROM s, t),
z AS (SELECT n1, n0, u, (abs(u - n1 * n0 / 2.0) - 0.5) / sqrt(n1 * n0 / 12.0 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u)
SELECT n1, n0, round(u, 4) AS u, round(z, 4) AS z, round({D.tail_formula("z")}, 6) AS p FROM z""")
def mannwhitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    return D.mann_whitney(posts(spark, sf_dir).select(F.col("n").alias("v"), "has_cue"), "v", F.col("has_cue") == 1)


@query("WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    return D.spearman(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b")), "a", "b")


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")
_MID = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{k}" for k, c in enumerate(MEASURES))


@query(f"WITH k AS (SELECT {_MID} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{MEASURES[i]}' AS a, '{MEASURES[j]}' AS b, count(*) AS n, round(corr(r{i}, r{j}), 6) AS rho FROM k" for i in range(6) for j in range(i + 1, 6)))
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 of all pairs of six columns."""
    return D.spearman_matrix(table(spark, sf_dir, "lineitem"), MEASURES)


@query(f"""WITH {PRED}, x AS (SELECT n AS v, y AS g FROM e), k AS ({_RANKED}) SELECT round((sum(CASE WHEN g = 1 THEN r END) - sum(g) * (sum(g) + 1) / 2.0) / nullif(sum(g) * (count(*) - sum(g)), 0), 6) AS auc FROM k""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7."""
    return D.auc(predictions(spark, sf_dir), "n", F.col("y") == 1)


@query("SELECT CAST(regr_count(o_totalprice, c) AS BIGINT) AS n, round(regr_slope(o_totalprice, c), 6) AS slope, round(regr_intercept(o_totalprice, c), 6) AS intercept, round(regr_r2(o_totalprice, c), 6) AS r2 FROM (SELECT o_totalprice, CAST(o_custkey % 100 AS DOUBLE) AS c FROM orders)")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 with one regressor."""
    return D.simple_regression(table(spark, sf_dir, "orders").withColumn("c", (F.col("o_custkey") % 100).cast("double")), "o_totalprice", "c")


@query(f"""WITH {DOCS}, tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM d), dfs AS (SELECT token, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1),
top AS (SELECT token, df, n FROM dfs, nn WHERE df >= 5 AND df <= 0.8 * n ORDER BY total DESC, token LIMIT 5000), w AS (SELECT doc_id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN top USING (token))
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    from ..operators.ml import tf_idf

    return tf_idf(docs(spark, sf_dir), "doc_id", F.col("t"), 5000, 5, 0.8).withColumn("weight", F.round("weight", 6))


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, s")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13."""
    from ..operators.ml import standardised

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return standardised(o, ["z"]).withColumn("z", F.round("z", 6))


# --- vectors ------------------------------------------------------------------------------------------------------

_EMB = "CASE WHEN label < 4 THEN 'A' WHEN label < 7 THEN 'B' ELSE 'C' END"


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, grp, y, layer, h): embeddings as layers of a model; y is 1 for group A."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 4, "A").when(F.col("label") < 7, "B").otherwise("C").alias("grp"), (F.col("label") < 4).cast("int").alias("y"))
    return V.layers(e, "vec_id", "embedding", SIZE)


def group_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The groups' means, written as everything is built on them, and three vectors per layer."""
    means = stored(V.group_means(hidden(spark, sf_dir), "grp", SIZE))
    return means, V.mean_difference(means, "grp", "A", "B", "v_AB").unionByName(V.mean_difference(means, "grp", "A", "C", "v_AC"))


_H = f"""h AS (SELECT vec_id, {_EMB} AS grp, CAST(label < 4 AS INTEGER) AS y, layer, list_transform(embedding[layer * 8 + 1:layer * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS h FROM (SELECT *, unnest(range(0, 8)) AS layer FROM embeddings)),
m AS (SELECT layer, grp, [{', '.join(f'avg(h[{k}])' for k in range(1, 9))}] AS m FROM h GROUP BY 1, 2),
d AS (SELECT 'v_A' || b.grp AS vector, a.layer, [{', '.join(f'a.m[{k}] - b.m[{k}]' for k in range(1, 9))}] AS d FROM m a JOIN m b ON a.layer = b.layer AND a.grp = 'A' AND b.grp <> 'A'),
v AS (SELECT vector, layer, list_transform(d, lambda x: x / (sqrt(list_dot_product(d, d)) + 1e-8)) AS v FROM d),
pr AS (SELECT a.layer, [{', '.join(f'a.m[{k}] - b.m[{k}]' for k in range(1, 9))}] AS w, (list_dot_product(b.m, b.m) - list_dot_product(a.m, a.m)) / 2 AS bias FROM m a JOIN m b ON a.layer = b.layer AND a.grp = 'A' AND b.grp = 'C')"""


@query(f"WITH {_H} SELECT vector, CAST(layer AS INTEGER) AS layer, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS v, round(sqrt(list_dot_product(v, v)), 6) AS length FROM v")
def mean_diff_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, V3."""
    _, v = group_vectors(spark, sf_dir)
    return v.select("vector", "layer", F.array_join(F.transform("v", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("v"), F.round(V.norm(F.col("v")), 6).alias("length"))


@query(f"WITH {_H} SELECT CAST(a.layer AS INTEGER) AS layer, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) AS cosine FROM v a JOIN v b ON a.layer = b.layer AND a.vector = 'v_AB' AND b.vector = 'v_AC'")
def cosine_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8."""
    _, v = group_vectors(spark, sf_dir)
    one, two = (v.where(F.col("vector") == k).select("layer", F.col("v").alias(k)) for k in ("v_AB", "v_AC"))
    return one.join(two, "layer").select("layer", F.round(V.cosine(F.col("v_AB"), F.col("v_AC")), 6).alias("cosine"))


@query(f"WITH {_H}, s AS (SELECT v.vector, v.layer, grp, list_dot_product(h, v) AS s FROM h JOIN v USING (layer) WHERE grp IN ('A', 'C')), z AS (SELECT vector, layer, (avg(s) FILTER (WHERE grp = 'A') - avg(s) FILTER (WHERE grp = 'C')) / (stddev_pop(s) + 1e-8) AS z FROM s GROUP BY 1, 2) SELECT vector, CAST(layer AS INTEGER) AS layer, round(z, 6) AS z, CAST(rank() OVER (PARTITION BY vector ORDER BY round(abs(z), 6) DESC) AS INTEGER) AS place FROM z")
def axis_gap_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, T1, T5."""
    from pyspark.sql import Window

    _, v = group_vectors(spark, sf_dir)
    z = V.axis_gap(hidden(spark, sf_dir), v, "grp", "A", "C")
    return z.select("vector", "layer", F.round("z", 6).alias("z"), F.rank().over(Window.partitionBy("vector").orderBy(F.desc(F.round(F.abs("z"), 6)))).alias("place"))


@query(f"WITH {_H}, s AS (SELECT h.layer, y, CAST(round(list_dot_product(h, w) + bias, 9) > 0 AS INTEGER) AS p FROM h JOIN pr USING (layer)), c AS (SELECT layer, {_counts_sql('p')} FROM s GROUP BY 1) SELECT CAST(layer AS INTEGER) AS layer, round(({_F1} + {_F0}) / 2, 6) AS macro_f1 FROM c")
def centroid_probe_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V14."""
    means, _ = group_vectors(spark, sf_dir)
    probe = V.centroid_probe(means, "grp", "A", "C")
    s = hidden(spark, sf_dir).join(F.broadcast(probe), "layer").withColumn("p", (F.round(V.dot(F.col("h"), F.col("w")) + F.col("bias"), 9) > 0).cast("int"))
    return D.confusion(s, F.col("y"), F.col("p"), "layer").select("layer", F.round(D.macro_f1(), 6).alias("macro_f1"))


ALPHAS = (-1.0, 0.0, 0.5, 1.0, 2.0, 4.0)


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, v = group_vectors(spark, sf_dir)
    probe = V.centroid_probe(means, "grp", "A", "C")
    return V.scored(V.sweep(hidden(spark, sf_dir), v, probe, spark.createDataFrame([(a,) for a in ALPHAS], "alpha double"), "y"))


_SWEEP = f"""{_H}, s AS (SELECT v.vector, h.layer, alpha, y, CAST(round(list_dot_product(h, w) + bias + alpha * list_dot_product(w, v), 9) > 0 AS INTEGER) AS p, CAST(round(list_dot_product(h, w) + bias, 9) > 0 AS INTEGER) AS p0 FROM h JOIN pr USING (layer) JOIN v USING (layer), (SELECT CAST(unnest([{', '.join(map(str, ALPHAS))}]) AS DOUBLE) AS alpha)),
c AS (SELECT vector, layer, alpha, {_counts_sql('p')}, coalesce(avg(p) FILTER (WHERE y = 1 AND p0 = 0), 0) AS rec FROM s GROUP BY 1, 2, 3),
sw AS (SELECT vector, CAST(layer AS INTEGER) AS layer, alpha, round(({_F1} + {_F0}) / 2, 6) AS macro_f1, round({_R('1.0 * tp', '(tp + fn)')}, 6) AS hate_recall, round(rec, 6) AS fn_recovery FROM c)"""


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V9, J10."""
    return swept(spark, sf_dir)


_BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vector ORDER BY macro_f1 DESC, layer, alpha) AS i FROM sw) WHERE i = 1)"


@query(f"WITH {_SWEEP}, {_BEST}, z AS (SELECT min(macro_f1) AS f0 FROM sw WHERE alpha = 0 AND layer = 0) SELECT 'B0' AS setup, NULL AS layer, NULL AS alpha, f0 AS macro_f1, CAST(0 AS DOUBLE) AS d_f1 FROM z UNION ALL SELECT vector, layer, alpha, macro_f1, round(macro_f1 - f0, 6) FROM b, z")
def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, V11."""
    s = stored(swept(spark, sf_dir))
    base = s.where("alpha = 0 AND layer = 0").agg(F.min("macro_f1").alias("f0"))
    top = V.best(s, "vector", "macro_f1", "layer", "alpha").crossJoin(F.broadcast(base))
    zero = base.select(F.lit("B0").alias("setup"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("double").alias("alpha"), F.col("f0").alias("macro_f1"), F.lit(0.0).alias("d_f1"))
    return zero.unionByName(top.select(F.col("vector").alias("setup"), "layer", "alpha", "macro_f1", F.round(F.col("macro_f1") - F.col("f0"), 6).alias("d_f1")))


@query(f"WITH {_SWEEP}, {_BEST}, n AS (SELECT vector, unnest(range(greatest(0, layer - 2), least(7, layer + 2) + 1)) AS layer, alpha FROM b), f AS (SELECT DISTINCT vector, layer, unnest(list_concat(list_filter([alpha - 0.5, alpha - 0.25, alpha, alpha + 0.25, alpha + 0.5], lambda a: a > 0), [-alpha])) AS alpha FROM n) SELECT vector, CAST(layer AS INTEGER) AS layer, alpha + 0.0 AS alpha, EXISTS (SELECT 1 FROM sw WHERE sw.vector = f.vector AND sw.layer = f.layer AND sw.alpha = f.alpha) AS done FROM f")
def fine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points around the best, and which the coarse log has."""
    s = stored(swept(spark, sf_dir))
    g = V.fine_grid(V.best(s, "vector", "macro_f1", "layer", "alpha"), 0, 7)
    left = V.remaining(g, s).withColumn("done", F.lit(False))
    return g.join(left, ["vector", "layer", "alpha"], "left").select("vector", "layer", (F.col("alpha") + 0.0).alias("alpha"), F.coalesce("done", F.lit(True)).alias("done"))


STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0)
_SHARE = "CASE mode WHEN 'last' THEN 8.0 / 36 WHEN 'first' THEN 1.0 / 36 ELSE 1.0 END"
_POOLED = ", ".join("(" + " + ".join(f"{i + 1} * CAST(embedding[{8 * i + k}] AS DOUBLE)" for i in range(8)) + ") / 36" for k in range(1, 9))


def _mean(x: str) -> str:
    return "[" + ", ".join(f"avg({x}[{k}])" for k in range(1, 9)) + "]"


@query(f"""WITH q AS (SELECT {_EMB} AS grp, CAST(label < 4 AS INTEGER) AS y, [{_POOLED}] AS p FROM embeddings), m AS (SELECT grp, {_mean("p")} AS m FROM q GROUP BY 1),
d AS (SELECT 'v_A' || b.grp AS vector, [{', '.join(f'a.m[{k}] - b.m[{k}]' for k in range(1, 9))}] AS d FROM m a JOIN m b ON a.grp = 'A' AND b.grp <> 'A'), v AS (SELECT vector, list_transform(d, lambda x: x / (sqrt(list_dot_product(d, d)) + 1e-8)) AS v FROM d),
pr AS (SELECT [{', '.join(f'a.m[{k}] - b.m[{k}]' for k in range(1, 9))}] AS w, (list_dot_product(b.m, b.m) - list_dot_product(a.m, a.m)) / 2 AS bias FROM m a JOIN m b ON a.grp = 'A' AND b.grp = 'C'),
s AS (SELECT vector, y, list_dot_product(p, w) + bias AS base, list_dot_product(v, w) AS tilt FROM q, v, pr),
t AS (SELECT vector, alpha, y, CAST(round(base + alpha * 8.0 / 36 * tilt, 9) > 0 AS INTEGER) AS p FROM s, (SELECT CAST(unnest([{', '.join(map(str, STRENGTHS))}]) AS DOUBLE) AS alpha)), tc AS (SELECT vector, alpha, {_counts_sql('p')} FROM t GROUP BY 1, 2),
b AS (SELECT vector, alpha FROM (SELECT vector, alpha, row_number() OVER (PARTITION BY vector ORDER BY round(({_F1} + {_F0}) / 2, 6) DESC, alpha) AS i FROM tc) WHERE i = 1),
st(setting, factor, mode) AS (VALUES {', '.join(str(x) for x in V.SETTINGS)}), x AS (SELECT vector, b.alpha, setting, y, CAST(round(base, 9) > 0 AS INTEGER) AS p0, CAST(round(base + b.alpha * factor * {_SHARE} * tilt, 9) > 0 AS INTEGER) AS p FROM s JOIN b USING (vector), st),
c AS (SELECT vector, alpha, setting, {_counts_sql('p')}, coalesce(avg(p) FILTER (WHERE y = 1 AND p0 = 0), 0) AS rec FROM x GROUP BY 1, 2, 3), f AS (SELECT *, ({_F1} + {_F0}) / 2 AS f FROM c)
SELECT f.vector, f.alpha, f.setting, round(f.f, 6) AS macro_f1, round(f.f - z.f, 6) AS d_f1, round(f.rec, 6) AS fn_rec FROM f JOIN f z ON f.vector = z.vector AND z.setting = 'zero'""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last token, strength 0, sign turned, first and all tokens at each vector's best strength; a vector's eight slices
    stand in for the states of eight tokens, of which the last weigh the most."""
    e = table(spark, sf_dir, "embeddings")
    slices = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * SIZE + 1, F.lit(SIZE)), lambda x: x.cast("double")))
    rows = stored(e.select(F.when(F.col("label") < 4, "A").when(F.col("label") < 7, "B").otherwise("C").alias("grp"), (F.col("label") < 4).cast("int").alias("y"), slices.alias("states")))
    means = stored(V.group_means(rows.select(F.lit(0).alias("layer"), "grp", V.pooled(F.col("states"), SIZE).alias("h")), "grp", SIZE))
    vectors = V.mean_difference(means, "grp", "A", "B", "v_AB").unionByName(V.mean_difference(means, "grp", "A", "C", "v_AC"))
    ready = vectors.join(V.centroid_probe(means, "grp", "A", "C"), "layer").drop("layer")
    return V.ablation(rows, ready, STRENGTHS, "y", "states", SIZE)


@query(f"WITH {_H} SELECT CAST(row_number() OVER (ORDER BY vector, layer) - 1 AS BIGINT) AS row, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS v FROM v")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' vectors as an array file, written and read."""
    from ..sources import readers, sinks

    path = f"{folder(spark)}/vectors-{uuid.uuid4().hex}.npy"
    _, v = group_vectors(spark, sf_dir)
    sinks.arrays(v, path, "v", "vector", "layer")
    return readers.arrays(spark, path).select("row", F.array_join(F.transform("values", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("v"))


@query("SELECT 'box' AS kind, lang AS series, source AS x, CAST(min(n_chars) AS DOUBLE) AS y_low, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS y_q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS y_mid, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS y_q3, CAST(max(n_chars) AS DOUBLE) AS y_high FROM documents GROUP BY 2, 3")
def box_plot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: figures of a box plot."""
    from ..sources import sinks

    return sinks.plot_table(table(spark, sf_dir, "documents"), "box", "source", "n_chars", "lang")


_MODES = ("last", "first", "all", "none")


@query(f"""WITH {_H}, t AS (SELECT vec_id, list(h ORDER BY layer) AS t FROM h GROUP BY 1), q AS (SELECT unnest({list(_MODES)}) AS mode), x AS (SELECT vec_id, mode, t, list_transform(range(1, len(t) + 1), lambda i: list_transform(range(1, 9), lambda k: t[i][k] + CASE WHEN mode = 'all' OR (mode = 'last' AND i = len(t)) OR (mode = 'first' AND i = 1) THEN 0.5 * v[k] ELSE 0 END)) AS s FROM t, q, (SELECT v FROM v WHERE vector = 'v_AB' AND layer = 0))
SELECT vec_id, mode, array_to_string(list_transform(s, lambda a: CAST(CAST(round(10000 * list_sum(a)) AS BIGINT) AS VARCHAR)), ',') AS sums FROM x""")
def injection_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: a vector's layers stand in for the states of eight tokens."""
    _, v = group_vectors(spark, sf_dir)
    one = v.where("vector = 'v_AB' AND layer = 0").select("v")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    slices = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * SIZE + 1, F.lit(SIZE)), lambda x: x.cast("double")))
    rows = e.select("vec_id", slices.alias("t"), F.explode(F.array(*map(F.lit, _MODES))).alias("mode")).crossJoin(F.broadcast(one))
    found = V.injected_at(F.col("t"), F.col("v"), F.lit(0.5), F.col("mode"))
    added = F.transform(found, lambda h: F.round(10000 * F.aggregate(h, F.lit(0.0), lambda s, x: s + x)).cast("long").cast("string"))
    return rows.select("vec_id", "mode", F.array_join(added, ",").alias("sums"))


@query(f"""WITH {_H}, hs AS (SELECT *, 's' || CAST(vec_id % 3 AS VARCHAR) AS source FROM h), ms AS (SELECT source, layer, grp, [{', '.join(f'avg(h[{k}])' for k in range(1, 9))}] AS m FROM hs GROUP BY 1, 2, 3),
ps AS (SELECT a.source AS train, a.layer, [{', '.join(f'a.m[{k}] - b.m[{k}]' for k in range(1, 9))}] AS w, (list_dot_product(b.m, b.m) - list_dot_product(a.m, a.m)) / 2 AS bias FROM ms a JOIN ms b ON a.source = b.source AND a.layer = b.layer AND a.grp = 'A' AND b.grp = 'C'),
s AS (SELECT train, source AS eval, hs.layer, y, CAST(round(list_dot_product(h, w) + bias, 9) > 0 AS INTEGER) AS p FROM hs JOIN ps USING (layer)), c AS (SELECT train, eval, layer, {_counts_sql('p')} FROM s GROUP BY 1, 2, 3)
SELECT train, eval, CAST(layer AS INTEGER) AS layer, round(({_F1} + {_F0}) / 2, 6) AS macro_f1 FROM c""")
def probe_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources by id, each the training source in turn."""
    h = hidden(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")))
    return V.probe_swap(h, "source", "grp", "A", "C", "y", SIZE)


_U = "CAST(('0x' || substr(md5('r' || CAST(s AS VARCHAR) || '|' || CAST(layer AS VARCHAR) || '|' || CAST(k AS VARCHAR) || '|{0}'), 1, 7)) AS BIGINT) / 268435456.0"


@query(f"WITH n AS (SELECT DISTINCT label AS s, layer FROM (SELECT label, unnest(range(0, len(embedding) // 8)) AS layer FROM embeddings)), g AS (SELECT s, layer, k, sqrt(-2 * ln({_U.format('u')} + 1e-7)) * cos(6.283185307179586 * {_U.format('v')}) AS x FROM n, (SELECT unnest(range(0, 8)) AS k)), l AS (SELECT s, layer, list(x ORDER BY k) AS x FROM g GROUP BY 1, 2) SELECT 'r' || CAST(s AS VARCHAR) AS vector, CAST(layer AS INTEGER) AS layer, round(x[1] / (sqrt(list_dot_product(x, x)) + 1e-8), 6) AS first, round(x[8] / (sqrt(list_dot_product(x, x)) + 1e-8), 6) AS last FROM l")
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: a unit vector for each label and layer of the embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    names = V.layers(e, "vec_id", "embedding", SIZE).select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("vector"), "layer").distinct()
    return V.random_unit(names, 8).select("vector", "layer", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


_CAT = "CASE WHEN y = 1 AND b0 = 0 AND e1 = 1 THEN 'success_fn_recovery_e1' WHEN y = 1 AND b0 = 0 AND e2 = 1 THEN 'success_fn_recovery_e2_only' WHEN y = 1 AND b0 = 1 AND e1 = 1 THEN 'success_stable_tp' WHEN y = 0 AND b0 = 0 AND e1 = 0 THEN 'success_stable_tn' WHEN y = 1 AND b0 = 0 THEN 'failure_fn_persistent' WHEN y = 0 AND b0 = 0 THEN 'failure_fp_e1' WHEN y = 0 AND b0 = 1 THEN 'failure_fp_b0' WHEN y = 1 THEN 'failure_steering_hurt' ELSE 'other' END"


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("category", V.error_category(*map(F.col, ("y", "b0", "e1", "e2"))))


@query(f"WITH {PRED} SELECT {_CAT} AS category, count(*) AS n FROM e GROUP BY 1")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V15."""
    return categorised(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {PRED}, c AS (SELECT *, {_CAT} AS category, length(low) AS len FROM e), s AS (SELECT *, CASE WHEN len <= 800 THEN 3 ELSE 0 END + CASE WHEN len <= 100 THEN 2 ELSE 0 END + CASE subtype WHEN 'implicit_hate' THEN 4 ELSE 1 END + CASE WHEN category = 'success_fn_recovery_e1' THEN CASE WHEN b1 = 0 THEN 3 ELSE 0 END + e2 ELSE 0 END AS score FROM c)
SELECT category, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, len, doc_id) AS i FROM s) WHERE i <= 3""")
def taxonomy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16, T3."""
    found = F.when(F.col("category") == "success_fn_recovery_e1", F.when(F.col("b1") == 0, 3).otherwise(0) + F.col("e2")).otherwise(0)
    s = categorised(spark, sf_dir).withColumn("len", F.length("low"))
    s = s.withColumn("score", F.when(F.col("len") <= 800, 3).otherwise(0) + F.when(F.col("len") <= 100, 2).otherwise(0) + F.when(F.col("subtype") == "implicit_hate", 4).otherwise(1) + found)
    return first_per_group(s, ["category"], [F.desc("score"), F.col("len"), F.col("doc_id")], 3, "doc_id").select("category", "doc_id", "score")


@query(f"WITH {PRED}, c AS (SELECT source, {_counts_sql('b0')} FROM e GROUP BY 1), c2 AS (SELECT source, {_counts_sql('e1')} FROM e GROUP BY 1), j AS (SELECT source, ({_F1} + {_F0}) / 2 AS f FROM c), k AS (SELECT source, ({_F1} + {_F0}) / 2 AS g FROM c2) SELECT source, round(f, 6) AS first, round(g, 6) AS second, CASE WHEN round(f, 6) > round(g, 6) THEN 'first' WHEN round(f, 6) < round(g, 6) THEN 'second' ELSE 'tie' END AS winner FROM j JOIN k USING (source)")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, J9."""
    p = predictions(spark, sf_dir)
    one, two = (D.confusion(p, F.col("y"), F.col(c), "source").select("source", F.round(D.macro_f1(), 6).alias(k)) for c, k in (("b0", "first"), ("e1", "second")))
    return one.join(two, "source").withColumn("winner", F.when(F.col("first") > F.col("second"), "first").when(F.col("first") < F.col("second"), "second").otherwise("tie"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(100 * avg(CAST(value > 50 AS INTEGER)), 4) AS pct_high FROM events GROUP BY 1")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation over runs."""
    e = table(spark, sf_dir, "events")
    sd = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    return A.rates(e, {"high": F.col("value") > 50}, "event_type").join(sd, "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch side of the streaming counts."""
    from ..streaming.resume import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
