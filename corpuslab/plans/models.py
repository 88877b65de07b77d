"""Queries over models; most fits have no SQL and are checked for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.lexicons import CATEGORIES, REFUSALS
from ..functions.stem import stems
from ..operators import generate, ml
from .tables import POSTS, docs, posts, stored, table

FEATURES = [*CATEGORIES, "len100"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few numbers for each labelled text, written once: a fit reads its rows several times, each fold anew, texts once."""
    p = posts(spark, sf_dir)
    flags = classify.category_flags(F.col("t"))
    return stored(p.select("doc_id", F.col("toxic").cast("double").alias("toxic"), *[c.cast("double").alias(k) for k, c in flags.items()], (F.col("n") / 100.0).alias("len100")))


def logreg_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, X23."""
    f = _features(spark, sf_dir)
    return ml.coefficients(ml.logistic(f, FEATURES, "toxic"), FEATURES, f)


def logreg_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return ml.cross_validated(_features(spark, sf_dir), FEATURES, "toxic", "doc_id")


def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, D20."""
    return ml.ols(_features(spark, sf_dir), ["ability", "moral", "len100"], "toxic")


def kmeans_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and silhouette for 3 to 15 clusters."""
    return ml.kmeans(table(spark, sf_dir, "embeddings"), "embedding", tuple(range(3, 16)))


def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, T6."""
    c = ml.clustered(table(spark, sf_dir, "embeddings"), "embedding", 5)
    return ml.nearest_to_centre(c, "vec_id", 3).select("cluster", "place", "vec_id", F.round("distance", 6).alias("distance"))


def nearest_to_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, D12 on given centres: the labels' mean vectors, and the three vectors nearest to each of those nearest to it."""
    e = table(spark, sf_dir, "embeddings")
    found = ml.assigned(e.select("vec_id", "embedding"), "embedding", ml.centres_of(e, "label", "embedding", 64))
    return ml.nearest_to_centre(found, "vec_id", 3).select("cluster", "place", "vec_id", F.round("distance", 6).alias("distance"))


_NEAR = f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT label AS cluster, [{", ".join(f"avg(v[{k}])" for k in range(1, 65))}] AS m FROM e GROUP BY 1),
g AS (SELECT vec_id, cluster, round(list_distance(v, m), 9) AS distance FROM e, c), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS i FROM g),
p AS (SELECT cluster, vec_id, distance, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS place FROM n WHERE i = 1) SELECT cluster, CAST(place AS INTEGER) AS place, vec_id, round(distance, 6) AS distance FROM p WHERE place <= 3"""


def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14."""
    return ml.pca(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 2).select("vec_id", "components")


def svd50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    return ml.singular_values(table(spark, sf_dir, "embeddings"), "embedding", 50)


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    return docs(spark, sf_dir).select("doc_id", F.size(stems("t")).alias("n_forms"))


def generated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns by the deterministic stand-in."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = generate.run_turns(d, generate.echo, [("analyse", "Read {input}"), ("answer", "Now {analyse}")])
    return found.select("conv_id", "turn", "status", "attempts", F.length("reply").alias("n_chars"))


def ols_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 with three regressors: coefficients and R²."""
    p = posts(spark, sf_dir).select(F.col("toxic").cast("double").alias("toxic"), (F.col("n") / 100.0).alias("len100"), F.size("cues").cast("double").alias("cues"), (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("double").alias("lines"))
    found = ml.ols(p, ["len100", "cues", "lines"], "toxic")
    return found.select("feature", F.round("coefficient", 6).alias("coefficient"), F.round("r2", 6).alias("r2"))


#: Each regressor's part that those before it do not tell (r2, r3) gives its coefficient; the rest follows backwards.
_OLS = f"""WITH {POSTS}, x AS (SELECT CAST(toxic AS DOUBLE) AS y, n / 100.0 AS x1, CAST(len(cues) AS DOUBLE) AS x2, CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS x3 FROM p),
a AS (SELECT regr_slope(x2, x1) AS s, regr_intercept(x2, x1) AS i FROM x), e2 AS (SELECT x.*, x2 - s * x1 - i AS r2 FROM x, a), b AS (SELECT regr_slope(x3, r2) AS t FROM e2), h AS (SELECT regr_slope(x3 - t * x2, x1) AS s, regr_intercept(x3 - t * x2, x1) AS i, any_value(t) AS t FROM e2, b),
e3 AS (SELECT e2.*, x3 - t * x2 - s * x1 - i AS r3 FROM e2, h), c3 AS (SELECT regr_slope(y, r3) AS b3 FROM e3), c2 AS (SELECT regr_slope(y - b3 * x3, r2) AS b2, any_value(b3) AS b3 FROM e3, c3),
c1 AS (SELECT regr_slope(y - b3 * x3 - b2 * x2, x1) AS b1, regr_intercept(y - b3 * x3 - b2 * x2, x1) AS b0, any_value(b2) AS b2, any_value(b3) AS b3 FROM e3, c2),
q AS (SELECT 1 - sum(pow(y - b0 - b1 * x1 - b2 * x2 - b3 * x3, 2)) / (var_pop(y) * count(*)) AS r2 FROM x, c1)
SELECT unnest(['len100', 'cues', 'lines', 'intercept']) AS feature, round(unnest([b1, b2, b3, b0]), 6) AS coefficient, round(r2, 6) AS r2 FROM c1, q"""
_SAID = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_REFUSED = " OR ".join(f"strpos(lower(reply), '{x.replace(chr(39), chr(39) * 2)}') > 0" for x in REFUSALS)
_TURNS = f"""WITH c AS (SELECT conv_id, turn, coalesce({_SAID}, '') AS said, CASE WHEN strpos(text, 'refuse') > 0 THEN 'I cannot do that.' ELSE coalesce({_SAID}, '') END AS reply FROM conversations),
s AS (SELECT *, CASE WHEN said = '' THEN 'skipped' WHEN {_REFUSED} THEN 'refused' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, status, CAST(CASE status WHEN 'skipped' THEN 0 WHEN 'refused' THEN 1 ELSE 2 END AS INTEGER) AS attempts, CAST(length(CASE status WHEN 'skipped' THEN '' ELSE reply END) AS INTEGER) AS n_chars FROM s"""

QUERIES = {f.__name__: f for f in (logreg_coefficients, logreg_cross_validation, ols_coefficients, kmeans_elbow, kmeans_nearest, pca2, svd50, stem_counts, generated_turns, ols_estimates, nearest_to_means)}
ORACLE: dict[str, str] = {"nearest_to_means": _NEAR, "ols_estimates": _OLS, "generated_turns": _TURNS}
