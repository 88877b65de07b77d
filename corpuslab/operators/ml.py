"""Models: logistic and linear regression, clusters, components, term weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import batches
from ..storage import stored


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: n / (classes * n of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = n.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    weights = n.crossJoin(F.broadcast(total)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # one row per class


def logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, weigh: bool = True) -> LogisticRegressionModel:
    """L2 with strength 1 / C on the sum of losses, the intercept free, features as they are.

    Rows with a null label or feature are left out; fewer than two labels among the others are an error.
    """
    df = df.dropna(subset=[label, *features])
    if df.select(label).distinct().limit(2).count() < 2:
        raise ValueError(f"{label} has fewer than two values: nothing to fit")
    data = assembled(balanced(df, label) if weigh else df.withColumn("weight", F.lit(1.0)), features)
    n = data.agg(F.sum("weight")).first()[0] or 1.0
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)


def coefficients(model: LogisticRegressionModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    rows = [*zip(features, map(float, model.coefficients), strict=True), ("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def cross_validated(df: DataFrame, features: Sequence[str], label: str, row_id: str, folds: int = 5) -> DataFrame:
    """(fold, n, accuracy): folds by md5 of the id, so that they are the same on every run."""
    from .select import order_key

    dealt = df.withColumn("fold", (F.conv(F.substring(order_key(F.col(row_id), 5), 1, 7), 16, 10).cast("long") % folds).cast("int"))
    out = None
    for k in range(folds):
        model = logistic(dealt.where(F.col("fold") != k), features, label)
        test = model.transform(assembled(dealt.where(F.col("fold") == k), features))
        one = test.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col(label)).cast("int")), 6).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def ols(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, coefficient, p, r2) by the normal equations, with intercept."""
    from .stats import stars

    model = LinearRegression(labelCol=label, solver="normal", regParam=0.0).fit(assembled(df, features))
    p = list(model.summary.pValues)
    rows = [(f, float(b), float(q), float(model.summary.r2)) for f, b, q in zip([*features, "intercept"], [*model.coefficients, model.intercept], p, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, p double, r2 double").withColumn("stars", stars(F.col("p")))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z scores with the population's deviation; constant ones are 0, and so is null, as the mean would be."""
    s = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    return df.crossJoin(F.broadcast(s)).select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s")), F.lit(0.0)).alias(c) for c in columns])


def kmeans(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, cost, silhouette) per number of clusters. Null vectors are left out; ``k`` below 2 is an error of Spark's, and so are
    fewer distinct vectors than two."""
    data = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(data)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(data)))))
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def clustered(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster`` and ``distance`` to its centre. Rows with a null vector are left out."""
    data = df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed).fit(data)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    found = model.transform(data).withColumn("__c", F.get(centres, F.col("prediction")))
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return found.withColumn("distance", gap).withColumnRenamed("prediction", "cluster").drop("features", "__c")


def centres_of(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """(cluster, centre): the mean vector of each group; null groups and vectors are left out."""
    held = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    return held.groupBy(F.col(group).alias("cluster")).agg(F.array(*[F.avg(F.get(vector, F.lit(k)).cast("double")) for k in range(size)]).alias("centre"))


def assigned(df: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """``df`` with ``cluster`` and ``distance`` of its nearest of some given centres (cluster, centre), equal ones by cluster.

    Centres are parameters, a few rows: they are packed into one and broadcast, and each row looks through them by
    itself. Rows with a null vector are left out; without centres both columns are null.
    """
    packed = centres.agg(F.collect_list(F.struct("cluster", "centre")).alias("__all"))
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, b: a + b))
    near = F.array_min(F.transform("__all", lambda x: F.struct(F.round(gap(x["centre"]), 9).alias("distance"), x["cluster"].alias("cluster"))))
    found = df.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(packed)).withColumn("__near", near)
    return found.select("*", F.col("__near.cluster").alias("cluster"), F.col("__near.distance").alias("distance")).drop("__all", "__near")


def nearest_to_centre(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The ``n`` rows nearest to each cluster's centre, with ``place`` from 1; equal distances by id. A cluster may hold all rows:
    Spark keeps ``n`` rows of each task before they meet."""
    w = Window.partitionBy("cluster").orderBy("distance", row_id)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``df`` with ``components``: its first ``k`` principal components. Rows with a null vector are left out."""
    data = df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="features", outputCol="out").fit(data).transform(data).withColumn("components", vector_to_array("out")).drop("features", "out")


def singular_values(df: DataFrame, vector: str, k: int) -> DataFrame:
    """(component, value): the ``k`` largest singular values; rows stay in the JVM. Null vectors are left out."""
    data = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(data, "features")).computeSVD(k).s
    return df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(found, 1)], "component int, value double")


def term_counts(df: DataFrame, row_id: str, tokens: Column) -> DataFrame:
    """(id, token, n): arrays of each id's distinct tokens and how often it has them. Tasks count whole rows, so nothing is shuffled
    but the counts of ids that several rows have. Written, as tokens cost much to make."""
    kind = df.schema[row_id].dataType.simpleString()

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.cut(frames, "t", 1_000_000):
            rows, words, n, known = batches.counted(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *batches.lists(rows, batch.num_rows, known.take(pa.array(words)), pa.array(n, pa.int64()))], names=[row_id, "token", "n"])

    held = stored(df.select(F.col(row_id).alias("id"), tokens.alias("t")).mapInArrow(work, f"`{row_id}` {kind}, token array<string>, n array<bigint>"))
    again = stored(held.groupBy(row_id).agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(F.col(row_id).alias("__id")))
    if not again.limit(1).count():
        return held
    same = F.col(row_id).eqNullSafe(F.col("__id"))
    summed = held.join(again, same, "left_semi").select(row_id, F.inline(F.arrays_zip("token", "n"))).groupBy(row_id, "token").agg(F.sum("n").alias("n"))
    packed = summed.groupBy(row_id).agg(F.collect_list(F.struct("token", "n")).alias("x"))
    return held.join(again, same, "left_anti").unionByName(packed.select(row_id, F.col("x.token").alias("token"), F.col("x.n").alias("n")))


def tf_idf_rows(df: DataFrame, row_id: str, tokens: Column, most: int, least_docs: int, most_share: float) -> tuple[DataFrame, list[str]]:
    """(id, at, w): each id's terms by number, ascending, and their weights as ``tf_idf`` has them; and the terms in order.

    Counts by row leave tasks once, summed by token, to choose the terms. These (``most``, a parameter) go to the driver and
    to tasks, which weigh whole rows: no weight is shuffled. Ids without terms have empty arrays.
    """
    spark, kind = df.sparkSession, df.schema[row_id].dataType.simpleString()
    counts = term_counts(df, row_id, tokens)
    n = df.count()
    sums = counts.select(F.inline(F.arrays_zip("token", "n"))).groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    terms = sums.where((F.col("df") >= least_docs) & (F.col("df") <= most_share * F.lit(n))).orderBy(F.desc("total"), "token").limit(most)
    chosen = sorted(terms.select("token", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).collect())
    names = [r[0] for r in chosen]
    sent = spark.sparkContext.broadcast((names, np.array([r[1] for r in chosen])))

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value
        known = pa.array(names, pa.string())
        for batch in batches.cut(frames, "token", 1_000_000):
            rows, items = batches.flat(batch.column("token"))
            at = pc.index_in(items, value_set=known)
            held = at.is_valid().to_numpy(zero_copy_only=False)
            n = pc.list_flatten(batch.column("n")).to_numpy()[held]
            rows, at = rows[held], at.drop_null().to_numpy()
            order = np.lexsort((at, rows))
            rows, at, n = rows[order], at[order], n[order]
            w = n * idf[at]
            w /= np.sqrt(np.bincount(rows, weights=w * w, minlength=batch.num_rows))[rows]
            yield pa.RecordBatch.from_arrays([batch.column(row_id), *batches.lists(rows, batch.num_rows, pa.array(at, pa.int32()), pa.array(w, pa.float64()))], names=[row_id, "at", "w"])

    return counts.mapInArrow(work, f"`{row_id}` {kind}, at array<int>, w array<double>"), names


def unpacked(rows: DataFrame, row_id: str, terms: list[str]) -> DataFrame:
    """(id, token, weight) of packed rows (id, at, w): a row for each weight."""
    kind = rows.schema[row_id].dataType.simpleString()

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches.cut(frames, "at", 1_000_000):
            of, at = batches.flat(batch.column("at"))
            yield pa.RecordBatch.from_arrays([batch.column(row_id).take(pa.array(of)), known.take(at), pc.list_flatten(batch.column("w"))], names=[row_id, "token", "weight"])

    return rows.mapInArrow(work, f"`{row_id}` {kind}, token string, weight double")


def tf_idf(df: DataFrame, row_id: str, tokens: Column, most: int, least_docs: int, most_share: float) -> DataFrame:
    """(id, token, weight): smoothed idf ln((1 + n) / (1 + df)) + 1, rows of length one, over the ``most`` frequent
    tokens that are in ``least_docs`` rows or more and in at most ``most_share`` of them (ties by name). Rows without such
    tokens, and null lists, have no weights; rows with one id count as one, but for n."""
    rows, terms = tf_idf_rows(df, row_id, tokens, most, least_docs, most_share)
    return unpacked(rows, row_id, terms)
