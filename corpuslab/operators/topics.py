"""Clusters of texts: sparse TF-IDF rows, a randomised truncated SVD, k-means in its space, profiles of the clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .select import first_per_group, order_key


@dataclass
class Space:
    """Terms and their directions: ``vectors`` has a row for each term; ``values`` are singular values, the largest first;
    ``explained`` is the share of the rows' variance that each direction keeps."""

    terms: list[str]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def sparse_rows(weights: DataFrame, ids: DataFrame, row_id: str, most: int) -> tuple[DataFrame, list[str]]:
    """(id, at, w): each row's terms by number and their weights, and the terms in order. Rows without terms are empty.

    ``weights`` is (id, token, weight) of at most ``most`` terms (a parameter of TF-IDF): more are an error, as the
    terms go to the driver. A row has as many entries as it has terms.
    """
    terms = [r[0] for r in weights.select("token").distinct().limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} terms")
    terms.sort()
    numbers = ids.sparkSession.createDataFrame([(t, k) for k, t in enumerate(terms)], "token string, k int")
    packed = weights.join(F.broadcast(numbers), "token").groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("k", "weight"))).alias("x"))
    rows = ids.select(row_id).join(packed, row_id, "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return stored(rows.select(F.col(row_id).alias("id"), empty("x.k", "array<int>").alias("at"), empty("x.weight", "array<double>").alias("w"))), terms


def _times(batch: pa.RecordBatch, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's rows times ``matrix``, and its entries: row, term, weight."""
    at, w = (batch.column(c) for c in ("at", "w"))
    n = np.diff(at.offsets.to_numpy()) if len(at) else np.empty(0, np.int64)
    terms, weights, rows = at.flatten().to_numpy(), w.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), matrix.shape[1]))
    _add(out, rows, matrix, terms, weights)
    return out, rows, terms, weights


def _add(out: np.ndarray, to: np.ndarray, matrix: np.ndarray, of: np.ndarray, weights: np.ndarray) -> None:
    """Rows ``of`` the matrix, weighed, are added to the rows ``to``, which ascend."""
    for low in range(0, len(to), 50_000):
        part = slice(low, low + 50_000)
        first = np.flatnonzero(np.append(True, np.diff(to[part]) > 0))
        out[to[part][first]] += np.add.reduceat(matrix[of[part]] * weights[part, None], first)


def _sum_rows(rows: DataFrame, per_task, width: int) -> np.ndarray:  # noqa: ANN001
    """Matrices that ``per_task(batches)`` makes, added up: tasks hand on rows (number, numbers), Spark adds them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = per_task(batches)
        used = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(found[used]), pa.list_(pa.float64()))], names=["k", "x"])

    summed = rows.mapInArrow(work, "k int, x array<double>").groupBy("k").agg(*[F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(width)])
    return summed.toPandas().set_index("k")


def truncated_svd(rows: DataFrame, terms: list[str], k: int = 50, extra: int = 10, rounds: int = 2, seed: int = 42) -> Space:
    """The ``k`` largest singular values of the rows' matrix, with directions, by random projection and power rounds.

    Each round is one scan: a task multiplies its rows with the directions so far and their products back onto the
    terms; what is shuffled and comes to the driver is terms * (k + extra) numbers for each task, whatever the number of
    rows, as terms are bounded. Directions are made orthogonal by a QR there. With fewer terms or rows than ``k`` there
    are as many values as there are terms; those beyond the rank are 0.
    """
    m = len(terms)
    width = min(k + extra, m)
    if not m:
        return Space([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, width)))[0]

    def back(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> np.ndarray:
        out = np.zeros((m, width))
        for batch in batches:
            y, at, terms_, w = _times(batch, basis)
            order = np.argsort(terms_, kind="stable")
            _add(out, terms_[order], y, at[order], w[order])
        return out

    for _ in range(rounds + 1):
        found = _sum_rows(rows, lambda batches, basis=basis: back(batches, basis), width)
        z = np.zeros((m, width))
        z[found.index.to_numpy()] = found.to_numpy()
        basis = np.linalg.qr(z)[0]

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Products of the projected rows; below them their sums, and sums of squares of all weights by term."""
        out = np.zeros((width + 1, width))
        for batch in batches:
            y = _times(batch, basis)[0]
            out[:width] += y.T @ y
            out[width] += y.sum(axis=0)
        return out

    found = _sum_rows(rows, gram, width).reindex(range(width + 1), fill_value=0.0).to_numpy()
    power, turn = np.linalg.eigh(found[:width])
    order = np.argsort(-power)[:k]
    values, turn = np.sqrt(np.maximum(power[order], 0)), turn[:, order]
    n = rows.count()
    term_sums = rows.select(F.explode(F.arrays_zip("at", "w")).alias("e")).groupBy("e.at").agg(F.sum("e.w").alias("s"), F.sum(F.col("e.w") * F.col("e.w")).alias("q"))
    total = term_sums.agg(F.sum(F.col("q") / n - F.pow(F.col("s") / n, 2))).first()[0] or 0.0
    kept = values**2 / n - (found[width] @ turn / n) ** 2
    return Space(terms, basis @ turn, values, kept / total if total > 0 else np.zeros(len(values)))


def reduced(rows: DataFrame, space: Space) -> DataFrame:
    """(id, x): rows in the space's coordinates."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(_times(batch, space.vectors)[0]), pa.list_(pa.float64()))], names=["id", "x"])

    return rows.mapInArrow(work, f"id {kind}, x array<double>")


def sampled_silhouette(df: DataFrame, vector: str, cluster: str, row_id: str, n: int = 5000, seed: int = 42) -> float:
    """Mean silhouette (Euclidean) of ``n`` rows against each other, as is usual for large data; nan with one cluster.

    The sample is drawn by md5 of the id; ``n`` bounds what is broadcast, and distances are taken in blocks by tasks.
    """
    sample = stored(df.orderBy(order_key(F.col(row_id), seed)).limit(n).select(F.col(vector).alias("x"), F.col(cluster).cast("int").alias("c")))
    held = sample.toPandas()
    if held["c"].nunique() < 2:
        return float("nan")
    points, labels = np.array(held["x"].tolist()), held["c"].to_numpy()
    own = np.unique(labels)
    counts = np.array([(labels == c).sum() for c in own])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, c = np.array(pdf["x"].tolist()), pdf["c"].to_numpy()
            gaps = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0))
            sums = np.column_stack([gaps[:, labels == k].sum(axis=1) for k in own])
            mine = np.searchsorted(own, c)
            at = np.arange(len(c))
            inside = sums[at, mine] / np.maximum(counts[mine] - 1, 1)
            means = sums / counts
            means[at, mine] = np.inf
            outside = means.min(axis=1)
            yield pd.DataFrame({"s": np.where(counts[mine] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)})

    return float(sample.repartition(16).mapInPandas(work, "s double").agg(F.avg("s")).first()[0])


def profiles(df: DataFrame, cluster: str, row_id: str, weights: DataFrame, shares: dict[str, Column], length: Column, items: Column, n_items: int = 3, n_terms: int = 6) -> DataFrame:
    """(cluster, n, pct, pct_..., mean_len, items, terms): a line for each cluster.

    ``shares`` are rates in percent; ``items`` the most frequent of the rows' item lists with their rate ("a(40%), b(3%)");
    ``terms`` those with the highest mean weight over the cluster's rows, rows without them counting as 0. Ties go by
    name. Null clusters are left out; clusters without items or terms have empty lists.
    """
    rows = stored(df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.col(row_id).alias("id"), *[c.cast("int").alias(f"is_{k}") for k, c in shares.items()], length.alias("len"), items.alias("items")))
    plain = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(f"is_{k}"), 4).alias(f"pct_{k}") for k in shares], F.round(F.avg("len"), 4).alias("mean_len"))
    total = plain.agg(F.sum("n").alias("all"))
    sizes = plain.select("cluster", F.col("n").alias("of"))
    held = rows.select("cluster", F.explode(F.array_distinct("items")).alias("name")).groupBy("cluster", "name").agg(F.count("*").alias("score")).join(sizes, "cluster")
    told = held.withColumn("text", F.concat("name", F.lit("("), F.round(100 * F.col("score") / F.col("of")).cast("int").cast("string"), F.lit("%)")))
    mean = weights.select(F.col(row_id).alias("id"), F.col("token").alias("name"), "weight").join(rows.select("cluster", "id"), "id")
    terms = mean.groupBy("cluster", "name").agg(F.sum("weight").alias("sum")).join(sizes, "cluster").select("cluster", "name", F.round(F.col("sum") / F.col("of"), 9).alias("score"), F.col("name").alias("text"))

    def best(found: DataFrame, n: int, name: str) -> DataFrame:
        top = first_per_group(found.select("cluster", "name", "score", "text"), ["cluster"], [F.desc("score"), F.col("name")], n, "name")
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", "text")))
        return top.groupBy("cluster").agg(F.array_join(ordered["text"], ", ").alias(name))

    out = plain.crossJoin(F.broadcast(total)).join(best(told, n_items, "items"), "cluster", "left").join(best(terms, n_terms, "terms"), "cluster", "left")
    rates: Sequence[str] = [f"pct_{k}" for k in shares]
    return out.select("cluster", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("pct"), *rates, "mean_len", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("terms", F.lit("")).alias("terms"))
