"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Beyond this many open places numpy's hypergeometric generator refuses; places are then drawn one by one.
LARGE = 900_000_000


def draw_row(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each shard when every open place is as likely: one row of the matrix."""
    if places.sum() < LARGE:
        return rng.multivariate_hypergeometric(places, n)
    chosen = np.empty(0, np.int64)
    while len(chosen) < n:  # distinct places; few collide, as n is small against them
        chosen = np.unique(np.concatenate([chosen, rng.integers(0, places.sum(), n - len(chosen))]))
    return np.bincount(np.searchsorted(np.cumsum(places), chosen, side="right"), minlength=len(places))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows: partitions with ``counts`` rows. Columns: shards whose sizes differ by one at most. Sums are exact."""
    total = sum(counts)
    rng = np.random.default_rng(seed)
    places = np.full(n_shards, total // n_shards, np.int64)
    places[rng.permutation(n_shards)[: total % n_shards]] += 1
    out = np.zeros((len(counts), n_shards), np.int64)
    for i, n in enumerate(counts):
        out[i] = draw_row(rng, places, n)
        places -= out[i]
    return out


def shuffle_shards(df: DataFrame, n_shards: int, seed: int = 7, rows_per_part: int = 200_000) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard), uniformly at random.

    Rows are first dealt to many parts of bounded size whatever the input's partitions or keys are, so no key, source
    or group of copies makes a part large. Each part is permuted by random keys and cut by its row of the matrix,
    exchanged, and permuted again within the shard; a shard is ordered in cells of bounded size, which share one
    random order. Random keys are written before they are read twice, so a lost executor cannot change them.

    Nulls, empty or long texts, ties and repeated rows are rows like others. No rows give no rows. Columns of the
    input named shard or slot are replaced.
    """
    spark = df.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")])
    n = df.count()
    parts, cells = max(64, math.ceil(n / rows_per_part)), max(1, math.ceil(n / n_shards / rows_per_part))
    keyed = written(df.select(row.alias("row"), F.monotonically_increasing_id().alias("uid"), F.floor(F.rand(seed) * parts).cast("int").alias("part"), F.rand(seed + 1).alias("first"), F.rand(seed + 2).alias("second")), "shard-keys")
    thin = keyed.drop("row")
    counts = sorted(thin.groupBy("part").count().collect())
    matrix = communication_matrix([c["count"] for c in counts], n_shards, seed)
    cuts = spark.createDataFrame([(c["part"], x) for c, x in zip(counts, np.cumsum(matrix, axis=1).tolist(), strict=True)], "part int, cuts array<long>")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first", "uid"))
    placed = written(
        thin.withColumn("rank", rank).join(cuts, "part").select("uid", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).alias("shard"), F.floor(F.col("second") * cells).cast("int").alias("cell"), "second"),
        "shard-places",
    )
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("second", "uid"))
    slots = placed.withColumn("inside", inside).join(offsets, ["shard", "cell"]).select("uid", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    return keyed.select("uid", "row").join(slots, "uid").select("row.*", "shard", "slot")


def op1_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``. A null text has no bytes: size 8, checksum 0.

    Groups are rows of equal text, told by ``text_crc32``; a uniform shuffle spreads them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_shards(digest, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
