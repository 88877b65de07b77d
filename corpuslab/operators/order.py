"""Ranks and exact quantiles of groups of any size: counts of equal values, dealt by ranges, and sums over the ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running_counts(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, value, c, before, total): rows of a group with a value, with a lesser value, and with any.

    Equal values are counted first. Counts are dealt by ranges of (groups, value), so a group may be all rows and all
    its values distinct: no task sees more than a range, and what meets per group is one sum for each range. Null values
    are left out; null groups are a group. No rows give no rows.
    """
    return placed_counts(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c")), value, *groups)


def placed_counts(counts: DataFrame, value: str, *groups: str) -> DataFrame:
    """``running_counts`` of rows that are counted (``c``) by group and value."""
    ranged = stored(counts.repartitionByRange(*groups, value).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part", *groups).agg(F.sum("c").alias("rows"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("of_part"), *[F.col(g).alias(f"of_{g}") for g in groups], earlier.alias("earlier"), F.sum("rows").over(whole).alias("total"))
    same = F.col("part") == F.col("of_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    upto = F.sum("c").over(Window.partitionBy("part", *groups).orderBy(value))
    placed = ranged.withColumn("upto", upto).join(parts, same)
    return placed.select(*groups, value, "c", (F.col("earlier") + F.col("upto") - F.col("c")).alias("before"), "total")


def mid_ranks(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, value, c, rank): average ranks from 1 of the distinct values of each group."""
    return _mid(running_counts(df, value, *groups), value, *groups)


def ranks_of_counts(counts: DataFrame, value: str, *groups: str) -> DataFrame:
    """``mid_ranks`` of rows that are counted (``c``) by group and value."""
    return _mid(placed_counts(counts, value, *groups), value, *groups)


def _mid(found: DataFrame, value: str, *groups: str) -> DataFrame:
    return found.select(*groups, value, "c", (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))


def at_ranks(counts: DataFrame, value: str, ranks: Mapping[str, str], *groups: str) -> DataFrame:
    """(groups, total, a column for each of ``ranks``): the values at ranks from 0, given as SQL of ``total``.

    Each row of ``running_counts`` knows which ranks are its own, so this is one aggregation, summed up in each task.
    """
    at = [F.min(F.when((F.col("before") <= F.expr(k)) & (F.expr(k) < F.col("before") + F.col("c")), F.col(value))).alias(name) for name, k in ranks.items()]
    return counts.groupBy(*groups).agg(F.max("total").alias("total"), *at)


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], *groups: str) -> DataFrame:
    """(groups, total, a double for each of ``shares``): quantiles with linear interpolation, as sorted rows would give them."""
    ranks = {}
    for name, q in shares.items():
        ranks[f"{name}__low"] = f"CAST(FLOOR((total - 1) * {q!r}D) AS BIGINT)"
        ranks[f"{name}__high"] = f"CAST(CEIL((total - 1) * {q!r}D) AS BIGINT)"
    found = at_ranks(running_counts(df, value, *groups), value, ranks, *groups)
    place = lambda q: (F.col("total") - 1) * F.lit(q) - F.floor((F.col("total") - 1) * F.lit(q))
    between = [(F.col(f"{n}__low") + (F.col(f"{n}__high") - F.col(f"{n}__low")) * place(float(q))).cast("double").alias(n) for n, q in shares.items()]
    return found.select(*groups, "total", *between)
