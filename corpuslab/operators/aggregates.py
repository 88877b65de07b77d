"""Aggregations of annotated corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import bound
from .order import at_ranks, quantiles, running_counts


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(100.0 * part, whole), digits)


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, pct) of all rows. Null keys are a group of their own; no rows give no rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))  # a window over groups only


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``values`` per row key; absent cells are 0. Null row keys are a row; other values and null count nowhere."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def row_shares(table: DataFrame, row: str) -> DataFrame:
    """Cells in percent of their row; a row of zeros has nulls."""
    cells = [c for c in table.columns if c != row]
    total = sum(map(F.col, cells[1:]), F.col(cells[0]))
    return table.select(row, *[percent(F.col(c), total).alias(c.replace("n_", "pct_")) for c in cells])


def explode_counts(df: DataFrame, items: Column, *keys: str) -> DataFrame:
    """(keys, item, n): in how many rows an item is, however often. Null lists have none; a null item is an item."""
    return df.select(*keys, F.explode(F.array_distinct(items)).alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, k: int, by: str, tie: str, *groups: str) -> DataFrame:
    """The k rows with the most ``by`` (per group), ties by ``tie`` ascending. Null ``by`` comes last; null groups are a group."""
    if not groups:
        return df.orderBy(F.desc(by), tie).limit(k)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(by), tie))).where(F.col("__n") <= k).drop("__n")


def describe(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """n, mean, standard deviation (n - 1), least, quartiles with linear interpolation, most.

    Quartiles come from counts dealt by ranges (``order.quantiles``), so that no task holds a group's values. Null values
    are left out: a group without any other has n 0 and nulls. Null groups are a group.
    """
    v = F.col(value)
    plain = df.groupBy(*groups).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    marks = quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, *groups)
    marks = marks.select(*[F.col(g).alias(f"of_{g}") for g in groups], *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return plain.join(marks, same, "left").select(*groups, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def rank_quartiles(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Nearest-rank quartiles, sorted[n // 4], sorted[n // 2] and sorted[3n // 4], of groups of any size; nulls are left out."""
    counts = running_counts(df, value, *groups)
    return at_ranks(counts, value, {f"q{k}": f"{k} * total DIV 4" for k in (1, 2, 3)}, *groups).withColumnRenamed("total", "n")


def histogram(df: DataFrame, value: str, bins: Sequence[tuple[int, int | None]], *groups: str) -> DataFrame:
    """(groups, bin, n): inclusive bins (low, high); none for no upper end. The first bin that fits counts; null and values
    in no bin are left out, and so are empty bins; null groups are a group."""
    name = F.lit(None).cast("string")
    for low, high in reversed(bins):
        label = f"{low}+" if high is None else f"{low}-{high}"
        name = F.when((F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) <= high), label).otherwise(name)
    return df.withColumn("bin", name).where(F.col("bin").isNotNull()).groupBy(*groups, "bin").agg(F.count("*").alias("n"))


def co_occurrence(df: DataFrame, row_id: str, items: Column) -> DataFrame:
    """(a, b, n), symmetric: rows that hold both. Pairs are made within a row's few items, not by a join of rows. Null lists
    and null items pair with nothing."""
    few = F.array_sort(F.array_distinct(items))
    pairs = bound(few, lambda all_: F.flatten(F.transform(all_, lambda x: F.transform(F.filter(all_, lambda y: y != x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return df.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


def least_distance(tokens: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """The least distance in tokens between a word of one list and one of the other; null if either is absent.

    One pass: the nearest two are neighbours among all words of either list.
    """
    one, two = (lambda t: t.isin(*first)), (lambda t: t.isin(*second))
    kind = lambda t: F.when(one(t) & two(t), 2).when(one(t), 0).when(two(t), 1)
    places = F.filter(F.transform(tokens, lambda t, i: F.struct(kind(t).alias("kind"), i.alias("i"))), lambda x: x.kind.isNotNull())

    def least(found: Column) -> Column:
        n = F.greatest(F.size(found) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda x, y: F.when(x.kind != y.kind, y.i - x.i))
        return F.when(F.exists(found, lambda x: x.kind == 2), F.lit(0)).otherwise(F.array_min(gaps))

    return bound(places, least)


def feature_lift(df: DataFrame, outcome: Column, features: Mapping[str, Column]) -> DataFrame:
    """(feature, n1, rate1, rate0, lift): the outcome's rate with and without each feature, in one scan. A null feature is in
    neither; a null outcome is in no rate; a rate without rows, and its lift, is null."""
    y = outcome.cast("int")
    sums = []
    for k, c in features.items():
        sums += [F.count_if(c).alias(f"{k}__n"), F.avg(F.when(c, y)).alias(f"{k}__1"), F.avg(F.when(~c, y)).alias(f"{k}__0")]
    rows = [F.struct(F.lit(k).alias("feature"), F.col(f"{k}__n").alias("n1"), F.round(f"{k}__1", 6).alias("rate1"), F.round(f"{k}__0", 6).alias("rate0"), F.round(F.col(f"{k}__1") - F.col(f"{k}__0"), 6).alias("lift")) for k in features]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def rates(df: DataFrame, flags: Mapping[str, Column], *groups: str, least: int = 0) -> DataFrame:
    """(groups, n, pct_...): shares of each flag, for groups of ``least`` rows or more. A null flag is left out of its share."""
    out = df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.round(100 * F.avg(c.cast("int")), 4).alias(f"pct_{k}") for k, c in flags.items()])
    return out.where(F.col("n") >= least)


def bigrams(tokens: Column, stop: Sequence[str]) -> Column:
    """Neighbours among tokens of more than two letters, if either is no stop word."""
    long = F.filter(tokens, lambda t: F.length(t) > 2)

    def pairs(found: Column) -> Column:
        n = F.greatest(F.size(found) - 1, F.lit(0))
        return F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda x, y: F.when(~(x.isin(*stop) & y.isin(*stop)), F.concat_ws(" ", x, y)))

    return F.array_compact(bound(long, pairs))
