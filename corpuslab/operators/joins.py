"""Joins whose hot keys are measured first and dealt to many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a key on one side that may meet in one task.
CELL = 20_000


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], cell: int = CELL) -> DataFrame:
    """The inner join of ``left`` and ``right`` on columns ``on``, many to many, in cells of bounded size.

    Keys with more than ``cell`` rows on a side are hot. A hot key's rows are cut into a grid: each row of one side has
    a line of its own and is copied to every column, and the other way round, so that every two rows meet in exactly
    one cell and a cell has about ``cell`` rows of each side. All other keys have a grid of one cell, and nothing is
    copied. Hot keys are at most rows / ``cell`` of a side; while they are few enough they are broadcast.

    Both sides are written first: the number by which a row is dealt is then the same if a task is run again. Null keys
    join nothing. Rows that are alike are joined each. Column names other than ``on`` must differ.
    """
    on = list(on)
    sides, heavy = [], []
    for df in (left, right):
        held = stored(df.dropna(subset=on))
        sides.append(held.withColumn("__row", F.monotonically_increasing_id()))
        heavy.append(held.groupBy(*on).agg(F.count("*").alias("rows")).where(F.col("rows") > cell))
    (lines, columns) = (h.select(*on, F.ceil(F.col("rows") / cell).cast("int").alias(n)) for h, n in zip(heavy, ("__a", "__b"), strict=True))
    hot = stored(lines.join(columns, on, "full").na.fill(1, ["__a", "__b"]))
    n = hot.count()
    if not n:
        return sides[0].drop("__row").join(sides[1].drop("__row"), on)
    few = F.broadcast(hot) if n <= 100_000 else hot
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("__row"), one(c)).cast("int")
    first = sides[0].join(few, on, "left").withColumn("__i", dealt("__a")).withColumn("__j", every("__b"))
    second = sides[1].join(few, on, "left").withColumn("__j", dealt("__b")).withColumn("__i", every("__a"))
    cells = first.drop("__row", "__a", "__b").join(second.drop("__row", "__a", "__b"), [*on, "__i", "__j"])
    return cells.drop("__i", "__j")


def pair_rows(left: DataFrame, right: DataFrame, on: Sequence[str], most: int = 10_000) -> DataFrame:
    """The same result by distinct rows: equal rows of a side meet the other side once, with how many they are.

    What is shuffled and joined is distinct rows. Pairs are made at the end, ``most`` by a row that is dealt by itself,
    so that a key with very many equal rows on both sides fills many tasks.
    """
    counted = [df.groupBy(*df.columns).agg(F.count("*").alias(n)) for df, n in ((left, "__n"), (right, "__m"))]
    pairs = spread_join(*counted, on).withColumn("__pairs", F.col("__n") * F.col("__m"))
    chunks = pairs.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__pairs") - 1) / most))))
    size = F.least(F.lit(most).cast("long"), F.col("__pairs") - F.col("__chunk") * most)
    names = [*on, *[c for c in (*left.columns, *right.columns) if c not in on]]
    out: Column = F.explode(F.array_repeat(F.lit(True), size.cast("int"))).alias("__x")
    return chunks.repartition(*names, "__chunk").select(*names, out).drop("__x")
