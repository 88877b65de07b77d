"""Descriptive and inferential statistics in closed form over counts, ranks and sums."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .joins import CELL
from .order import mid_ranks, ranks_of_counts


def confusion(df: DataFrame, truth: Column, predicted: Column, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count_if((truth == 1) & (predicted == 1)).alias("tp"), F.count_if((truth == 0) & (predicted == 1)).alias("fp"),
        F.count_if((truth == 1) & (predicted == 0)).alias("fn"), F.count_if((truth == 0) & (predicted == 0)).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def macro_f1(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> Column:
    a, b, c, d = map(F.col, (tp, fp, fn, tn))
    return (f1(a, b, c) + f1(d, c, b)) / 2


def metrics(table: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and macro F1 of confusion counts; 0 where a share has no base."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return table.select(
        "*", F.round(_ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(f1(tp, fp, fn), 6).alias("f1"), F.round(macro_f1(), 6).alias("macro_f1"),
    )


def tail_formula(x: str) -> str:
    """Both tails of the normal distribution beyond ``x`` >= 0 deviations, as SQL: a series below 3, a continued fraction above."""
    near, far = "1.0", f"{x}"
    for k in range(60, 0, -1):
        near = f"(1.0 + {x} * {x} / {2 * k + 1}.0 * {near})"
        far = f"({x} + {k}.0 / {far})"
    density = f"exp(-{x} * {x} / 2.0) * 0.7978845608028654"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0.0 THEN CAST(1.0 AS DOUBLE) WHEN {x} < 3.0 THEN 1.0 - {density} * {x} * {near} ELSE {density} / {far} END"


def with_tails(df: DataFrame, deviations: Column, name: str = "p") -> DataFrame:
    """``df`` with the two-sided p of a normal statistic; 1 at or below 0, null where the statistic is null."""
    kept = [f"`{c}`" for c in df.columns if c != name]
    return df.withColumn("__x", deviations.cast("double")).select(*kept, F.expr(tail_formula("__x")).alias(name))


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """(n1, n0, u, z, p): two-sided test of group 1 against group 0, ties corrected, with continuity correction.

    Null values and groups are left out. With an empty group, or one value only, z and p are null; without rows u too.
    """
    rows = df.select(F.col(value), group.cast("int").alias("g")).where(F.col(value).isNotNull() & F.col("g").isNotNull())
    sizes = rows.groupBy(value).agg(F.sum("g").alias("one"), F.count("*").alias("both"))
    joined = sizes.join(mid_ranks(rows, value), value)
    s = joined.agg(F.sum("one").alias("n1"), F.sum(F.col("both") - F.col("one")).alias("n0"), F.sum(F.col("one") * F.col("rank")).alias("r"), F.sum(F.pow(F.col("both").cast("double"), 3) - F.col("both")).alias("t"))
    s = s.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n1", "n0")})
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0")
    u = F.col("r") - n1 * (n1 + 1) / 2
    mean, spread = n1 * n0 / 2, F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("t"), n * (n - 1))))
    z = F.try_divide(F.abs(u - mean) - 0.5, F.when(spread > 0, spread))
    found = with_tails(s.select("n1", "n0", F.round(u, 4).alias("u"), z.alias("z")), F.col("z"))
    return found.select("n1", "n0", "u", F.round("z", 4).alias("z"), F.round("p", 6).alias("p"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.join(mid_ranks(rows, a).select(a, F.col("rank").alias("ra")), a).join(mid_ranks(rows, b).select(b, F.col("rank").alias("rb")), b)
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def spearman_matrix(df: DataFrame, columns: Sequence[str], few: int = 100_000) -> DataFrame:
    """(a, b, n, rho) for every two of ``columns``, a before b: correlation of average ranks.

    Values are counted column by column and ranked together, dealt by ranges. Rows stay whole: a column of at most ``few``
    values takes its ranks by a broadcast where the rows are, another by one join on its value (``with_ranks``). One
    aggregation sums all products. Rows with a null in any of the columns are left out, so that all pairs rest on the
    same rows. A constant column has no rho (null); without rows n is 0.
    """
    names = [f"v{k}" for k in range(len(columns))]
    wide = stored(df.select(*[F.col(c).cast("double").alias(v) for c, v in zip(columns, names, strict=True)]).dropna().withColumn("row", F.monotonically_increasing_id()))
    counts = [wide.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("c")).select(F.lit(k).alias("k"), "v", "c") for k, v in enumerate(names)]
    ranks = stored(ranks_of_counts(reduce(DataFrame.unionByName, counts), "v", "k"))
    distinct = {r["k"]: r["n"] for r in ranks.groupBy("k").agg(F.count("*").alias("n")).collect()}
    n = wide.count()
    for k, v in sorted(enumerate(names), key=lambda x: distinct.get(x[0], 0)):
        of = ranks.where(F.col("k") == k).select(F.col("v").alias(v), "c", F.col("rank").alias(f"r{k}"))
        wide = with_ranks(wide, of, v, f"r{k}", None if distinct.get(k, 0) <= few else max(CELL, n // few))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    one = wide.agg(F.count("*").alias("n"), *[F.try_divide(F.covar_pop(f"r{i}", f"r{j}"), F.stddev_pop(f"r{i}") * F.stddev_pop(f"r{j}")).alias(f"c{i}_{j}") for i, j in pairs])
    found = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col("n"), F.round(f"c{i}_{j}", 6).alias("rho")) for i, j in pairs])
    return one.select(F.inline(found))


def with_ranks(rows: DataFrame, ranks: DataFrame, value: str, rank: str, hot: int | None) -> DataFrame:
    """``rows`` with ``rank`` in place of ``value``, from ``ranks`` (value, c, rank), which has every value of the rows.

    Without ``hot`` all ranks are broadcast. Else those of values with more than ``hot`` rows are, and their rows are dealt
    by number (``row``) to keys that meet nothing, so that no value is one task's; all other rows are joined by value.
    """
    if hot is None:
        return rows.join(F.broadcast(ranks.select(value, rank)), value).drop(value)
    known = rows.join(F.broadcast(ranks.where(F.col("c") > hot).select(value, F.col(rank).alias("__hot"))), value, "left")
    known = known.withColumn("__deal", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.col("row")))
    # 0 by way of c: of a literal, Spark makes a condition beside the join, and rows are dealt by value alone.
    rest = ranks.where(F.col("c") <= hot).select(value, rank, F.least("c", F.lit(0)).cast("long").alias("__deal"))
    joined = known.join(rest.hint("merge"), [value, "__deal"], "left")
    return joined.select(*[c for c in rows.columns if c != value], F.coalesce("__hot", rank).alias(rank))


def auc(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum of the positives."""
    found = mann_whitney(df, score, truth)
    return found.select(F.round(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")), 6).alias("auc"))


def chi_square(a: Column, b: Column, c: Column, d: Column, yates: bool = True) -> Column:
    """Of the counts a b / c d; null if a margin is empty."""
    n = (a + b + c + d).cast("double")
    gap = F.abs(a.cast("double") * d - b.cast("double") * c)
    gap = F.greatest(F.lit(0.0), gap - n / 2) if yates else gap
    return F.try_divide(n * gap * gap, (a + b).cast("double") * (c + d) * (a + c) * (b + d))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.try_divide(a.cast("double") * d, b.cast("double") * c)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def exact_p(b: int | None, c: int | None) -> float:
    """Two-sided exact binomial p of discordant counts; 1 without any.

    Probabilities are added downwards from the smaller count until they no longer count: as many as the root of the
    counts, not as the counts.
    """
    n, k = (b or 0) + (c or 0), min(b or 0, c or 0)
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    tail = 0.0
    while term > tail * 1e-17 and k >= 0:
        tail += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * tail)


def mcnemar_p(b: str, c: str) -> Column:
    """``exact_p`` of two columns: one call for a whole table's counts."""
    return F.udf(exact_p, "double")(b, c)


def mcnemar(df: DataFrame, truth: Column, first: Column, second: Column) -> DataFrame:
    only = df.agg(F.count_if((first == truth) & (second != truth)).alias("b_only_first"), F.count_if((first != truth) & (second == truth)).alias("c_only_second"))
    return only.withColumn("p_value", F.round(mcnemar_p("b_only_first", "c_only_second"), 6))


def binomial_quantile(u: float, n: int, p: float) -> int:
    """The least k whose probability of at most k successes in n draws is u or more.

    Probabilities are added from twelve deviations below the mean on, each from the last: a number of steps that grows
    with the root of n.
    """
    if n <= 0 or p <= 0.0:
        return 0
    if p >= 1.0:
        return n
    around = 12 * math.sqrt(n * p * (1 - p)) + 30
    low, high = max(0, math.floor(n * p - around)), min(n, math.ceil(n * p + around))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.concatenate([[math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)], np.log((n - k) / (k + 1)) + (math.log(p) - math.log1p(-p))])
    return low + min(int(np.searchsorted(np.cumsum(np.exp(np.cumsum(steps))), u)), high - low)


def multinomial_draws(counts: DataFrame, cells: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """(r, cells): for each replicate, how often each cell is drawn in as many draws with replacement as there are rows.

    ``counts`` is one row with a count for each cell. Of the draws that are left, the next cell gets a binomial number,
    by inversion of a number from the md5 of replicate and cell; so draws are exact, and any engine makes the same. The
    cost is replicates * cells, whatever the number of rows.
    """
    draws = counts.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cells], F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    draws = draws.select("r", *cells, *[uniform(F.col("r"), F.lit(k), F.lit(seed)).alias(f"u{k}") for k in range(len(cells) - 1)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                sizes = [getattr(row, c) for c in cells]
                left, mass, drawn = sum(sizes), sum(sizes), []
                for k, size in enumerate(sizes[:-1]):
                    drawn.append(binomial_quantile(getattr(row, f"u{k}"), left, size / mass) if mass else 0)
                    left -= drawn[-1]
                    mass -= size
                out.append((row.r, *drawn, left))
            yield pd.DataFrame(out, columns=["r", *cells])

    return draws.repartition(F.col("r") % 64).mapInPandas(work, f"r int, {', '.join(f'{c} long' for c in cells)}")


def bootstrap_delta(df: DataFrame, truth: Column, first: Column, second: Column, replicates: int, seed: int = 42) -> DataFrame:
    """(lo, med, hi): the difference of macro F1 of the second and the first prediction, over bootstrap replicates.

    Macro F1 rests on the eight counts of truth and two predictions, so replicates are drawn from the counts. Rows with a
    null in any of the three are left out; without rows all differences are 0.
    """
    cell = truth * 4 + first * 2 + second
    cells = [f"w{k}" for k in range(8)]
    counts = df.agg(*[F.count_if(cell == k).alias(c) for k, c in enumerate(cells)])
    wide = multinomial_draws(counts, cells, replicates, seed)
    w = lambda t, p, at: sum((F.col(f"w{k}") for k in range(8) if k >> 2 == t and (k >> (1 - at)) & 1 == p), F.lit(0))
    score = lambda at: (f1(w(1, 1, at), w(0, 1, at), w(1, 0, at)) + f1(w(0, 0, at), w(1, 0, at), w(0, 1, at))) / 2
    delta = wide.select((score(1) - score(0)).alias("d"))
    return delta.agg(*[F.round(F.percentile("d", q), 4).alias(k) for k, q in (("lo", 0.025), ("med", 0.5), ("hi", 0.975))])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine: seven hex digits over 16**7."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long") / float(16**7)


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """(n, slope, intercept, r2) with one regressor."""
    return df.agg(F.regr_count(y, x).alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))
