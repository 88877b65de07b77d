"""Selection: cascades with reasons, funnels, deterministic samples, splits, duplicates, leakage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import pair_rows


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails (true or null: failed), ``ok`` if none."""
    found = F.lit("ok")
    for name, failed in reversed(checks):
        found = F.when(F.coalesce(failed, F.lit(True)), name).otherwise(found)
    return found


def funnel(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, survivors, dropped): how many rows pass the checks up to each, in one scan without a sort of rows."""
    good, sums = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for k, (_, failed) in enumerate(checks, 1):
        good = good & ~F.coalesce(failed, F.lit(True))
        sums.append(F.count_if(good).alias(f"s{k}"))
    one = df.agg(*sums)
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.col(f"s{k}").alias("survivors"), (F.col(f"s{max(k - 1, 0)}") - F.col(f"s{k}")).alias("dropped")) for k, name in enumerate(["input", *(n for n, _ in checks)])]
    return one.select(F.inline(F.array(*rows)))


def order_key(row_id: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can reproduce: md5 of the id and the seed."""
    return F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))))


def hashed_fold(row_id: Column, folds: int, seed: int = 5) -> Column:
    """A row's fold from 0, by md5 of its id: the same on every run and in any engine."""
    return (F.conv(F.substring(order_key(row_id, seed), 1, 7), 16, 10).cast("long") % folds).cast("int")


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: Column | int, row_id: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group.

    A group may be a third of all rows: each of some salts of a group ranks its own rows and passes on ``n`` at most,
    so that the last ranking sees salts * n rows of a group, not all of them.
    """
    out = df.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    for keys in ([*groups, "__salt"], list(groups)):
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)
    return out.drop("__salt", "__n")


def sample_per_group(df: DataFrame, groups: Sequence[str], row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group, all of short groups."""
    keyed = df.withColumn("__key", order_key(F.col(row_id), seed))
    return first_per_group(keyed, groups, [F.col("__key"), F.col(row_id)], n, row_id).drop("__key")


def priority_cap(df: DataFrame, row_id: str, target: str, priority: Column, caps: Sequence[tuple[str, int]], seed: int = 42) -> DataFrame:
    """Up to a cap of rows per target, by priority; a row of several targets stays with the first in the caps' order.

    ``df`` has one row per row id and target. Caps hold before the second step, and nothing is filled up after it.
    """
    cap = F.create_map(*[F.lit(x) for kv in caps for x in kv])
    place = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(caps) for x in (t, i)])
    known = df.where(F.col(target).isin(*[t for t, _ in caps])).withColumn("__p", priority)
    taken = first_per_group(known, [target], [F.col("__p"), order_key(F.col(row_id), seed), F.col(row_id)], F.element_at(cap, F.col(target)), row_id)
    first = taken.withColumn("__at", F.element_at(place, F.col(target))).withColumn("__n", F.row_number().over(Window.partitionBy(row_id).orderBy("__at"))).where(F.col("__n") == 1)
    return first.drop("__p", "__n", "__at")


def split(df: DataFrame, strata: Sequence[str], row_id: str, test_share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: test for round(share * n) rows of each stratum, else train.

    Rows are ranked by md5 within the 4,096 beginnings of the md5, whose counts are added up: no task ranks a stratum.
    """
    keyed = df.withColumn("__key", order_key(F.col(row_id), seed)).withColumn("__bin", F.substring("__key", 1, 3))
    counts = keyed.groupBy(*strata, "__bin").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*strata).orderBy("__bin")
    bins = counts.withColumn("__before", F.sum("__c").over(upto) - F.col("__c")).withColumn("__all", F.sum("__c").over(Window.partitionBy(*strata))).drop("__c")
    ranked = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*strata, "__bin").orderBy("__key", row_id)))
    same = F.lit(True)
    for c in (*strata, "__bin"):
        same = same & ranked[c].eqNullSafe(bins[c])
    joined = ranked.join(bins, same, "left").select(*[ranked[c] for c in [*df.columns, "__n"]], "__before", "__all")
    return joined.withColumn("part", F.when(F.col("__before") + F.col("__n") <= F.round(F.col("__all") * test_share), "test").otherwise("train")).drop("__n", "__before", "__all")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``: a sum that partial aggregation shrinks before the shuffle, no window."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    least = F.min(F.struct(*order, *rest)).alias("__r")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in df.columns if c not in keys]).select(df.columns)


def leaked(train: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Rows of the evaluation whose key is in the training data."""
    return evaluation.join(train.select(key).distinct(), key, "left_semi")


def leaked_texts(train: DataFrame, evaluation: DataFrame, text: str, key: str, normal: Callable[[Column], Column], first: int = 300, head: int = 32, most: int = 1_000_000) -> DataFrame:
    """Rows of the evaluation whose ``key`` is ``normal`` of a ``text`` of the training data.

    ``normal`` changes characters where they are, makes single blanks of several and trims. So the key of a text's
    ``first`` characters begins the whole key: only texts with an item's first ``head`` characters there, or with too few to
    tell, are normalised whole and shuffled. Beginnings are met by hashes, which are broadcast up to ``most`` of them.
    """
    begin = lambda c: F.xxhash64(F.rtrim(F.substring(c, 1, head)))
    known = evaluation.where(F.col(key).isNotNull()).select(begin(F.col(key)).alias("__begin")).distinct().withColumn("__met", F.lit(True))
    texts = train.select(F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    if known.limit(most + 1).count() <= most:
        start = normal(F.substring("__text", 1, first))
        texts = texts.withColumn("__start", start).withColumn("__begin", begin(F.col("__start"))).join(F.broadcast(known), "__begin", "left")
        texts = texts.where(F.col("__met") | ((F.length("__start") < head) & (F.length("__text") > first)))
    whole = F.coalesce(normal(F.col("__text")), F.lit(""))  # never null: else Spark asks all texts' whole keys for nulls before the join above
    return leaked(texts.select(whole.alias(key)), evaluation, key)


def contained(df: DataFrame, row_id: str, tokens: str, items: DataFrame, item_id: str, item: str, least: int = 8) -> DataFrame:
    """(item id, row id): rows that hold all tokens of an item in a row, for items of ``least`` tokens or more.

    Items' first ``least`` tokens find the places: what is joined is their hashes with the row's id and the place, never
    its tokens; only rows that met an item are read again to compare it whole. Null ids never match; an item that a row
    holds twice, and repeated rows or items, give one row.
    """
    start = lambda t, i: F.xxhash64(F.array_join(F.slice(t, i, F.lit(least)), "\x00"))
    known = items.where(F.size(item) >= least).select(F.col(item_id).alias("__item"), F.col(item).alias("__tokens"), start(F.col(item), F.lit(1)).alias("__g"))
    places = F.transform(F.sequence(F.lit(1), F.size(tokens) - (least - 1)), lambda i: F.struct(start(F.col(tokens), i).alias("__g"), i.alias("__at")))
    windows = df.where(F.size(tokens) >= least).select(F.col(row_id).alias("__row"), F.inline(places))
    met = windows.join(known.select("__item", "__g"), "__g").select("__row", "__item", "__at")
    rows = df.select(F.col(row_id).alias("__row"), F.col(tokens).alias("__t")).join(met, "__row")
    whole = rows.join(known.select("__item", "__tokens"), "__item").where(F.slice("__t", F.col("__at"), F.size("__tokens")) == F.col("__tokens"))
    return whole.select(F.col("__item").alias(item_id), F.col("__row").alias(row_id)).distinct()


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def triples(ab: DataFrame, ac: DataFrame, on: str, b: str, c: str) -> DataFrame:
    """(on, b, c) for all pairs of rows of equal text, without null or blank parts.

    A text may be a third of both sides' rows: equal rows meet once, with their number, and their pairs are made by many
    tasks (``joins.pair_rows``).
    """
    some = lambda df, *cols: df.where((F.trim(cols[0]) != "") & (F.trim(cols[1]) != "")).select(*cols)
    return pair_rows(some(ab, on, b), some(ac, on, c), [on]).select(on, b, c)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of small tables of parameters; they have as many rows as parameters, never as data."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(F.broadcast(a))
    return out
