"""Guards and lookups: unexpected values, unmapped groups, persons, lemmas, rationales, types."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_counts

from ..functions.parse import canonical_group


def only_known(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """``df``; the job fails at the first value that is not known. Nothing is counted beforehand."""
    bad = F.concat(F.lit(f"unexpected {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return df.where(F.when(F.coalesce(F.col(column), F.lit("")).isin(*known), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))


def mapped_groups(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``group``, and the distinct names that no rule maps, in order."""
    found = df.withColumn("group", canonical_group(F.col(column)))
    return found.where("group <> 'OTHER'"), found.where("group = 'OTHER'").select(column).distinct().orderBy(column)


def names_person(text: Column, detect: Callable[[str], bool] | None = None, chars: int = 200) -> Column:
    """Whether a text's beginning names a person: by the given function, else two capitalised words in a row inside a
    sentence, which no model backs."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, chars)
    if detect is None:
        return head.rlike("[a-z,] [A-Z][a-z]+ [A-Z][a-z]+")

    @F.pandas_udf("boolean")
    def work(column: pd.Series) -> pd.Series:
        return column.map(detect)

    return work(head)


def lemmas(df: DataFrame, row_id: str, tokens: str, table: DataFrame) -> DataFrame:
    """(row_id, forms): distinct tokens and their lemmas by a lookup table (word, lemma), sorted."""
    each = df.select(row_id, F.explode_outer(F.array_distinct(tokens)).alias("word"))
    forms = each.join(table.select("word", "lemma").distinct(), "word", "left").select(row_id, F.explode(F.array("word", "lemma")).alias("form")).where("form IS NOT NULL")
    found = forms.groupBy(row_id).agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return df.select(row_id).distinct().join(found, row_id, "left").select(row_id, F.coalesce("forms", F.array().cast("array<string>")).alias("forms"))


# Endings of inflected forms and what stands in their place in the base form, by part of speech.
DETACHED = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}


def base_forms(words: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, n, v, a): each distinct word's base form as a noun, a verb and an adjective.

    Candidates are the word itself and what the rules make of its ending, or for a word in ``exceptions`` (word, pos,
    lemma) the word and its lemmas there; those that ``vocabulary`` (word, or word and pos) has are base forms, the
    shortest is taken, of equally short ones the first in bytes. A word without any stays as it is. Candidates are
    looked up by one join, a word's few at a time; null words are left out.
    """
    by_pos = "pos" in vocabulary.columns
    each = words.select("word").where(F.col("word").isNotNull()).distinct()
    rules = [F.when(F.col("word").endswith(old) & (F.length("word") > len(old)), F.struct(F.lit(pos).alias("pos"), F.concat(F.expr(f"substring(word, 1, length(word) - {len(old)})"), F.lit(new)).alias("form"))) for pos, pairs in DETACHED.items() for old, new in pairs]
    own = [F.struct(F.lit(pos).alias("pos"), F.col("word").alias("form")) for pos in DETACHED]
    made = each.select("word", F.inline(F.array_compact(F.array(*own, *rules))))
    if exceptions is not None:
        known = exceptions.select("word", "pos", "lemma").dropna().distinct()
        made = made.where(F.col("word") == F.col("form")).unionByName(made.where(F.col("word") != F.col("form")).join(known.select("word", "pos").distinct(), ["word", "pos"], "left_anti")).unionByName(known.select("word", "pos", F.col("lemma").alias("form")).join(each, "word", "left_semi"))
    there = vocabulary.select(F.col("word").alias("form"), *(["pos"] if by_pos else [])).distinct()
    found = made.join(there, ["form", "pos"] if by_pos else ["form"], "left_semi").groupBy("word").agg(*[F.min(F.when(F.col("pos") == pos, F.struct(F.length("form").alias("l"), "form"))).alias(pos) for pos in DETACHED])
    return each.join(found, "word", "left").select("word", *[F.coalesce(F.col(f"{pos}.form"), F.col("word")).alias(pos) for pos in DETACHED])


def rationale(rationales: Column) -> tuple[Column, Column]:
    """(coverage, span) of the first rationale that marks anything: share of tokens, and tokens from first to last mark;
    null if none marks."""
    first = F.get(F.filter(rationales, lambda r: F.exists(r, lambda x: x == 1)), F.lit(0))
    marked = F.size(F.filter(first, lambda x: x == 1))
    places = F.filter(F.transform(first, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return F.when(first.isNotNull(), F.try_divide(marked.cast("double"), F.size(first))), F.when(first.isNotNull(), F.array_max(places) - F.array_min(places) + 1)


def rationale_medians(df: DataFrame, rationales: str, *groups: str) -> DataFrame:
    coverage, span = rationale(F.col(rationales))
    return df.select(*groups, coverage.alias("c"), span.alias("s")).where("c IS NOT NULL").groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.median("c"), 6).alias("coverage"), F.round(F.median("s"), 6).alias("span"))


def type_rule(kind: Column, rules: Mapping[str, str], default: str) -> Column:
    """The rule for a type's first word; blank, null and unknown types have the default."""
    key = F.upper(F.regexp_extract(F.trim(F.coalesce(kind, F.lit(""))), "^([^ /]*)", 1))
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def by_length(df: DataFrame, text: str) -> DataFrame:
    """Rows of a task from the longest, so that batches hold texts of like length; ids say which is which."""
    return df.withColumn("__l", F.length(text)).sortWithinPartitions(F.desc("__l")).drop("__l")


def turn_columns(df: DataFrame, row_id: str, turn: str, value: str, first: Sequence[int]) -> DataFrame:
    """One row for each conversation: ``turn_k`` for the turns in ``first``, and ``more``, a map of all others by their number.

    Turns that stand there twice give their largest value; a null turn is "null" in the map, a null value empty there. A
    conversation's turns are summed up before they meet, one value for each turn.
    """
    each = df.groupBy(row_id, turn).agg(F.max(value).alias("__v"))
    other = F.col(turn).isNull() | ~F.col(turn).isin(*first)
    entry = F.when(other, F.struct(F.coalesce(F.col(turn).cast("string"), F.lit("null")).alias("key"), F.coalesce("__v", F.lit("")).alias("value")))
    return each.groupBy(row_id).agg(*[F.max(F.when(F.col(turn) == k, F.col("__v"))).alias(f"turn_{k}") for k in first], F.map_from_entries(F.array_compact(F.collect_list(entry))).alias("more"))


def length_batches(df: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """``df`` with ``place`` and ``batch``: all rows from the longest text, ids where lengths are equal, ``size`` to a batch.

    Places come from lengths and ids dealt by ranges (``order.running_counts``), so no task sorts all rows; ``place`` brings
    a batch's results back to its rows. Null texts count as the shortest. Ids are unique; rows with one id share a place.
    """
    key = F.struct((-F.coalesce(F.length(text), F.lit(-1))).alias("length"), F.col(row_id).alias("id"))
    found = running_counts(df.select(key.alias("key")), "key").select(F.col("key.id").alias("__id"), F.col("before").alias("place"))
    joined = df.join(found, F.col(row_id).eqNullSafe(F.col("__id"))).drop("__id")
    return joined.withColumn("batch", F.floor(F.col("place") / size))
