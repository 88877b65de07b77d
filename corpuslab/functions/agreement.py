"""Votes of annotators: majority, agreement, minority. 0 hate, 1 normal, 2 offensive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(votes: Column, value: Column) -> Column:
    return F.size(F.filter(votes, lambda x: x == value))


def majority(votes: Column, tie: str = "first") -> Column:
    """The most frequent vote. Ties: the one seen ``first``, or -1 with ``none``. No votes: null."""
    best = F.array_max(F.transform(votes, lambda v: _count(votes, v)))
    top = F.filter(F.array_distinct(votes), lambda v: _count(votes, v) == best)
    first = F.get(top, F.lit(0))
    return first if tie == "first" else F.when(F.size(top) > 1, F.lit(-1)).otherwise(first)


def agreement(votes: Column) -> Column:
    """unanimous, split (all differ) or majority; null without votes."""
    kinds = F.size(F.array_distinct(votes))
    return F.when(F.size(votes) == 0, F.lit(None)).when(kinds == 1, "unanimous").when(kinds == F.size(votes), "split").otherwise("majority")


def normal_share(votes: Column, normal: int = 1) -> Column:
    return F.try_divide(_count(votes, F.lit(normal)).cast("double"), F.size(votes))


def agreement_bucket(votes: Column) -> Column:
    share = normal_share(votes)
    return F.when(share >= 0.99, "perfect").when(share >= 0.5, "majority").otherwise("minority")


def is_borderline(votes: Column) -> Column:
    return _count(votes, F.lit(1)) == 2


def label_name(code: Column) -> Column:
    return F.when(code == 0, "hate").when(code == 1, "normal").when(code == 2, "offensive")


def set_agreement(first: Column, second: Column, third: Column) -> Column:
    """all_same, all_different or partial, of three annotators' sets (arrays)."""
    sets = F.array(*[F.array_join(F.array_sort(F.array_distinct(x)), ",") for x in (first, second, third)])
    kinds = F.size(F.array_distinct(sets))
    return F.when(kinds == 1, "all_same").when(kinds == 3, "all_different").otherwise("partial")
