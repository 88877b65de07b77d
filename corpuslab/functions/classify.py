"""Text classifiers: tokens against lists, text against patterns, ordered rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import (
    ATTACK_TYPES, CATEGORIES, COMMANDS, EXCLUSION_PHRASES, FIRST_COMMANDS, FIRST_MOCKING, FRAMES, GENERAL_VERBS, GENERAL_WORDS, GROUP_MARKERS, HATE_PHRASES, INDIVIDUAL_MARKERS, MEDIUM, MOCKING_WORDS,
    NARRATIVE_WORDS, PAST_WORDS, QUANTIFIERS, QUESTION_WORDS, STRONG, WEAK, WISHES, Frame,
)


def words(*terms: str) -> Column:
    return F.array(*map(F.lit, terms))


def has_any(tokens: Column, terms: Sequence[str]) -> Column:
    """Whether a token is one of the terms. Terms of several words can't be tokens; use ``has_phrase``."""
    return F.arrays_overlap(tokens, words(*terms))


def hits(tokens: Column, terms: Sequence[str]) -> Column:
    """The tokens that are terms, in text order, repeats kept."""
    return F.filter(tokens, lambda t: t.isin(*terms))


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def whole_word(text: Column, terms: Sequence[str]) -> Column:
    """Terms between other characters than letters, digits and _ (ASCII)."""
    return text.rlike(f"(^|[^A-Za-z0-9_])({'|'.join(terms)})($|[^A-Za-z0-9_])")


def category_flags(tokens: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> dict[str, Column]:
    return {k: has_any(tokens, v).cast("int") for k, v in categories.items()}


def has_negation(text: Column) -> Column:
    """Substrings, so that "know" holds "no": kept as it is. ``has_negation_word`` looks at whole tokens."""
    return has_phrase(F.lower(text), ("not", "no", "never", "n't"))


def has_negation_word(tokens: Column) -> Column:
    return has_any(tokens, ("not", "no", "never"))


def has_conditional(tokens: Column) -> Column:
    return has_any(tokens, ("if", "would", "could", "should", "unless"))


def java(pattern: str) -> str:
    """A pattern of the tables for Java: a word's bounds in ASCII (Java's own depend on its version), lines end at \\n only."""
    starts = re.sub(r"\\b(?=\w)", "(?<![A-Za-z0-9_])", pattern)
    return "(?d)" + re.sub(r"(?<=\w)\\b", "(?![A-Za-z0-9_])", starts)


def _found(text: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches. The letters that a pattern begins with are looked for first, which costs less."""
    hit = F.lit(False)
    for p in patterns:
        head = re.match(r"\\b([a-z' ]+)", p)
        hit = hit | (text.contains(head[1]) & text.rlike(java(p)) if head else text.rlike(java(p)))
    return hit


def frames(tokens: Column, text: Column, table: Sequence[Frame] = FRAMES) -> Column:
    """All matching frames in table order; NONE_DETECTED if none does. ``text`` is lower-case."""
    found = []
    for f in table:
        hit = has_any(tokens, f.words) if f.words else F.lit(False)
        if f.patterns:
            hit = hit | _found(text, f.patterns)
        found.append(F.when(hit, F.lit(f.name)))
    return _or_none(found)


def _or_none(found: Sequence[Column]) -> Column:
    return bound(F.array_compact(F.array(*found)), lambda x: F.when(F.size(x) == 0, words("NONE_DETECTED")).otherwise(x))


def frames_by_sets(tokens: Column, text: Column, table: Sequence[Frame] = FRAMES) -> Column:
    """The version by sets of tokens: exclusion by phrases within the text, generalisation by a quantifier and a verb anywhere."""
    rules = {"EXCLUSION": has_phrase(text, EXCLUSION_PHRASES), "GENERALIZATION": has_any(tokens, QUANTIFIERS) & has_any(tokens, GENERAL_VERBS)}
    return _or_none([F.when(rules[f.name] if f.name in rules else has_any(tokens, f.words), F.lit(f.name)) for f in table])


def frame_items(tokens: Column, text: Column, frame: Frame) -> Column:
    """What matched: the frame's tokens, then the first match of each pattern."""
    found = hits(tokens, frame.words) if frame.words else F.array().cast("array<string>")
    firsts = [F.regexp_extract(text, f"({java(p)})", 1) for p in frame.patterns]
    return F.concat(found, F.filter(F.array(*firsts), lambda x: x != "")) if firsts else found


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def speech_acts(tokens: Column, text: Column) -> Column:
    """Every act that a rule finds, in this order; OTHER if none does."""
    n = F.size(tokens)
    follows = F.exists(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda t: t.isin("are", "is", "was", "were"))
    first = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    rules = {
        "DIRECT_ADDRESS": F.array_contains(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), "you"),
        "GROUP_STATEMENT": has_any(tokens, ("they", "all", "every")) & follows,
        "IMPERATIVE": has_any(F.slice(tokens, 1, 3), COMMANDS),
        "QUESTION": text.contains("?") | first.isin(*QUESTION_WORDS),
        "WISH_DESIRE": has_any(tokens, ("wish", "hope", "should", "deserve")) | has_phrase(text, ("need to", "want to")),
        "NARRATIVE": F.size(hits(tokens, PAST_WORDS)) >= 2,
        "SHORT_LABEL": n <= 6,
        "MOCKERY_SARCASM": has_any(tokens, MOCKING_WORDS),
        "HATE_DECLARATION": F.array_contains(tokens, "hate") & has_any(tokens, ("i", "we")),
    }
    listed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return bound(listed, lambda x: F.when(F.size(x) == 0, words("OTHER")).otherwise(x))


def speech_act(tokens: Column, text: Column) -> Column:
    """The first act that fits; UNCLEAR if none does."""
    n = F.size(tokens)
    return (
        F.when(has_any(tokens, ("you", "your")), "DIRECT_ADDRESS")
        .when(has_any(F.slice(tokens, 1, 3), FIRST_COMMANDS), "IMPERATIVE")
        .when(has_phrase(text, WISHES), "WISH_DESIRE")
        .when(has_any(tokens, FIRST_MOCKING), "MOCKERY_SARCASM")
        .when(n <= 6, "SHORT_LABEL")
        .when(has_any(tokens, GENERAL_WORDS), "GROUP_STATEMENT")
        .when(text.contains("?"), "QUESTION")
        .when(has_phrase(text, HATE_PHRASES), "HATE_DECLARATION")
        .when(has_any(tokens, NARRATIVE_WORDS) & (n > 15), "NARRATIVE")
        .otherwise("UNCLEAR")
    )


def reference_scope(tokens: Column) -> Column:
    group, one = has_any(tokens, GROUP_MARKERS), has_any(tokens, INDIVIDUAL_MARKERS)
    return F.when(group & one, "MIXED").when(group, "GROUP_ONLY").when(one, "INDIVIDUAL_ONLY").otherwise("UNCLEAR")


def cue_strength(tokens: Column) -> Column:
    return F.when(has_any(tokens, STRONG), "Strong").when(has_any(tokens, MEDIUM), "Medium").when(has_any(tokens, WEAK), "Weak").otherwise("None")


def attack_type(text: Column, default: str = "NONE_DETECTED") -> Column:
    from .parse import first_containing

    return first_containing(text, ATTACK_TYPES, default)


def category_strength(categories: Column) -> Column:
    """Strength class of a row by the categories that it holds: the strongest counts."""
    return F.when(F.arrays_overlap(categories, words("moral")), "strong").when(F.arrays_overlap(categories, words("ability")), "medium").when(F.arrays_overlap(categories, words("status")), "weak").otherwise("Other")


def reclassified(tokens: Column, text: Column) -> Column:
    """(kind, reason): explicit by a strong word, casual by another, contextual by a pattern, else none."""
    found = F.coalesce(F.get(hits(tokens, STRONG), F.lit(0)), F.get(hits(tokens, (*MEDIUM, *WEAK)), F.lit(0)))
    kind = F.when(has_any(tokens, STRONG), "explicit").when(has_any(tokens, (*MEDIUM, *WEAK)), "casual").when(text.rlike("the .{0,30} is"), "contextual").otherwise("none")
    return F.struct(kind.alias("kind"), F.coalesce(found, F.when(text.rlike("the .{0,30} is"), "pattern:the..is"), F.lit("")).alias("reason"))


def budget(n: Column, slack: float = 0.15) -> tuple[Column, Column]:
    """Least and most length within the slack, one at least, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(n * (1 - slack))).cast("int"), F.greatest(F.lit(1), F.bround(n * (1 + slack))).cast("int")
