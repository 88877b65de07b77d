"""Parsing and normalising as Column to Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import GROUPS, MASKS, STRIP


def quoted_items(c: Column, drop_blank: bool = False) -> Column:
    """Items in single or double quotes: ``['u' "don't"]``. Null gives no items."""
    both = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("""'([^']*)'|"([^"]*)\""""), F.lit(0))
    items = F.transform(both, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.filter(items, lambda x: F.trim(x) != "") if drop_blank else items


def single_quoted_count(c: Column) -> Column:
    """How many single-quoted runs a token list holds; an apostrophe within double quotes shifts them (kept as it is)."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("'([^']+)'"), F.lit(1)))


def vote_list(c: Column) -> Column:
    """Votes from ``'label': array([0, 2, 2])`` or ``'label': [1, 1, 1]``; none if neither is there."""
    text = F.coalesce(c, F.lit(""))
    first = F.regexp_extract(text, r"'label':\s*array\(\[([^\]]*)\]", 1)
    found = F.when(first != "", first).otherwise(F.regexp_extract(text, r"'label':\s*\[([^\]]*)\]", 1))
    return F.transform(F.regexp_extract_all(found, F.lit("-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def list_literal(c: Column, wrap_scalar: bool = False) -> Column:
    """A list literal's items; blank, null or no list gives none, or one with ``wrap_scalar``."""
    text = F.trim(F.coalesce(c, F.lit("")))
    empty = F.array().cast("array<string>")
    scalar = F.when(text != "", F.array(text)).otherwise(empty) if wrap_scalar else empty
    return F.when(text.startswith("[") & text.endswith("]"), quoted_items(text)).otherwise(scalar)


def known_targets(c: Column) -> Column:
    """Distinct targets without the sentinel ``None``."""
    return F.array_remove(F.array_distinct(quoted_items(c)), "None")


def platform(post_id: Column, mark: str = "gab") -> Column:
    return F.when(post_id.contains(mark), mark).otherwise("other")


def tidy(c: Column) -> Column:
    """Doubled quotes single, runs of white space one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit('""'), F.lit('"')), r"\s+", " "))


def leakage_key(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks: what must not be in both training and evaluation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""), "  +", " "))


def tokens(c: Column) -> Column:
    """Lower-case words between white space, without punctuation at their ends. Null gives none."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(STRIP))), lambda x: x != "")


def letter_set(c: Column) -> Column:
    """Distinct runs of a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1)))


def compound_split(words: Column, parts: Mapping[str, Sequence[str]]) -> Column:
    """Each word, followed by its parts if it has any."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in parts.items() for x in kv])
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>")))))


def without_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]", ""), r"\s+", " "))


def without_fence(c: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^```[a-z]*\\n?", ""), "\\n?```$", ""))


def bare(c: Column, chars: str) -> Column:
    """Without ``chars`` (as within the brackets of a pattern) at its ends, by one match: btrim notes the place of every character."""
    return F.regexp_extract(c, f"(?s)^[{chars}]*((?:.*[^{chars}])?)", 1)


def final_sentence(c: Column) -> Column:
    """What follows ``Final Sentence:`` (or ``Final Transformed Sentence:``), else the next line that is not blank, else
    the whole text; without quotes and stars around it. Null gives an empty string."""
    text = F.trim(F.coalesce(c, F.lit("")))
    head = r"(?i)(?:^|\n)[\s#*-]*final\s+(?:transformed\s+)?sentence\**[ \t]*:"
    line = F.regexp_extract(text, head + r"[* \t\n]*((?:[^\n]*[^* \t\n])?)", 1)
    return bare(F.when(text.rlike(head), line).otherwise(text), "\"' ")


def field(c: Column, name: str) -> Column:
    """The value of a line ``- Name: value``, case ignored; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?im)^-\\s*{name}:[ \\t]*(.+)$", 1))


def first_containing(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The name of the first rule of which the text contains a term."""
    found = F.lit(default).cast("string")
    for name, terms in reversed(rules):
        hit = F.lit(False)
        for t in terms:
            hit = hit | c.contains(t)
        found = F.when(hit, name).otherwise(found)
    return found


def canonical_group(c: Column) -> Column:
    return first_containing(F.lower(F.coalesce(c, F.lit(""))), GROUPS, "OTHER")


def masked(c: Column, masks: Sequence[tuple[str, str]] = MASKS) -> Column:
    """Patterns replaced one after the other, case ignored."""
    for pattern, tag in masks:
        c = F.regexp_replace(c, f"(?i){pattern}", tag.replace("$", r"\$"))
    return c


def has_other_tag(c: Column, allowed: str = "[TARGET]") -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(r"\[[A-Z_0-9]+\]"), F.lit(0)), lambda x: x != allowed)


def enforce_choice(c: Column, name: str, allowed: Sequence[str], default: str) -> Column:
    """The first ``name: value`` of a text with ``default`` where the value is not allowed."""
    value = F.rtrim(F.lower(F.regexp_extract(c, f"{name}:\\s*([^\\n]+)", 1)))
    value = F.regexp_replace(value, r"\.+$", "")
    return F.when(~value.isin("", *allowed), F.regexp_replace(c, f"(?s)^(.*?{name}:\\s*)[^\\n]+", f"$1{default}")).otherwise(c)


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` filled in; missing and null values are empty."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{[a-z_0-9]+\}", "")


def label_code(c: Column) -> Column:
    """hate and its kinds 1, not hate 0, numbers as they are, else null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("hate", "implicit_hate", "explicit_hate", "1"), 1).when(text.isin("non-hate", "not_hate", "normal", "0"), 0)
