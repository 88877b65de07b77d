"""Quality gates over (original, output) pairs: HARD and SOFT flags and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import has_phrase, words
from ..functions.lexicons import EXPLICIT_CUES, FRAME_WORDS, GENERIC_PHRASES, PLACEHOLDERS, PRESERVED, REFUSALS, UNLESS_FOLLOWED, VIOLENCE_PATTERNS
from ..functions.parse import letter_set


def refusal(output: Column) -> Column:
    return has_phrase(F.lower(F.coalesce(output, F.lit(""))), REFUSALS)


def missing_words(original: Column, output: Column, preserved: Sequence[str] = PRESERVED) -> Column:
    """Words to preserve that the original has and the output lost, sorted."""
    return F.array_sort(F.array_except(F.array_intersect(letter_set(original), words(*preserved)), letter_set(output)))


def violence(output: Column, patterns: Sequence[str] = VIOLENCE_PATTERNS) -> Column:
    """Patterns that still match, unless the output is a refusal."""
    text = F.lower(F.coalesce(output, F.lit("")))
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?s){p}"), F.lit(p)) for p in patterns]))
    return F.when(refusal(output), F.array().cast("array<string>")).otherwise(found)


def leaked_words(output: Column, risky: Sequence[str], allowed: Sequence[str] = ()) -> Column:
    """Words of the output that a lexicon marks, but those allowed, sorted."""
    return F.array_sort(F.array_except(F.array_intersect(letter_set(output), words(*risky)), words(*allowed) if allowed else F.array().cast("array<string>")))


def emotion_drop(before: Column, after: Column, most: float = 0.75) -> Column:
    """Soft flag by counts of emotion words: none before never flags; one flags if it is lost; more if over ``most`` go."""
    drop = F.round(1 - F.try_divide(after.cast("double"), before), 4)
    return F.when(before == 0, False).when(before == 1, after == 0).otherwise(drop > most)


def repeats(output: Column, phrases: Sequence[str] = GENERIC_PHRASES, least: int = 3) -> Column:
    """Phrases that come ``least`` times or more, without overlaps."""
    text = F.lower(F.coalesce(output, F.lit("")))
    n = lambda p: (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    return F.array_compact(F.array(*[F.when(n(p) >= least, F.lit(p)) for p in phrases]))


def explicit_cues(output: Column, cues: Sequence[str] = EXPLICIT_CUES) -> Column:
    """Cue words, and words that only count if a given next word does not follow."""
    text = F.lower(F.coalesce(output, F.lit("")))
    plain = [F.when(text.rlike(f"(?<![a-z0-9_]){c}(?![a-z0-9_])"), F.lit(c)) for c in cues]
    bound = [F.when(text.rlike(f"(?<![a-z0-9_]){w}(?![a-z0-9_])(?!\\s+{n}(?![a-z0-9_]))"), F.lit(w)) for w, n in UNLESS_FOLLOWED]
    return F.array_compact(F.array(*plain, *bound))


def placeholders(output: Column) -> Column:
    text = F.lower(F.coalesce(output, F.lit("")))
    return F.array_compact(F.array(*[F.when(text.contains(p), F.lit(p)) for p in PLACEHOLDERS]))


def no_frame_signal(output: Column, negative: Sequence[str], least: int = 1) -> Column:
    """Soft: fewer than ``least`` negative words and no frame word."""
    text = F.lower(F.coalesce(output, F.lit("")))
    return (F.size(F.array_intersect(letter_set(output), words(*negative))) < least) & ~has_phrase(text, FRAME_WORDS)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of letter words, in place of an embedding's score: no model is at hand."""
    x, y = letter_set(a), letter_set(b)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0)), 4)


def verdict(flags: Sequence[tuple[str, Column]]) -> Column:
    """Names of the raised flags in their order, joined by `` | ``; PASS without any."""
    raised = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n if isinstance(n, Column) else F.lit(n)) for n, c in flags]))
    return F.when(F.size(raised) == 0, "PASS").otherwise(F.array_join(raised, " | "))


def length_band(original: Column, output: Column, low: float, high: float) -> Column:
    ratio = F.try_divide(F.size(F.split(F.trim(output), r"\s+")).cast("double"), F.size(F.split(F.trim(original), r"\s+")))
    return ratio.between(low, high)
