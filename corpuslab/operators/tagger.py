"""A tagger of names: a hidden Markov model counted from labelled rows, and Viterbi decoding."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import cut, lists
from ..storage import stored

#: Tags: outside, the first word of a name, a further one.
TAGS = ("O", "B", "I")
#: Words that the model knows by themselves (the most frequent, LEAST times or more); all others by their shape.
MOST, LEAST = 50_000, 5


def shape(word: Column, before: Column) -> Column:
    """What a word looks like, and where it stands: first or behind the end of a sentence ("^"), behind another sign that is
    no letter (","), or behind a word in small letters ("_") or another."""
    kind = (
        F.when(word.rlike(r"^\p{Lu}\p{Ll}+$"), "Xx").when(word.rlike(r"^\p{Lu}[\p{Ll}\p{Lu}]*\P{L}+$"), "Xx.").when(word.rlike(r"^\p{Lu}+$"), "XX").when(word.rlike(r"^\p{Ll}+$"), "xx")
        .when(word.rlike(r"^\p{Ll}+\P{L}+$"), "xx.").when(word.rlike(r"\p{N}"), "9").otherwise("?")
    )
    return F.concat(kind, F.when(before.isNull() | before.rlike(r"[.!?:]$"), "^").when(before.rlike(r"\P{L}$"), ",").when(before.rlike(r"^\p{Ll}"), "_").otherwise(""))


def observed(tokens: Column) -> Column:
    """Array of (word, shape) for each token."""
    return F.transform(tokens, lambda w, i: F.struct(w.alias("word"), shape(w, F.when(i > 0, F.get(tokens, i - 1))).alias("shape")))


#: An end of line that "$" allows behind itself in Java.
_END = r"[\x{85}\x{2028}\x{2029}]?$"
_KINDS = (("Xx", r"^\p{Lu}\p{Ll}+" + _END), ("Xx.", r"^\p{Lu}[\p{Ll}\p{Lu}]*\P{L}+$"), ("XX", r"^\p{Lu}+" + _END), ("xx", r"^\p{Ll}+" + _END), ("xx.", r"^\p{Ll}+\P{L}+$"), ("9", r"\p{N}"))
_BEFORE = (("^", r"[.!?:]" + _END), (",", r"\P{L}$"), ("_", r"^\p{Ll}"))
KINDS, BEFORE = [*(k for k, _ in _KINDS), "?"], [*(k for k, _ in _BEFORE), ""]
#: All shapes by number.
SHAPES = [k + b for k in KINDS for b in BEFORE]


def _first(words: pa.Array, patterns: tuple[tuple[str, str], ...]) -> np.ndarray:
    """For each word the number of the first pattern that it has, or of what follows them; null has none."""
    out = np.full(len(words), len(patterns))
    for k in range(len(patterns))[::-1]:
        out[pc.match_substring_regex(words, patterns[k][1]).fill_null(False).to_numpy(zero_copy_only=False)] = k
    return out


def looks(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a list column's tokens: rows, words by number, the words (null for null tokens), and numbers of the shapes that ``observed`` has: distinct words are
    looked at once."""
    items = pc.list_flatten(column)
    coded = items.dictionary_encode("encode")
    word, words = coded.indices.to_numpy(), coded.dictionary
    row = pc.list_parent_indices(column).to_numpy()
    kind, end = _first(words, _KINDS), _first(words, _BEFORE)
    if words.null_count:  # before a word null counts as none
        end[~words.is_valid().to_numpy(zero_copy_only=False)] = 0
    behind = np.zeros(len(word), np.int64)
    inside = row[1:] == row[:-1]
    behind[1:][inside] = end[word[:-1][inside]]
    return row, word, words, kind[word] * len(BEFORE) + behind


@dataclass
class Model:
    """Log probabilities: of tags behind tags ("" begins a row), of words, and of shapes of words that it does not know."""

    after: dict[tuple[str, str], float]
    words: dict[tuple[str, str], float]
    shapes: dict[tuple[str, str], float]
    known: set[str]
    rare: dict[str, float]


def fit(df: DataFrame, tokens: str, tags: str, most: int = MOST, least: int = LEAST) -> Model:
    """Counts over all labelled rows (arrays of tokens and of TAGS, equally long), with one added to each.

    What comes to the driver is bounded: tags, shapes, and the ``most`` frequent words (ties by name) that rows have
    ``least`` times or more. Other words count for their shapes. Rows with nulls or unlike lengths are left out.
    """
    rows = df.where((F.size(tokens) == F.size(tags)) & (F.size(tokens) > 0)).select(F.col(tokens).alias("t"), F.col(tags).alias("g"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tags behind tags (a, tag), and words by shape and tag."""
        for batch in cut(batches, "t", 500_000):
            row, word, words, look = looks(batch.column("t"))
            coded = pc.list_flatten(batch.column("g")).dictionary_encode("encode")
            tag, names = coded.indices.to_numpy(), coded.dictionary
            m = len(names)
            behind = np.full(len(tag), m)
            inside = row[1:] == row[:-1]
            behind[1:][inside] = tag[:-1][inside]
            keys, n = np.unique(behind * m + tag, return_counts=True)
            a = pa.concat_arrays([names, pa.array([""], names.type)]).take(pa.array(keys // m))
            yield pa.RecordBatch.from_arrays([a, pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int32()), names.take(pa.array(keys % m)), pa.array(n)], names=["a", "word", "look", "tag", "n"])
            keys, n = np.unique((word.astype(np.int64) * len(SHAPES) + look) * m + tag, return_counts=True)
            found = [pa.nulls(len(keys), pa.string()), words.take(pa.array(keys // m // len(SHAPES))), pa.array((keys // m % len(SHAPES)).astype(np.int32)), names.take(pa.array(keys % m)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(found, names=["a", "word", "look", "tag", "n"])

    each = stored(rows.mapInArrow(count, "a string, word string, look int, tag string, n long").groupBy("a", "word", "look", "tag").agg(F.sum("n").alias("n")))
    follow = {(r["a"], r["tag"]): r["n"] for r in each.where("look IS NULL").select("a", "tag", "n").collect()}
    each = each.where("look IS NOT NULL")
    top = each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).select("word")
    seen = each.join(F.broadcast(top), "word").groupBy("word", "tag").agg(F.sum("n").alias("n")).collect()
    shapes = {(SHAPES[r["look"]], r["tag"]): r["n"] for r in each.join(F.broadcast(top), "word", "left_anti").groupBy("look", "tag").agg(F.sum("n").alias("n")).collect()}
    total, rare = defaultdict(int), defaultdict(int)
    for r in seen:
        total[r["tag"]] += r["n"]
    for (_, g), n in shapes.items():
        total[g] += n
        rare[g] += n
    known, kinds = {r["word"] for r in seen}, {s for s, _ in shapes}
    begun = {a: sum(n for (x, _), n in follow.items() if x == a) for a in ("", *TAGS)}
    after = {(a, b): math.log((follow.get((a, b), 0) + 1) / (begun[a] + len(TAGS))) if not (b == "I" and a in ("", "O")) else -math.inf for a in begun for b in TAGS}
    counted = {(r["word"], r["tag"]): r["n"] for r in seen}
    words = {(w, g): math.log((counted.get((w, g), 0) + 0.1) / (total[g] + 0.1 * (len(known) + 1))) for w in known for g in TAGS}
    at = {(s, g): math.log((shapes.get((s, g), 0) + 1) / (rare[g] + len(kinds) + 1)) for s in (*kinds, "") for g in TAGS}
    return Model(after, words, at, known, {g: math.log((rare[g] + 1) / (total[g] + 2)) for g in TAGS})


def viterbi(model: Model, row: list[tuple[str, str]]) -> list[str]:
    """The likeliest tags of a row of (word, shape): the best way to each tag, word by word, then back."""
    score, back = {"": 0.0}, []
    for word, look in row:
        now, came = {}, {}
        for g in TAGS:
            here = model.words[word, g] if word in model.known else model.rare[g] + model.shapes.get((look, g), model.shapes["", g])
            now[g], came[g] = max(((score[a] + model.after[a, g] + here, a) for a in score), key=lambda x: x[0])
        back.append(came)
        score = now
    out, g = [], max(score, key=score.get) if row else ""
    for came in reversed(back):
        out.append(g)
        g = came[g]
    return out[::-1]


def _ways(model: Model, row: np.ndarray, here: np.ndarray, rows: int) -> np.ndarray:
    """Numbers of the likeliest tags of all tokens, as ``viterbi`` finds them: rows step by step together.

    ``here`` has a column for each tag, ``row`` ascends.
    """
    n = np.bincount(row, minlength=rows)
    start = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    step = np.array([[model.after[a, g] for g in TAGS] for a in TAGS])
    came = np.zeros((len(row), len(TAGS)), np.int8)
    out = np.zeros(len(row), np.int8)
    some = int(np.count_nonzero(n))
    score = np.array([model.after["", g] for g in TAGS]) + 0.0 + here[start[:some]]
    last = np.zeros(some, np.int8)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # rows of more tokens than each number
    for i in range(1, longest + 1):
        k = active[i]
        last[k : active[i - 1]] = score[k : active[i - 1]].argmax(axis=1)
        if not k:
            break
        ways = score[:k, :, None] + step + here[start[:k] + i][:, None, :]
        came[start[:k] + i] = ways.argmax(axis=1)
        score = ways.max(axis=1)
    tag = last
    for i in range(longest - 1, -1, -1):
        k = active[i]
        out[start[:k] + i] = tag[:k]
        tag[:k] = came[start[:k] + i, tag[:k]]
    return out


def tagged(df: DataFrame, tokens: str, model: Model, name: str = "tags") -> DataFrame:
    """``df`` with its rows' tags; null tokens have none (null). Rows are independent, the model goes to every task, which
    tags some 100,000 tokens at a time."""
    kept = [c for c in df.columns if c != name]
    rows = df.select(*kept, F.col(tokens).alias("__o"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__o"), f"`{name}` array<string>"])
    by_shape = np.array([[model.rare[g] + model.shapes.get((s, g), model.shapes["", g]) for g in TAGS] for s in SHAPES])
    by_word = {w: [model.words[w, g] for g in TAGS] for w in model.known}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = pa.array(TAGS, pa.string())
        for batch in cut(batches, "__o"):
            column = batch.column("__o")
            row, word, words, look = looks(column)
            told = [by_word.get(w) for w in words.to_pylist()]
            known = np.array([t is not None for t in told], bool)
            of_words = np.array([t or (0.0,) * len(TAGS) for t in told]).reshape(-1, len(TAGS))
            here = np.where(known[word][:, None], of_words[word], by_shape[look])
            found = lists(row, batch.num_rows, tags.take(pa.array(_ways(model, row, here, batch.num_rows))))[0]
            found = pa.ListArray.from_arrays(found.offsets, found.values, mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, name])

    return rows.mapInArrow(work, schema)


def names(tokens: Column, tags: Column) -> Column:
    """The names that tags mark, as an array of texts in their order: a B with the I's behind it."""
    begins = F.filter(F.transform(tags, lambda g, i: F.when(g == "B", i)), lambda i: i.isNotNull())
    ends = lambda i: F.coalesce(F.array_min(F.filter(F.transform(tags, lambda g, j: F.when((j > i) & (g != "I"), j)), lambda j: j.isNotNull())), F.size(tags))
    return F.transform(begins, lambda i: F.array_join(F.slice(tokens, i + 1, ends(i) - i), " "))


def scores(df: DataFrame, truth: str, found: str, *groups: str) -> DataFrame:
    """(groups, n, precision, recall) of whole names, by their first word's place and their length; null without any."""
    spans = lambda c: F.filter(F.transform(c, lambda g, i: F.when(g == "B", F.concat_ws(":", i.cast("string"), F.array_join(F.transform(F.slice(F.col(c), i + 1, F.size(c) - i), lambda x: x), "")))), lambda x: x.isNotNull())
    cut = lambda c: F.transform(spans(c), lambda x: F.regexp_extract(x, "^[0-9]+:BI*", 0))
    n = df.select(*groups, F.size(cut(truth)).alias("__t"), F.size(cut(found)).alias("__f"), F.size(F.array_intersect(cut(truth), cut(found))).alias("both"))
    s = n.groupBy(*groups).agg(F.sum("__t").alias("n"), F.sum("__f").alias("f"), F.sum("both").alias("both"))
    return s.select(*groups, "n", F.round(F.try_divide(F.col("both"), F.col("f")), 6).alias("precision"), F.round(F.try_divide(F.col("both"), F.col("n")), 6).alias("recall"))
