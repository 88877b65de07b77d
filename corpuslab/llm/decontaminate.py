"""Benchmark decontamination by a generalised suffix automaton of the test items' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, table, written

#: Lower-cases A-Z and turns every other ASCII byte but digits and letters into a blank; what is left are words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: So many words of items make one automaton (some 200 MB at most); more items are dealt into several automata.
BLOCK_WORDS = 300_000


class SuffixAutomaton:
    """All substrings of several sequences of word numbers, with links to the longest proper suffix classes."""

    def __init__(self, items: list[list[int]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, self.window = [0], [-1], window
        ends: list[tuple[int, int]] = []
        for k, words in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                ends.append((last, k))
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state: short items that it holds whole, as (length, item)
        for k, words in enumerate(items):
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                self.whole.setdefault(s, []).append((len(words), k))
        # An item occurs with each suffix of what ends in it: items go up the links, to where a window still fits.
        self.items: list[set[int]] = [set() for _ in self.next]
        for s, k in ends:
            while s > 0 and self.length[s] >= window and k not in self.items[s]:
                self.items[s].add(k)
                s = self.link[s]
        # Whether a state or one above it holds a short item.
        self.short = [False] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = s in self.whole or self.short[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        here = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return here

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def stream(self, words: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Follow ``words``, which begin at position ``at``, and note covered [start, end) and the items met."""
        s = n = 0
        window, moves, length, link = self.window, self.next, self.length, self.link
        for i, w in enumerate(words, at + 1):
            while s and w not in moves[s]:
                s = link[s]
                n = length[s]
            if w not in moves[s]:
                continue
            s, n = moves[s][w], n + 1
            if n >= window:
                t = s
                while length[link[t]] >= window:
                    t = link[t]
                found |= self.items[t]
                spans.append((i - window, i))
            if self.short[s]:
                t = s
                while t > 0 and self.short[t]:
                    for size, k in self.whole.get(t, ()):
                        if size <= n:
                            found.add(k)
                            spans.append((i - size, i))
                    t = link[t]


class Matcher:
    """One automaton, the numbers of its words, and which words may follow each other in it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.ids = [i for i, _ in items]
        cut = [t.translate(FOLD).split() for _, t in items]
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        coded = [[self.number[w] for w in ws] for ws in cut]
        self.automaton = SuffixAutomaton(coded, window)
        self.least = min([window, *(len(ws) for ws in coded if ws)])
        size = len(self.number) + 1
        self.pairs = np.unique(np.array([a * size + b for ws in coded for a, b in zip(ws, ws[1:], strict=False)], np.int64))
        self.size = size

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, covered spans (merged) and items of a text."""
        words = text.translate(FOLD).split()
        get = self.number.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        # The automaton's moves at depth two, as one sorted array: where a pair of words is not in it, the matching
        # length falls to one at most, so the stream can begin anew there and runs too short for any item are skipped.
        if self.least > 1:
            pair = codes[:-1] * self.size + codes[1:]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            good = (codes[:-1] >= 0) & (codes[1:] >= 0) & (self.pairs[at] == pair) if len(self.pairs) else np.zeros(max(len(words) - 1, 0), bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            runs = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + 1 - a >= self.least]
        else:
            good = codes >= 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        for a, b in runs:
            self.automaton.stream(codes[a:b].tolist(), a, spans, found)
        return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items that have words, in blocks of bounded size, read one by one: the driver holds the block at hand."""
    block: list[tuple[str, bytes]] = []
    room = block_words
    for r in items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("text")).orderBy("id", "text").toLocalIterator():
        n = len((r["text"] or "").encode().translate(FOLD).split())
        if n == 0:
            continue
        if block and room < n:
            yield block
            block, room = [], block_words
        block.append((r["id"], r["text"].encode()))
        room -= n
    yield block


_BUILT: list[tuple[list, int, Matcher]] = []


def _matcher(block: list[tuple[str, bytes]], window: int) -> Matcher:
    """One automaton at a time in each Python worker."""
    if not _BUILT or _BUILT[0][:2] != (block, window):
        _BUILT[:] = [(block, window, Matcher(block, window))]
    return _BUILT[0][2]


def contaminated_spans(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``n_words`` (long), ``hits`` (merged spans of word positions) and ``items`` (sorted item ids).

    A window is ``window`` consecutive words of an item, or a whole shorter item. Every word inside an occurrence of a
    window is hit. Items without words are ignored; an item without an id marks its words but has no id to list; rows
    of items with one id count once. Null text has no words. Rows of ``df`` are independent: copies, ties and empty
    tables need nothing special, and texts are read whole. Input columns named n_words, hits or items are replaced.

    Benchmarks larger than ``block_words`` words are dealt into several automata; the documents are then written once,
    streamed by each in turn, and the spans of a row put together; driver and workers hold one or two blocks at a time.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    kept = df.select(*[f"`{c}`" for c in own])
    blocks = _blocks(items, block_words)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _scan(kept, spark.sparkContext.broadcast(block), window, text, own)
    rows = written(kept.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("__all"), F.col(f"`{text}`").alias("__text")), "decontaminate")
    thin = None
    while block is not None:
        held = spark.sparkContext.broadcast(block)
        part = _scan(rows.select("__row", "__text"), held, window, "__text", ["__row", "__text"]).drop("__text")
        # The first block's part has every row with its number of words, the others' only rows that are hit.
        part = written(part if thin is None else part.where(F.size("hits") > 0), "decontaminate-hits")
        held.destroy()
        thin = part if thin is None else thin.unionByName(part)
        block, more = more, next(blocks, None)
    spans = F.flatten(F.collect_list("hits"))
    one = thin.groupBy("__row").agg(F.first("n_words").alias("n_words"), F.array_sort(spans).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    first = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    union = F.aggregate(
        "hits",
        F.array(first),
        lambda acc, x: F.when(
            x.start <= F.element_at(acc, -1)["end"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(x["end"], F.element_at(acc, -1)["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    one = one.withColumn("hits", F.slice(union, 2, F.size("hits") + 1))
    return rows.select("__row", "__all").join(one, "__row").select("__all.*", "n_words", "hits", "items")


def _scan(df: DataFrame, block, window: int, text: str, own: list[str]) -> DataFrame:  # noqa: ANN001
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "n_words long, hits array<struct<start:int,end:int>>, items array<string>"])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block.value, window)
        for batch in slices(batches, text):
            found = [matcher.match(t) for t in as_bytes(batch.column(text))]
            extra = [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], spans),
                pa.array([sorted({matcher.ids[k] for k in x[2]} - {None}) for x in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*own, "n_words", "hits", "items"])

    return df.mapInArrow(work, schema)


def remove_spans(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", most_coverage: float = 0.5) -> DataFrame:
    """``df`` without the contaminated spans of its texts, and without rows hit in over ``most_coverage`` of their words.

    A span goes from its first word's first byte to its last word's last byte. Other rows are as they were; null stays.
    """
    columns, schema = df.columns, df.schema

    def cut(t: str | None, hits: list[dict]) -> str | None:
        if not hits:
            return t
        raw = t.encode()
        folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
        out, at = [], 0
        for h in hits:
            out.append(raw[at : edge[2 * h["start"]]])
            at = edge[2 * h["end"] - 1]
        return b"".join([*out, raw[at:]]).decode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [cut(t, h) for t, h in zip(batch.column(text).to_pylist(), batch.column("__hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns], names=columns)

    found = contaminated_spans(df.select(F.struct("*").alias("__all"), F.col(f"`{text}`").alias("__text")), items, window, "__text")
    covered = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"])
    return found.where(covered <= most_coverage * F.col("n_words")).select("__all.*", F.col("hits").alias("__hits")).mapInArrow(work, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's 10-word windows in every whole document."""
    found = contaminated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"]).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, p, p + least(10, len(w)) - 1) AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item, p, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
