"""Lexicons of any size, terms of several words included: every occurrence in tokenised texts, overlaps kept."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import cut
from ..storage import stored

#: Bytes of terms in one automaton.
BLOCK = 16 << 20
#: Stands around every token; a token that holds it is no term's.
EDGE = "\x00"

_BUILT: dict[int, tuple] = {}


def normalised(lexicon: DataFrame, term: str = "term", category: str = "category") -> DataFrame:
    """(term, category) once each: lower case, one blank between words; null or blank terms and null categories are left out."""
    words = F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))
    return lexicon.select(words.alias("term"), F.col(category).cast("string").alias("category")).where((F.col("term") != "") & F.col("category").isNotNull()).distinct()


def _automaton(key: int, terms: list[str]) -> tuple[ahocorasick.Automaton, list[int]]:
    """Of a block's terms; once a worker. A term's words stand between edges, so that only whole tokens match."""
    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            found.add_word(EDGE + t.replace(" ", EDGE) + EDGE, k)
        found.make_automaton()
        _BUILT[key] = found, [t.count(" ") + 1 for t in terms]
    return _BUILT[key]


def phrase_hits(df: DataFrame, row_id: str, tokens: str, lexicon: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row id, category, term, at, words): each occurrence of each term, by the number of its first token (from 0).

    ``tokens`` are lower-case words; terms are compared word by word. An automaton with failure links finds all terms in
    one pass over a row's tokens, however many terms there are, and those inside or across others too. The lexicon is
    cut into blocks of ``block`` bytes, each with an automaton of its own and a pass: the driver and tasks hold one block,
    whatever its size, and the hits of some 100,000 tokens at a time. Null tokens, and rows without hits, give no rows; repeated rows give theirs each.
    """
    spark = df.sparkSession
    known = stored(normalised(lexicon).groupBy("term").agg(F.sort_array(F.collect_set("category")).alias("categories")))
    size = known.agg(F.coalesce(F.sum(F.octet_length("term") + 16 * F.size("categories")), F.lit(0))).first()[0]
    kind = df.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, category string, term string, at int, words int"
    blocks, found = -(-size // block), spark.createDataFrame([], schema)
    rows = df.select(F.col(row_id).alias("id"), F.col(tokens).alias("tokens")).where(F.col("tokens").isNotNull())
    for number in range(blocks):
        part = known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == number).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part.column("term").to_pylist(), part.column("categories").to_pylist()))
        key = sent._jbroadcast.id()

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key: int = key) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            terms, categories = sent.value
            automaton, words = _automaton(key, terms)
            for batch in cut(batches, "tokens"):
                at_row, names, of, places, sizes = [], [], [], [], []
                for k, row in enumerate(batch.column("tokens").to_pylist()):
                    row = ["" if t is None else t for t in row]
                    hits = [*automaton.iter(EDGE + EDGE.join(row) + EDGE)]
                    if not hits:
                        continue
                    edges = np.cumsum([0, *(len(t) + 1 for t in row)])
                    last = np.searchsorted(edges, [e for e, _ in hits])
                    for z, (_, term) in zip(last.tolist(), hits, strict=True):
                        if edges[z - words[term]] + len(terms[term]) + 1 != edges[z]:
                            continue  # a token with an edge in it
                        for category in categories[term]:
                            at_row.append(k)
                            names.append(category)
                            of.append(terms[term])
                            places.append(z - words[term])
                            sizes.append(words[term])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at_row, pa.int64())), pa.array(names, pa.string()), pa.array(of, pa.string()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], names=[row_id, "category", "term", "at", "words"])

        found = found.unionByName(rows.mapInArrow(scan, schema))
    return found


def phrase_profile(hits: DataFrame, row_id: str) -> DataFrame:
    """(row id, category, hits, terms): occurrences of a category in a row, and its distinct terms in order."""
    return hits.groupBy(row_id, "category").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("term")).alias("terms"))


def phrase_flags(df: DataFrame, profile: DataFrame, row_id: str, categories: list[str]) -> DataFrame:
    """``df`` with has_... (0 or 1) for each category and n_categories; rows without hits have zeros."""
    flag = lambda c: F.max((F.col("category") == c).cast("int")).alias(f"has_{c}")
    wide = profile.groupBy(row_id).agg(*[flag(c) for c in categories])
    joined = df.join(wide, row_id, "left").na.fill(0, [f"has_{c}" for c in categories])
    total: Column = sum((F.col(f"has_{c}") for c in categories), F.lit(0))
    return joined.withColumn("n_categories", total)
