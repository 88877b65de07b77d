"""Audit of sources: how far each source's use of words lies from the others' of its language, and by which words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, give_back, slices, table, written

#: Documents of a language that must have a term, added to each count, and the unit of shares.
LEAST, ADDED, UNIT = 10, 2, 1_000_000_000
#: Terms ranked for each source.
TOP = 10
#: Bytes of kept terms in one automaton, counts and occurrences that a task holds before it hands them on.
BLOCK, HELD, FOUND = 16 << 20, 300_000, 2_000_000
#: Letters stay, A-Z in lower case; other ASCII ends a term; bytes of all other characters stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BUILT: dict[int, tuple] = {}


def terms(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def document_frequencies(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, term, df): in how many documents of a language each term occurs. Tasks add up first, ``held`` counts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            langs, found, n = [], [], []
            for lang, c in by_lang.items():
                langs += [lang] * len(c)
                found += c.keys()
                n += c.values()
            by_lang.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "term", "df"])

        for batch in slices(batches, "text", 4 << 20):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                by_lang.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, by_lang.values())) > held:
                yield out()
        yield out()
        give_back()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def _automaton(sent) -> tuple[ahocorasick.Automaton, dict[str, np.ndarray]]:  # noqa: ANN001
    """The automaton of a block's terms, each between two blanks, and the numbers of each language's terms; once a worker."""
    if sent.id not in _BUILT:
        _BUILT.clear()
        kept, langs = sent.value
        found = ahocorasick.Automaton()
        for k, term in enumerate(kept):
            found.add_word(f" {term} ", k)
        found.make_automaton()
        _BUILT[sent.id] = found, {lang: np.array(ids, np.int64) for lang, ids in langs.items()}
    return _BUILT[sent.id]


class _Sent:
    """A broadcast with an id that workers know it by."""

    def __init__(self, spark: SparkSession, value: tuple) -> None:
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> tuple:
        return self.broadcast.value


def occurrences(docs: DataFrame, kept: DataFrame, block: int = BLOCK, most: int = FOUND) -> DataFrame:
    """(lang, source, term, n) of the kept (lang, term): n > 0 occurrences in the texts of a language and source.

    One automaton finds all terms of a block; overlapping blanks are matched for both their terms. Blocks take ``block``
    bytes of terms, so driver and tasks hold one of bounded size; texts are read once for each block.
    """
    spark = docs.sparkSession
    schema = "lang string, source string, term string, n long"
    words = kept.groupBy("term").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    size = words.agg(F.coalesce(F.sum(F.octet_length("term") + 16 * F.size("langs")), F.lit(0))).first()[0]
    blocks = -(-size // block)
    found = spark.createDataFrame([], schema)
    for number in range(blocks):
        here = words.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == number).toArrow()
        names, langs = here.column("term").to_pylist(), {}
        if not names:
            continue
        for k, own in enumerate(here.column("langs").to_pylist()):
            for lang in own:
                langs.setdefault(lang, []).append(k)
        sent = _Sent(spark, (names, langs))

        def recount(batches: Iterator[pa.RecordBatch], sent: _Sent = sent) -> Iterator[pa.RecordBatch]:
            automaton, ids_of = _automaton(sent)
            names = np.array(sent.value[0], object)
            held: dict[tuple[str, str], list[np.ndarray]] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for (lang, source), parts in held.items():
                    ids, n = np.unique(np.concatenate(parts), return_counts=True)
                    own = np.isin(ids, ids_of.get(lang, ids[:0]))
                    if own.any():
                        ids, n = ids[own], n[own]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array([source] * len(ids), pa.string()), pa.array(names[ids], pa.string()), pa.array(n, pa.int64())], names=["lang", "source", "term", "n"])
                held.clear()

            size = 0
            for batch in slices(batches, "text", 4 << 20):
                for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch.column("text")), strict=True):
                    padded = f" {b' '.join(terms(text)).decode()} "
                    ids = np.fromiter((k for _, k in automaton.iter(padded)), np.int32)
                    held.setdefault((lang, source), []).append(ids)
                    size += len(ids) + 100
                    if size > most:
                        yield from out()
                        size = 0
            yield from out()
            give_back()

        found = found.unionByName(written(docs.select("lang", "source", "text").mapInArrow(recount, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "recounted"))
        sent.broadcast.unpersist()
    return found


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)) of columns; in decimals, as the product outgrows 64 bits."""
    return F.expr(f"1 + (CAST({n} + {ADDED} AS DECIMAL(19, 0)) * {UNIT}BD) DIV CAST({total} + {ADDED} * {kept} AS DECIMAL(19, 0))")


def apart(p: str, q: str) -> Column:
    """floor((p - q) * (p - q) / (p + q)): at most 10 ** 9, whose square still has 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, held: int = HELD, most: int = FOUND) -> DataFrame:
    """lang, source, part, item, value, rank: for each source its distance to every other, and its most telling terms.

    Terms are runs of letters A-Z (lower-cased) and non-ASCII characters. A language keeps terms that at least ``least``
    of its documents have. Each (lang, source), and each language, gives a kept term the share p (``share``). Part
    ``pair`` has every other source of the language, valued by the sum of ``apart`` of both shares over all kept terms;
    part ``term`` the ``top`` kept terms that the source has more often than the language has, valued by ``apart``.
    Ranks are by value, descending, then item, bytewise.

    Two passes: document frequencies, then occurrences by an automaton of the kept terms. Only terms that a source has
    are held (postings); what all others add to a distance follows from their number, as they share one p. So sources
    meet in a term's postings, or as counts of equal shares, never as all terms of all pairs.

    Nulls in lang, source or text count as empty. Repeated rows count as often as they stand there. A group without kept
    terms has pairs, valued 0 if the language keeps none, and no terms. No rows give no rows. Other columns are ignored.
    """
    empty = F.lit("")
    docs = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))
    kept = written(document_frequencies(docs, held).where(F.col("df") >= least).select("lang", "term"), "kept-terms")
    posted = written(occurrences(docs, kept, block, most), "postings")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    own = posted.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("has"))
    # One row for each source: v kept terms of its language, own occurrences, all of the language's, has kept terms.
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "own", "has")])
    groups = groups.withColumn("all", F.sum("own").over(Window.partitionBy("lang")))
    groups = written(groups.withColumn("none", F.when(F.col("v") > 0, share("0L", "own", "v"))), "source-groups")
    shares = posted.join(groups, ["lang", "source"]).withColumn("total", F.sum("n").over(Window.partitionBy("lang", "term")))
    shares = shares.select("lang", "source", "term", "none", share("n", "own", "v").alias("p"), share("total", "all", "v").alias("q"))
    shares = written(shares, "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    told = told.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("has").alias("other_has"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    # Terms of one source against a source that has none of them, by how many have the same share.
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("alike"))
    alone = alike.join(pairs.select("lang", "source", "item", "other_none"), ["lang", "source"])
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("alike") * apart("p", "other_none")).alias("alone"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("none").alias("none2"))
    both = shares.join(right, ["lang", "term"]).where(F.col("source") < F.col("item"))
    both = both.groupBy("lang", "source", "item").agg(F.sum(apart("p", "p2") - apart("p", "none2") - apart("none", "p2") + apart("none", "none2")).alias("both"))
    turned = lambda df: df.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col(df.columns[-1]))
    near = both.unionByName(turned(both))
    found = pairs.join(alone, ["lang", "source", "item"], "left").join(turned(alone).withColumnRenamed("alone", "back"), ["lang", "source", "item"], "left").join(near, ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    value = zero("alone") + zero("back") + zero("both") + (F.col("v") - F.col("has") - F.col("other_has")) * zero(apart("none", "other_none"))
    apart_from = found.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    apart_from = apart_from.withColumn("rank", F.row_number().over(ranked))
    return apart_from.unionByName(told)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of a language, and the ten terms that tell each source most."""
    return audit(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "1 + (({}) + {a})::HUGEINT * {u} // ({} + {a} * {})"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, doc_id, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang, term) AS total, sum(n) OVER (PARTITION BY lang) AS every FROM x),
p AS (SELECT lang, source, term, n, {_P.format("n", "own", "v", a=ADDED, u=UNIT)} AS p, {_P.format("total", "every", "v", a=ADDED, u=UNIT)} AS q FROM y JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
