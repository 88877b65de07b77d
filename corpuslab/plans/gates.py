"""Queries: pairs of original and output, and their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import EMOTIONS, GENERIC_PHRASES, PRESERVED, REFUSALS, VALENCE, VIOLENCE_PATTERNS
from ..functions.parse import letter_set
from ..functions.sentiment import compound
from ..operators import gates as G
from ..operators import guards
from .tables import DOCS, docs, table

QUERIES, ORACLE = {}, {}
NEGATIVE_WORDS = tuple(dict.fromkeys(w for k in ("anger", "disgust") for w in EMOTIONS[k]))
RISKY = ("clown", "loser", "moron", "the")


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, original, output): a document and the one with the next id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("original").alias("output"))
    return d.join(after, "doc_id")


PAIRS = """q AS (SELECT a.doc_id, a.text AS original, b.text AS output FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
g AS (SELECT doc_id, original, output, lower(output) AS low, list_distinct(regexp_extract_all(lower(original), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(output), '[a-z]+')) AS b FROM q WHERE output IS NOT NULL)"""


def _within(column: str, terms) -> str:  # noqa: ANN001
    return f"list_filter({column}, lambda x: x IN ({', '.join(repr(t) for t in terms)}))"


_MISSING = f"list_sort(list_filter({_within('a', PRESERVED)}, lambda x: NOT list_contains(b, x)))"
_LEAKED = f"list_sort({_within('b', RISKY[:3])})"
_BEFORE, _AFTER = f"len({_within('a', NEGATIVE_WORDS)})", f"len({_within('b', NEGATIVE_WORDS)})"
_SOFT = f"CASE WHEN {_BEFORE} = 0 THEN FALSE WHEN {_BEFORE} = 1 THEN {_AFTER} = 0 ELSE round(1 - {_AFTER} / {_BEFORE}, 4) > 0.75 END"
_REPEAT = f"list_filter([{', '.join(f'''CASE WHEN (length(low) - length(replace(low, '{p}', ''))) / {len(p)} >= 3 THEN '{p}' END''' for p in GENERIC_PHRASES)}], lambda x: x IS NOT NULL)"
_VIOLENT = f"list_filter([{', '.join(f'''CASE WHEN regexp_matches(low, '(?s){p}') THEN '{p}' END''' for p in VIOLENCE_PATTERNS)}], lambda x: x IS NOT NULL)"


@query(f"WITH {PAIRS} SELECT doc_id, array_to_string({_MISSING}, ',') AS missing, array_to_string({_LEAKED}, ',') AS leaked, CAST({_BEFORE} AS INTEGER) AS emotions_before, CAST({_AFTER} AS INTEGER) AS emotions_after, {_SOFT} AS emotion_drop, array_to_string({_REPEAT}, ',') AS repeats, CAST(len({_VIOLENT}) AS INTEGER) AS n_violent FROM g")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, G4, G6, G7, S12."""
    p = pairs(spark, sf_dir)
    a, b = (F.size(F.array_intersect(letter_set(F.col(c)), F.array(*map(F.lit, NEGATIVE_WORDS)))) for c in ("original", "output"))
    return p.select(
        "doc_id", F.array_join(G.missing_words(F.col("original"), F.col("output")), ",").alias("missing"), F.array_join(G.leaked_words(F.col("output"), RISKY, ("the",)), ",").alias("leaked"), a.alias("emotions_before"), b.alias("emotions_after"),
        G.emotion_drop(a, b).alias("emotion_drop"), F.array_join(G.repeats(F.col("output")), ",").alias("repeats"), F.size(G.violence(F.col("output"))).alias("n_violent"),
    )


_FLAGS = f"list_filter([CASE WHEN len({_MISSING}) > 0 THEN 'HARD:verbatim_missing(' || array_to_string({_MISSING}, ',') || ')' END, CASE WHEN len({_LEAKED}) > 0 THEN 'HARD:identity_leaked' END, CASE WHEN {_SOFT} THEN 'SOFT:emotion_drop' END, CASE WHEN len({_REPEAT}) > 0 THEN 'SOFT:generic_repeat' END], lambda x: x IS NOT NULL)"
_VERDICT = f"CASE WHEN len({_FLAGS}) = 0 THEN 'PASS' ELSE array_to_string({_FLAGS}, ' | ') END"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, r = pairs(spark, sf_dir), F.col("original"), F.col("output")
    missing, negative = G.missing_words(o, r), F.array(*map(F.lit, NEGATIVE_WORDS))
    flags = [
        (F.concat(F.lit("HARD:verbatim_missing("), F.array_join(missing, ","), F.lit(")")), F.size(missing) > 0), ("HARD:identity_leaked", F.size(G.leaked_words(r, RISKY, ("the",))) > 0),
        ("SOFT:emotion_drop", G.emotion_drop(F.size(F.array_intersect(letter_set(o), negative)), F.size(F.array_intersect(letter_set(r), negative)))), ("SOFT:generic_repeat", F.size(G.repeats(r)) > 0),
    ]
    return p.select("doc_id", G.verdict(flags).alias("verdict"))


@query(f"WITH {PAIRS} SELECT doc_id, {_VERDICT} AS verdict FROM g")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return judged(spark, sf_dir)


@query(f"WITH {PAIRS}, v AS (SELECT {_VERDICT} AS verdict FROM g) SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE strpos(verdict, 'HARD') > 0) AS n_hard, count(*) FILTER (WHERE strpos(verdict, 'SOFT') > 0 AND strpos(verdict, 'HARD') = 0) AS n_soft_only FROM v")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31, A32."""
    v = F.col("verdict")
    return judged(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(v == "PASS").alias("n_pass"), F.count_if(v.contains("HARD")).alias("n_hard"), F.count_if(v.contains("SOFT") & ~v.contains("HARD")).alias("n_soft_only"))


@query(f"WITH {PAIRS}, x AS (SELECT doc_id, low, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, regexp_replace(low, 'clown\\s+fish', '', 'g') AS cut, len(string_split_regex(trim(output), '\\s+')) / len(string_split_regex(trim(original), '\\s+')) AS ratio FROM g) SELECT doc_id, coalesce(round(i / nullif(u, 0), 4), 0) AS similarity, ratio BETWEEN 0.5 AND 1.5 AS in_band, CAST(regexp_matches(cut, '(^|[^a-z0-9_])clown($|[^a-z0-9_])') AS INTEGER) AS lone_clown FROM x")
def gate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the third cell."""
    p, o, r = pairs(spark, sf_dir), F.col("original"), F.col("output")
    return p.select("doc_id", G.similarity(o, r).alias("similarity"), G.length_band(o, r, 0.5, 1.5).alias("in_band"), F.array_contains(G.explicit_cues(r), "clown").cast("int").alias("lone_clown"))


@query("SELECT conv_id, turn, role, CAST((" + " OR ".join(f"strpos(lower(coalesce(text, '')), '{r.replace(chr(39), chr(39) * 2)}') > 0" for r in REFUSALS) + ") AS INTEGER) AS refused, CAST((strpos(lower(coalesce(text, '')), 'certain people') > 0) AS INTEGER) AS placeholder FROM conversations")
def refusal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, G10, X22."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", G.refusal(F.col("text")).cast("int").alias("refused"), F.array_contains(G.placeholders(F.col("text")), "certain people").cast("int").alias("placeholder"))


@query(f"SELECT conv_id, {', '.join(f'max(CASE WHEN turn = {k} THEN md5(text) END) AS turn_{k}' for k in range(8))} FROM conversations GROUP BY conv_id")
def turns_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as columns, all that occur (0 to 7 in the given tables, which the SQL names)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    turns = sorted((r[0] for r in c.select("turn").distinct().collect()), key=lambda k: (k is None, k))  # a handful
    return c.groupBy("conv_id").agg(*[F.max(F.when(F.col("turn").eqNullSafe(F.lit(k)), F.col("h"))).alias(f"turn_{'null' if k is None else k}") for k in turns])


_FIRST_TURNS = range(4)


@query(f"""WITH c AS (SELECT conv_id, turn, md5(text) AS h FROM conversations), m AS (SELECT conv_id, coalesce(CAST(turn AS VARCHAR), 'null') AS t, max(h) AS h FROM c WHERE turn IS NULL OR turn NOT IN (0, 1, 2, 3) GROUP BY 1, 2)
SELECT conv_id, {", ".join(f"max(CASE WHEN turn = {k} THEN h END) AS turn_{k}" for k in _FIRST_TURNS)}, coalesce((SELECT string_agg(t || ':' || coalesce(h, ''), ',' ORDER BY t) FROM m WHERE m.conv_id IS NOT DISTINCT FROM c.conv_id), '') AS more FROM c GROUP BY conv_id""")
def turns_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, U7 for conversations of any length: the first four turns as columns; all others, as a conversation may have any number, as a map by turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    return guards.turn_columns(c, "conv_id", "turn", "h", list(_FIRST_TURNS)).select("conv_id", *[f"turn_{k}" for k in _FIRST_TURNS], F.array_join(F.transform(F.array_sort(F.map_entries("more")), lambda e: F.concat(e.key, F.lit(":"), e.value)), ",").alias("more"))


_VAL = "CASE " + " ".join(f"WHEN x = '{k}' THEN {v}" for k, v in VALENCE.items()) + " ELSE 0.0 END"
_ONE = _VAL.replace("x =", "t[i] =")


@query(f"""WITH {DOCS}, v AS (SELECT doc_id, t, i, CAST({_ONE} AS DOUBLE) AS v FROM (SELECT doc_id, t, unnest(range(1, n + 1)) AS i FROM d)),
w AS (SELECT doc_id, CASE WHEN i > 1 AND t[i - 1] IN ('very', 'really', 'so', 'in', 'of') THEN v + sign(v) * 0.293 ELSE v END AS v, len(list_filter(t[greatest(i - 3, 1):i - 1], lambda x: x IN ('not', 'no', 'never', 'without', 'nicht', 'ne', 'sin'))) > 0 AND i > 1 AS turned FROM v WHERE v <> 0),
s AS (SELECT doc_id, sum(CASE WHEN turned THEN v * -0.74 ELSE v END) AS x FROM w GROUP BY 1) SELECT d.doc_id, round(coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15), 6) AS compound FROM d LEFT JOIN s USING (doc_id)""")
def sentiment_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20, G5."""
    return docs(spark, sf_dir).select("doc_id", F.round(compound(F.col("t")), 6).alias("compound"))
