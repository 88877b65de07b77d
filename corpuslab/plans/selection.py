"""Queries: cascades, funnels, samples, splits, duplicates, leakage, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..functions.lexicons import CATEGORIES
from ..operators import select as S
from .tables import DOCS, POSTS, docs, posts, sql_any, table
from .text import _FRAMES

QUERIES, ORACLE = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the lists that the cascade looks at."""
    p = posts(spark, sf_dir)
    p = p.withColumn("strong", classify.hits(F.col("t"), CATEGORIES["moral"])).withColumn("other_cues", classify.hits(F.col("t"), (*CATEGORIES["ability"], *CATEGORIES["status"])))
    return p.withColumn("frames", classify.frames(F.col("t"), F.col("low"))).withColumn("primary", F.element_at("frames", 1))


def checks() -> list[tuple[str, Column]]:
    """The cascade's checks in their order: (reason, failed)."""
    c = F.col
    return [
        ("denylist", c("doc_id").isin(3, 7, 11)), ("label", ~F.coalesce(c("label"), F.lit("")).isin("hate", "offensive", "normal")), ("split", c("agreement") == "split"), ("agreement_majority", c("agreement") != "unanimous"),
        ("token_len", ~c("n").between(10, 600)), ("no_valid_target", F.size("targets") < 1), ("too_many_targets", F.size("targets") > 3), ("no_strong_cue", F.size("strong") < 1), ("strong_cue_cap", F.size("strong") > 3),
        ("no_other_cue", F.size("other_cues") < 1), ("no_target_token", ~F.exists("t", lambda x: x.isin("the", "les", "der", "los"))), ("multi_target_single_word", (F.size("targets") >= 2) & (c("n") < 20)),
        ("primary_not_in_frames", ~F.array_contains("frames", c("primary"))), ("frame_none", c("primary") == "NONE_DETECTED"),
    ]


_ANCHORS = f"""{POSTS}, a AS (SELECT *, list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in CATEGORIES['moral'])})) AS strong, list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in (*CATEGORIES['ability'], *CATEGORIES['status']))})) AS other_cues, {_FRAMES} AS fr FROM p)"""
_CHECKS = (
    ("denylist", "doc_id IN (3, 7, 11)"), ("label", "label IS NULL"), ("split", "agreement = 'split'"), ("agreement_majority", "agreement <> 'unanimous'"), ("token_len", "n NOT BETWEEN 10 AND 600"), ("no_valid_target", "len(targets) < 1"),
    ("too_many_targets", "len(targets) > 3"), ("no_strong_cue", "len(strong) < 1"), ("strong_cue_cap", "len(strong) > 3"), ("no_other_cue", "len(other_cues) < 1"), ("no_target_token", f"NOT {sql_any('t', ('the', 'les', 'der', 'los'))}"),
    ("multi_target_single_word", "len(targets) >= 2 AND n < 20"), ("primary_not_in_frames", "FALSE"), ("frame_none", "len(fr) = 0"),
)
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _CHECKS) + " ELSE 'ok' END"


@query(f"WITH {_ANCHORS} SELECT {_REASON} AS reason, count(*) AS n FROM a GROUP BY 1")
def hq_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first check that they fail."""
    return anchors(spark, sf_dir).select(S.first_reason(checks()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_ANCHORS}, r AS (SELECT a.*, {_REASON} AS reason FROM a) SELECT doc_id, label, array_to_string(fr, '+') AS frames, len(strong) = len(cues) AS strong_only FROM r WHERE reason IN ('ok', 'no_other_cue')")
def hq_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that pass, and those that lack only another cue."""
    a = anchors(spark, sf_dir).withColumn("reason", S.first_reason(checks())).where(F.col("reason").isin("ok", "no_other_cue"))
    named = F.filter("frames", lambda x: x != "NONE_DETECTED")
    return a.select("doc_id", "label", F.array_join(named, "+").alias("frames"), (F.size("strong") == F.size("cues")).alias("strong_only"))


def _funnel_sql() -> str:
    good, parts = "TRUE", ["SELECT 0 AS step, 'input' AS name, count(*) AS survivors, CAST(0 AS BIGINT) AS dropped FROM a"]
    for k, (n, c) in enumerate(_CHECKS, 1):
        before, good = good, f"{good} AND NOT ({c})"
        parts.append(f"SELECT {k}, '{n}', count(*) FILTER (WHERE {good}), count(*) FILTER (WHERE {before}) - count(*) FILTER (WHERE {good}) FROM a")
    return " UNION ALL ".join(parts)


@query(f"WITH {_ANCHORS} {_funnel_sql()}")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return S.funnel(anchors(spark, sf_dir), checks())


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS i FROM documents) WHERE i <= 20")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M4, M7."""
    return S.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 20)


@query(f"WITH {POSTS} SELECT doc_id, lang, toxic FROM (SELECT *, row_number() OVER (PARTITION BY lang, toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS i FROM p) WHERE i <= 6")
def stratified_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    return S.sample_per_group(posts(spark, sf_dir).select("doc_id", "lang", "toxic"), ["lang", "toxic"], "doc_id", 6)


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 30")
def shuffle_and_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M8, W12."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(S.order_key(F.col("doc_id"), 42), "doc_id").limit(30)


@query(f"""WITH {POSTS}, e AS (SELECT doc_id, agreement, unnest(targets) AS g FROM p), c(g, cap, place) AS (VALUES ('ES', 4, 0), ('EN', 8, 1), ('FR', 5, 2), ('DE', 5, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE agreement WHEN 'unanimous' THEN 0 ELSE 1 END, md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS i FROM e JOIN c USING (g) WHERE agreement <> 'split'),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS j FROM r WHERE i <= cap) SELECT doc_id, g AS target, agreement FROM k WHERE j = 1""")
def priority_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    e = posts(spark, sf_dir).where("agreement <> 'split'").select("doc_id", "agreement", F.explode("targets").alias("target"))
    return S.priority_cap(e, "doc_id", "target", F.when(F.col("agreement") == "unanimous", 0).otherwise(1), [("ES", 4), ("EN", 8), ("FR", 5), ("DE", 5)])


@query(f"WITH {POSTS}, r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS c FROM p) SELECT doc_id, toxic, CASE WHEN i <= round(c * 0.2) THEN 'test' ELSE 'train' END AS part FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    return S.split(posts(spark, sf_dir).select("doc_id", "toxic"), ["toxic"], "doc_id", 0.2)


@query("WITH k AS (SELECT md5(text) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1) SELECT doc_id, copies FROM k")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each text, and how many there are."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id")
    first = S.keep_first(d, ["key"], ["doc_id"])
    return first.join(d.groupBy("key").agg(F.count("*").alias("copies")), "key").select("doc_id", "copies")


_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON {_KEY.format('b.text')} = {_KEY.format('d.text')} UNION ALL SELECT DISTINCT b.item_id FROM benchmark b SEMI JOIN benchmark c ON {_KEY.format('b.text')} = {_KEY.format('c.text')} WHERE b.item_id % 10 = 0")
def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that documents equal, and a control of items that equal themselves."""
    items = table(spark, sf_dir, "benchmark").withColumn("key", parse.leakage_key(F.col("text")))
    control = S.leaked(items, items.where("item_id % 10 = 0"), "key").select("item_id")
    return S.leaked_texts(table(spark, sf_dir, "documents"), items, "text", "key", parse.leakage_key).select("item_id").unionByName(control)


@query(f"WITH {DOCS}, b AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda x: trim(x, '.,!?;:\"''()[]{{}}')), lambda x: x <> '') AS t FROM benchmark) SELECT item_id, doc_id FROM b, d WHERE len(b.t) >= 8 AND strpos(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(b.t, ' ') || ' ') > 0")
def leakage_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item of eight words or more."""
    items = table(spark, sf_dir, "benchmark").select("item_id", parse.tokens(F.col("text")).alias("item"))
    return S.contained(docs(spark, sf_dir).select("doc_id", "t"), "doc_id", "t", items, "item_id", "item", 8)


@query("WITH ab AS (SELECT text AS a, lang AS b FROM documents WHERE doc_id % 2 = 0), ac AS (SELECT text AS a, source AS c FROM documents WHERE doc_id % 2 = 1) SELECT md5(a) AS a_md5, b, c FROM ab JOIN ac USING (a) WHERE trim(a) <> '' AND trim(b) <> '' AND trim(c) <> ''")
def triple_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal text, many to many."""
    d = table(spark, sf_dir, "documents")
    ab = d.where("doc_id % 2 = 0").select(F.col("text").alias("a"), F.col("lang").alias("b"))
    ac = d.where("doc_id % 2 = 1").select(F.col("text").alias("a"), F.col("source").alias("c"))
    return S.triples(ab, ac, "a", "b", "c").select(F.md5("a").alias("a_md5"), "b", "c")


@query("SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, P33."""
    one = S.keep_first(table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])
    return table(spark, sf_dir, "documents").select("doc_id").join(one, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IN ('en', 'fr') AND n_chars BETWEEN 100 AND 5000")
def denylist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, S6, W1, W11."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(100, 5000))
    return S.without(d, table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT CASE WHEN source = 'src1' THEN 'a' ELSE 'b' END AS part, lang, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1, 2 UNION ALL SELECT 'c', lang, count(*) FROM documents WHERE lang <> 'en' GROUP BY 2")
def union_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, S11, U1, P12."""
    d = table(spark, sf_dir, "documents")
    en = d.where("lang = 'en'").withColumn("part", F.when(F.col("source") == "src1", "a").otherwise("b"))
    rest = d.where("lang <> 'en'").withColumn("part", F.lit("c"))
    return en.unionByName(rest).groupBy("part", "lang").agg(F.count("*").alias("n"))
