"""Quality rules in DataFrame functions only: repeats within a text, and divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# Twelve frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "des", "en", "que", "du", "est"],
    "de": ["der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "ein", "nicht"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "las", "por", "con", "se"],
}
WORDS = 12
#: Character classes, taken one after the other from what is left of the text; what remains then is "other".
CLASSES = (("lower", "[a-z]+"), ("space", "[\\x20\\t-\\r]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("wide", "[^\\x00-\\x7F]+"))
#: Jensen-Shannon distances (0 to 1, square root of the divergence to base 2) above which a text is rejected, and the
#: fewest characters and words from which a histogram says anything.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.33, 0.25
LEAST_CHARS, LEAST_WORDS = 200, 100


def _step(df: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """``keep`` and the new columns, behind a generator of one row, so that later expressions don't repeat their work."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))


def _counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Words (``__w``), the class counts (``__c``: array<long>) and the counts of the language's common words (``__f``)."""
    keep = list(df.columns)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blank = F.regexp_replace(t, "[\\t-\\r]", " ")
    df = _step(df, keep, __t=t, __w=F.array_remove(F.split(blank, " "), ""), __n0=F.length(t), __r=F.regexp_replace(t, CLASSES[0][1], ""))
    names, left = [], F.col("__r")
    rest = ["__t", "__w", "__n0"]
    for k, (_, pattern) in enumerate(CLASSES[1:], 1):
        names.append(f"__n{k}")
        df = _step(df, [*keep, *rest], **{f"__n{k}": F.length(left), "__r": F.regexp_replace(left, pattern, "")})
        rest.append(f"__n{k}")
    lengths = [F.col("__n0"), *map(F.col, names), F.length("__r")]
    classes = F.array(*[(a - b).cast("long") for a, b in zip(lengths, lengths[1:], strict=False)], lengths[-1].cast("long"))
    listed = F.coalesce(*[F.when(F.col(f"`{lang}`") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array().cast("array<string>"))
    every = sorted({x for v in COMMON.values() for w in v for x in (w, w.capitalize())})
    df = _step(df, [*keep, "__t", "__w"], __c=classes, __l=listed, __cw=F.transform(F.filter("__w", lambda w: w.isin(every)), F.lower))
    found = F.transform("__l", lambda c: F.size(F.filter("__cw", lambda w: w == c)).cast("long"))
    return _step(df, [*keep, "__t", "__w", "__c"], __f=found)


def _base(df: DataFrame, keep: list[str]) -> DataFrame:
    """The base columns from ``__t``, ``__w`` and ``__c``."""
    w = F.col("__w")
    n = F.size("__w")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\t-\\r]"))
    starts = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    df = _step(df, [*keep, "__c"], n_words=n.cast("long"), __lines=lines, __h=hashes)
    # Texts without a window that comes twice are most; only the others are sorted.
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.when(twice, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    df = _step(df, [*keep, "__c", "n_words"], n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), __s=pairs)
    s = F.col("__s")
    same = F.filter("__s", lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
    df = _step(df, [*keep, "__c", "n_words", "n_dup_lines"], __p=F.sort_array(F.transform(same, lambda x: x.p)))
    p = F.col("__p")
    covered = F.aggregate(F.transform("__p", lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b)
    c = F.col("__c")
    chars = F.aggregate("__c", F.lit(0).cast("long"), lambda a, b: a + b) - F.get(c, F.lit(1))
    df = _step(df, [*keep, "__c", "n_words", "n_dup_lines"], n_repeat_words=covered.cast("long"), word_chars=chars, n_symbols=F.get(c, F.lit(4)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts (arrays of equal size); null if either is empty."""

    def share(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        return F.transform(x, lambda v: F.try_divide(v.cast("double"), total))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.when(a.isNotNull(), F.lit(0.0)))

    parts = F.zip_with(share(p), share(q), lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language, over all rows: sums of the character classes and of the common words, and the number of other words."""
    counts = _counts(df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")), "text", "lang")
    counted = counts.select(F.col("lang").alias("__lang"), F.size("__w").cast("long").alias("n"), *[F.get("__c", F.lit(k)).alias(f"c{k}") for k in range(len(CLASSES) + 1)], *[F.coalesce(F.get("__f", F.lit(k)), F.lit(0)).alias(f"f{k}") for k in range(WORDS)])
    sums = [F.sum(c).alias(c) for c in counted.columns[1:]]
    words = [F.col(f"f{k}") for k in range(WORDS)]
    return written(counted.groupBy("__lang").agg(*sums).select("__lang", F.array(*[F.col(f"c{k}") for k in range(len(CLASSES) + 1)]).alias("__rc"), F.array(*words, F.col("n") - sum(words[1:], words[0])).alias("__rf")), "quality-references")


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept.

    A row is kept if it passes the base rules and neither its character classes nor its language's common words are
    farther from all rows of that language than the limits; texts under the length guards have no distances (null) and
    pass by them, as do the words of languages without a list. Null text is an empty text; null language is a language
    of its own. Repeated rows are judged alike. No rows give no rows. Input columns of these names are replaced.

    References go to every task only while languages are at most 10,000; with more they are joined by a shuffle.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    own = [c for c in df.columns if c not in made]
    reference = references(df, text, lang)
    few = reference.count() <= 10_000
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").alias("__lang1"))
    counted = _counts(rows, "__text", "__lang1").withColumn("__n", F.size("__w"))
    based = _base(counted.drop("__text"), ["__row", "__lang1", "__n", "__f"])
    joined = based.join(F.broadcast(reference) if few else reference, F.col("__lang1").eqNullSafe(F.col("__lang")), "left")
    known = F.aggregate("__f", F.lit(0).cast("long"), lambda a, b: a + b)
    mine = F.concat("__f", F.array(F.col("__n").cast("long") - known))
    classes = F.when(F.aggregate("__c", F.lit(0).cast("long"), lambda a, b: a + b) >= LEAST_CHARS, distance(F.col("__c"), F.col("__rc")))
    words = F.when((F.col("__n") >= LEAST_WORDS) & (F.size("__f") == WORDS), distance(mine, F.col("__rf")))
    out = joined.withColumn("class_distance", classes).withColumn("word_distance", words)
    good = ~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return out.withColumn("kept", good).select("__row.*", *made)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole document."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def _oracle() -> str:
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
    every = ", ".join(repr(x) for x in sorted({x for v in COMMON.values() for w in v for x in (w, w.capitalize())}))
    kept = [p.replace("[", "[^", 1) if not p.startswith("[^") else p.replace("[^", "[", 1) for _, p in CLASSES]
    counts = ", ".join("length(regexp_replace(t, '" + p.replace("\\t-\\r", "\\x09-\\x0D") + "', '', 'g'))" for p in kept)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, lang, w, len(w) AS n, list_concat(cs, [length(t) - list_sum(cs)]) AS cs, [list_count(list_filter(cw, lambda x: x = c)) FOR c IN l] AS f,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM (SELECT *, [{counts}] AS cs, coalesce(CASE lang {lists} END, []) AS l, list_transform(list_filter(w, lambda x: x IN ({every})), lambda x: lower(x)) AS cw FROM d)),
g AS (SELECT doc_id, p, list_slice(w, p, p + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM c WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
b AS (SELECT c.*, coalesce(n_repeat, 0) AS nr, len(lines) - len(list_distinct(lines)) AS nd, n < 10 OR 100 * coalesce(n_repeat, 0) > 20 * n AS bad FROM c LEFT JOIN r USING (doc_id)),
h AS (SELECT doc_id, lang, 'c' AS kind, unnest(range(1, {len(CLASSES) + 2})) AS k, unnest(cs) AS v, list_sum(cs) >= {LEAST_CHARS} AS enough FROM b
      UNION ALL SELECT doc_id, lang, 'f', unnest(range(1, {WORDS + 2})), unnest(list_concat(f, [n - list_sum(f)])), n >= {LEAST_WORDS} FROM b WHERE len(f) = {WORDS}),
q AS (SELECT lang, kind, k, sum(v) / sum(sum(v)) OVER (PARTITION BY lang, kind) AS q FROM h GROUP BY 1, 2, 3),
s AS (SELECT doc_id, kind, v / sum(v) OVER (PARTITION BY doc_id, kind) AS p, q FROM h JOIN q USING (kind, k) WHERE enough AND h.lang IS NOT DISTINCT FROM q.lang),
j AS (SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS x FROM s GROUP BY 1, 2)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(list_sum(cs) - cs[2] AS BIGINT) AS word_chars, CAST(cs[5] AS BIGINT) AS n_symbols, CAST(nd AS BIGINT) AS n_dup_lines,
       CAST(nr AS BIGINT) AS n_repeat_words, bad AS base_failed, NOT bad AND coalesce(jc.x, 0) <= {MOST_CLASS_DISTANCE} AND coalesce(jf.x, 0) <= {MOST_WORD_DISTANCE} AS kept,
       round(jc.x, 6) AS class_distance, round(jf.x, 6) AS word_distance
FROM b LEFT JOIN j jc ON jc.doc_id = b.doc_id AND jc.kind = 'c' LEFT JOIN j jf ON jf.doc_id = b.doc_id AND jf.kind = 'f'
"""


ORACLE = _oracle()
