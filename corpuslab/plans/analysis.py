"""Queries: clusters of texts, probes of all layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, sentiment
from ..functions.lexicons import BOOSTERS, DAMPENERS, NEGATIONS, STRIP, VALENCE
from ..operators import alignment, guards, ml, phrases, probes, tagger, topics
from ..operators import vectors as V
from ..operators.select import hashed_fold
from .evaluation import _H, group_vectors, hidden
from .tables import DOCS, POSTS, docs, folder, posts, stored, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def weighed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Packed TF-IDF rows (doc_id, at, w) of all documents, and their terms."""
    rows, terms = ml.tf_idf_rows(docs(spark, sf_dir), "doc_id", F.col("t"), 5000, 5, 0.8)
    return stored(rows), terms


def text_space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, topics.Space]:
    """Weights, sparse rows, and their space of 50 directions."""
    packed, terms = weighed(spark, sf_dir)
    rows = packed.withColumnRenamed("doc_id", "id")
    return ml.unpacked(packed, "doc_id", terms), rows, topics.truncated_svd(rows, terms, 50)


@query(None)
def text_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 of TF-IDF rows: singular values and the share of variance of each."""
    _, _, space = text_space(spark, sf_dir)
    found = [(k, float(v), float(e)) for k, (v, e) in enumerate(zip(space.values, space.explained, strict=True), 1)]
    return spark.createDataFrame(found, "component int, value double, explained double")


@query(None)
def text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the labelled texts in that space, with their profiles."""
    w, rows, space = text_space(spark, sf_dir)
    points = stored(topics.reduced(rows, space))
    found = ml.clustered(points, "x", 8).select(F.col("id").alias("doc_id"), "cluster")
    p = posts(spark, sf_dir).join(found, "doc_id")
    return topics.profiles(p, "cluster", "doc_id", w, {"toxic": F.col("toxic")}, F.col("n"), F.col("targets"))


@query(None)
def text_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled silhouette of 5, 8 and 10 clusters of texts."""
    _, rows, space = text_space(spark, sf_dir)
    points = stored(topics.reduced(rows, space))
    found = [(k, topics.sampled_silhouette(ml.clustered(points, "x", k), "x", "cluster", "id")) for k in (5, 8, 10)]
    return spark.createDataFrame(found, "k int, silhouette double")


@query(f"""WITH {POSTS}, tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM d), dfs AS (SELECT token, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1),
top AS (SELECT token, df, n FROM dfs, nn WHERE df >= 5 AND df <= 0.8 * n ORDER BY total DESC, token LIMIT 5000), w0 AS (SELECT doc_id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN top USING (token)),
w AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0), pl AS (SELECT lang, count(*) AS n, round(100 * avg(toxic), 4) AS pct_toxic, round(avg(n), 4) AS mean_len FROM p GROUP BY 1),
it AS (SELECT lang, name, count(*) AS c FROM (SELECT lang, unnest(targets) AS name FROM p) GROUP BY 1, 2), i3 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, name) AS i FROM it),
il AS (SELECT i3.lang, string_agg(name || '(' || CAST(CAST(round(100.0 * c / n) AS INTEGER) AS VARCHAR) || '%)', ', ' ORDER BY i) AS items FROM i3 JOIN pl USING (lang) WHERE i <= 3 GROUP BY 1),
tm AS (SELECT p.lang, token, sum(weight) AS s FROM p JOIN w USING (doc_id) GROUP BY 1, 2), t6 AS (SELECT tm.lang, token, row_number() OVER (PARTITION BY tm.lang ORDER BY round(s / pl.n, 9) DESC, token) AS i FROM tm JOIN pl USING (lang)),
tl AS (SELECT lang, string_agg(token, ', ' ORDER BY i) AS terms FROM t6 WHERE i <= 6 GROUP BY 1)
SELECT lang AS cluster, n, round(100.0 * n / (SELECT sum(n) FROM pl), 4) AS pct, pct_toxic, mean_len, coalesce(items, '') AS items, coalesce(terms, '') AS terms FROM pl LEFT JOIN il USING (lang) LEFT JOIN tl USING (lang)""")
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of given groups of the labelled texts, their languages."""
    packed, terms = weighed(spark, sf_dir)
    return topics.profiles(posts(spark, sf_dir), "lang", "doc_id", ml.unpacked(packed, "doc_id", terms), {"toxic": F.col("toxic")}, F.col("n"), F.col("targets"))


@query(None)
def layer_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic probes of all layers, and of five folds each, with macro F1 on rows seen and unseen."""
    rows = hidden(spark, sf_dir).select("layer", "h", "y", hashed_fold(F.col("vec_id"), 5).alias("fold"))
    rows = stored(rows)
    return probes.probe_curve(rows, probes.fit_probes(rows, 5))


_ROUNDS = 15


@query(f"""WITH RECURSIVE {_H}, s AS (SELECT h.layer, y, list_dot_product(h, v) AS s FROM h JOIN v USING (layer) WHERE vector = 'v_AC'),
z AS (SELECT layer, avg(s) AS m, stddev_pop(s) AS sd FROM s GROUP BY 1), x AS (SELECT s.layer, y, (s - m) / sd AS x FROM s JOIN z USING (layer)),
f AS (SELECT layer, 0 AS k, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM z UNION ALL
SELECT layer, k + 1, w - (h2 * g1 - h1 * g2) / (h0 * h2 - h1 * h1), b - (h0 * g2 - h1 * g1) / (h0 * h2 - h1 * h1) FROM
(SELECT f.layer, k, w, b, w + sum((p - y) * x) AS g1, sum(p - y) AS g2, 1 + sum(p * (1 - p) * x * x) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p)) AS h2
 FROM (SELECT f.layer, k, w, b, x, y, 1 / (1 + exp(-(w * x + b))) AS p FROM f JOIN x ON x.layer = f.layer) f GROUP BY f.layer, k, w, b) WHERE k < {_ROUNDS})
SELECT CAST(f.layer AS INTEGER) AS layer, round(w / sd, 5) AS weight, round(b - w / sd * m, 5) AS bias FROM f JOIN z ON z.layer = f.layer WHERE k = {_ROUNDS}""")
def projection_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V7: a logistic probe of each layer on the projection onto its difference vector."""
    _, v = group_vectors(spark, sf_dir)
    one = v.where("vector = 'v_AC'").select("layer", "v")
    rows = stored(hidden(spark, sf_dir).join(F.broadcast(one), "layer").select("layer", F.array(V.dot(F.col("h"), F.col("v"))).alias("h"), "y"))
    found = probes.fit_probes(rows)
    return found.select("layer", F.round(F.get("w", F.lit(0)), 5).alias("weight"), F.round("bias", 5).alias("bias"))


# --- lexicons of phrases ------------------------------------------------------------------------------------------

_ITEMS = r"""b0 AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, '.,!?;:"''()[]{}')), lambda x: x <> '') AS bt FROM benchmark),
lex AS (SELECT DISTINCT 'c' || (item_id % 3) AS category, array_to_string(bt[i:i + k - 1], ' ') AS term, k FROM (SELECT item_id, bt, k, unnest(range(1, len(bt) - k + 2)) AS i FROM b0, (SELECT unnest([1, 2, 3]) AS k)))"""
_HITS = f"""WITH {DOCS}, {_ITEMS}, dg AS (SELECT doc_id, i, k, array_to_string(t[i:i + k - 1], ' ') AS term FROM (SELECT doc_id, t, k, unnest(range(1, n - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k))),
hit AS (SELECT doc_id, category, term, k AS words, i - 1 AS place FROM dg JOIN lex USING (term, k))"""


def phrase_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All one to three words in a row of the benchmark's items, in three categories: thousands of terms, from a headerless
    tab-separated file that they were written to."""
    from ..sources import readers, sinks

    items = table(spark, sf_dir, "benchmark").select("item_id", parse.tokens(F.col("text")).alias("t"))
    ends = items.select("item_id", "t", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).where(F.size("t") >= F.col("k"))
    grams = ends.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("k") + 1), lambda i: F.array_join(F.slice("t", i, F.col("k")), " "))).alias("term"))
    path = f"{folder(spark)}/phrases-{uuid.uuid4().hex}"
    sinks.csv(grams.select(F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), "term").distinct(), path, sep="\t", header=False)
    return readers.csv(spark, path, "category string, term string", sep="\t", header=False)


@query(f"{_HITS} SELECT doc_id, category, count(*) AS hits, count(DISTINCT term) AS n_terms, CAST(min(place) AS INTEGER) AS first_at, CAST(max(words) AS INTEGER) AS longest FROM hit GROUP BY 1, 2")
def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a lexicon of phrases in every document, overlaps included."""
    found = phrases.phrase_hits(docs(spark, sf_dir), "doc_id", "t", phrase_lexicon(spark, sf_dir))
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("hits"), F.countDistinct("term").alias("n_terms"), F.min("at").alias("first_at"), F.max("words").alias("longest"))


@query(f"""{_HITS}, m AS (SELECT DISTINCT doc_id, category, term FROM hit WHERE words > 1), a AS (SELECT doc_id, string_agg(category || '=' || term, ',' ORDER BY category, term) AS items FROM m GROUP BY 1)
SELECT doc_id, {', '.join(f"CAST(count(*) FILTER (WHERE category = 'c{k}') > 0 AS INTEGER) AS has_c{k}" for k in range(3))}, CAST(count(DISTINCT category) AS INTEGER) AS n_categories, md5(coalesce(any_value(items), '')) AS items_md5 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN a USING (doc_id) GROUP BY 1""")
def phrase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category flags from terms of several words, and the list of all matched items."""
    lexicon = phrase_lexicon(spark, sf_dir).where(F.col("term").contains(" "))
    d = docs(spark, sf_dir).select("doc_id", "t")
    profile = stored(phrases.phrase_profile(phrases.phrase_hits(d, "doc_id", "t", lexicon), "doc_id"))
    each = profile.select("doc_id", "category", F.transform("terms", lambda x: F.concat("category", F.lit("="), x)).alias("terms"))
    items = each.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("category", "terms")))["terms"]).alias("items"))
    flags = phrases.phrase_flags(d.select("doc_id"), profile, "doc_id", ["c0", "c1", "c2"]).join(items, "doc_id", "left")
    return flags.select("doc_id", "has_c0", "has_c1", "has_c2", "n_categories", F.md5(F.coalesce(F.array_join("items", ","), F.lit(""))).alias("items_md5"))


# --- sentiment and base forms -------------------------------------------------------------------------------------

#: The published core's words, and some words that the corpus has.
VALUES = {**VALENCE, "the": 0.4, "and": 1.1, "that": -0.6, "de": 0.9, "la": -1.3, "der": 1.7, "und": -0.8, "le": 0.5, "que": -0.2}
_VALUE = lambda x: "CASE " + " ".join(f"WHEN {x} = '{w}' THEN {v}" for w, v in VALUES.items()) + " ELSE 0.0 END"


def _step(k: int) -> str:
    """A valence after the word ``k`` before it."""
    at = f"t[i - {k}]"
    weight = f"(CASE WHEN {at} IN {tuple(BOOSTERS)} THEN {sentiment.BOOST} WHEN {at} IN {tuple(DAMPENERS)} THEN -{sentiment.BOOST} END)"
    grown = f"(v{k - 1} + coalesce(sign(v{k - 1}) * ({weight} + CASE WHEN mixed AND caps[i - {k}] THEN {sentiment.CAPITALS} ELSE 0 END) * {sentiment.DAMPED[k - 1]}, 0))"
    return f"CASE WHEN i <= {k} OR CAST({_VALUE(at)} AS DOUBLE) <> 0 THEN v{k - 1} WHEN {at} IN {tuple(NEGATIONS)} THEN {grown} * {sentiment.NEGATED} ELSE {grown} END AS v{k}"


@query(f"""WITH s0 AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\s+'), lambda y: trim(y, '{STRIP.replace("'", "''")}')), lambda y: y <> '') AS w FROM documents),
s1 AS (SELECT *, list_transform(w, lambda y: lower(y)) AS t, list_transform(w, lambda y: y = upper(y) AND y <> lower(y)) AS caps FROM s0),
s2 AS (SELECT *, len(list_filter(caps, lambda y: y)) AS n_caps, coalesce(list_position(t, 'but'), 0) AS but FROM s1), s3 AS (SELECT *, n_caps > 0 AND n_caps < len(w) AS mixed FROM s2),
r AS (SELECT * FROM (SELECT doc_id, t, caps, mixed, but, i, CAST({_VALUE("t[i]")} AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM s3)) WHERE v <> 0),
r0 AS (SELECT *, CASE WHEN mixed AND caps[i] THEN v + sign(v) * {sentiment.CAPITALS} ELSE v END AS v0 FROM r), r1 AS (SELECT *, {_step(1)} FROM r0), r2 AS (SELECT *, {_step(2)} FROM r1), r3 AS (SELECT *, {_step(3)} FROM r2),
f AS (SELECT doc_id, CASE WHEN but = 0 THEN v3 WHEN i < but THEN v3 * {sentiment.BEFORE_BUT} ELSE v3 * {sentiment.BEHIND_BUT} END AS v FROM r3),
a AS (SELECT doc_id, sum(v) AS total, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS pos, coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS neg, count(*) AS n FROM f GROUP BY 1),
m AS (SELECT s3.doc_id, len(w) AS words, least(length(x) - length(replace(x, '!', '')), {sentiment.MOST_EXCLAIMED}) * {sentiment.EXCLAIMED} + CASE WHEN q < 2 THEN 0 WHEN q <= 3 THEN q * {sentiment.ASKED} ELSE {sentiment.MANY_ASKED} END AS more,
coalesce(total, 0) AS total, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, len(w) - coalesce(n, 0) AS neutral FROM (SELECT *, length(x) - length(replace(x, '?', '')) AS q FROM s3) s3 LEFT JOIN a USING (doc_id)),
g AS (SELECT doc_id, words, total + sign(total) * more AS whole, pos + CASE WHEN pos > neg THEN more ELSE 0 END AS pos, neg + CASE WHEN neg > pos THEN more ELSE 0 END AS neg, neutral FROM m)
SELECT doc_id, round(coalesce(neg / nullif(pos + neg + neutral, 0), 0), 6) AS neg, round(coalesce(neutral / nullif(pos + neg + neutral, 0), 0), 6) AS neu, round(coalesce(pos / nullif(pos + neg + neutral, 0), 0), 6) AS pos, round(CASE WHEN words = 0 THEN 0 ELSE whole / sqrt(whole * whole + 15) END, 6) AS compound FROM g""")
def sentiment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of negative, neutral and positive words and the compound score, with valences from a file."""
    from ..sources import readers

    path = f"{folder(spark)}/valences-{uuid.uuid4().hex}"
    spark.createDataFrame([(f"{w}\t{v}",) for w, v in VALUES.items()], "value string").write.text(path)
    found = table(spark, sf_dir, "documents").select("doc_id", sentiment.shares(F.col("text"), readers.valences(spark, path)).alias("s"))
    return found.select("doc_id", *[(F.round(F.col(f"s.{c}") * 1e6) / 1e6).alias(c) for c in ("neg", "neu", "pos", "compound")])


_RULES = ", ".join(f"('{pos}', '{old}', '{new}')" for pos, pairs in guards.DETACHED.items() for old, new in pairs)


@query(f"""WITH {DOCS}, tok AS (SELECT doc_id, lang, unnest(t) AS word FROM d), w AS (SELECT DISTINCT word FROM tok), voc AS (SELECT word FROM tok GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), rule(pos, old, new) AS (VALUES {_RULES}),
c AS (SELECT word, pos, word AS form FROM w, (SELECT unnest(['n', 'v', 'a']) AS pos) UNION SELECT word, pos, substr(word, 1, length(word) - length(old)) || new FROM w JOIN rule ON ends_with(word, old) AND length(word) > length(old)),
b AS (SELECT c.word, pos, form, row_number() OVER (PARTITION BY c.word, pos ORDER BY length(form), form) AS i FROM c WHERE form IN (SELECT word FROM voc))
SELECT w.word, {", ".join(f"coalesce(max(CASE WHEN pos = '{p}' THEN form END), w.word) AS {p}" for p in "nva")} FROM w LEFT JOIN b ON b.word = w.word AND i = 1 GROUP BY 1""")
def lemma_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's base form as noun, verb and adjective, by rules and a vocabulary: words of three documents or more."""
    words = stored(docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct("t")).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    return guards.base_forms(words, words.where("df >= 3"))


# --- similarity by alignment --------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, nd AS (SELECT count(*) AS n FROM d), idf AS (SELECT word, ln((n + 1) / (df + 1)) AS idf FROM (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS word FROM d) GROUP BY 1), nd),
pr AS (SELECT a.doc_id, a.t AS a, b.t AS b FROM d a JOIN d b ON b.doc_id = a.doc_id + 1), w AS (SELECT doc_id, 0 AS side, unnest(a) AS word FROM pr UNION ALL SELECT doc_id, 1, unnest(b) FROM pr),
c AS (SELECT doc_id, side, word, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT doc_id, side, n * idf AS mass, count(*) OVER (PARTITION BY doc_id, word) = 2 AS met FROM c JOIN idf USING (word)),
s AS (SELECT doc_id, side, CASE WHEN sum(mass) > 0 THEN coalesce(sum(mass) FILTER (WHERE met), 0) / sum(mass) ELSE avg(CAST(met AS INTEGER)) END AS share FROM m GROUP BY 1, 2),
x AS (SELECT pr.doc_id, len(a) = 0 AND len(b) = 0 AS none, len(a) > 0 AND len(b) > 0 AS ready, r.share AS recall, p.share AS precision FROM pr LEFT JOIN s r ON r.doc_id = pr.doc_id AND r.side = 0 LEFT JOIN s p ON p.doc_id = pr.doc_id AND p.side = 1),
y AS (SELECT doc_id, CASE WHEN none THEN 1.0 WHEN ready THEN precision ELSE 0.0 END AS precision, CASE WHEN none THEN 1.0 WHEN ready THEN recall ELSE 0.0 END AS recall FROM x)
SELECT doc_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f FROM y""")
def gate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 where no word has a vector: equal words only, weighed by idf."""
    d = docs(spark, sf_dir)
    found = alignment.next_alignment(d, "doc_id", "t", alignment.idf(d, "t"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(None)
def gate_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbours by aligned words, with vectors from the corpus's co-occurrences; too like, too unlike."""
    d = docs(spark, sf_dir)
    found = alignment.next_alignment(d, "doc_id", "t", alignment.idf(d, "t"), *alignment.word_rows(d, "t"))
    return found.select("doc_id", F.round("f", 6).alias("similarity"), (F.col("f") > 0.92).alias("too_similar"), (F.col("f") < 0.7).alias("too_different"))


@query(None)
def name_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger counted from four fifths of the documents, and its precision and recall on the others.

    No table has names marked; a capitalised word behind one in small letters, and the next if it is too, stand in for labels.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("tokens"), hashed_fold(F.col("doc_id"), 5).alias("fold"))
    low, cap = (lambda w: F.coalesce(w.rlike(r"^\p{Ll}+$"), F.lit(False))), (lambda w: F.coalesce(w.rlike(r"^\p{Lu}\p{Ll}+$"), F.lit(False)))
    at = lambda i: F.get("tokens", i)
    first = lambda i: low(at(i - 1)) & cap(at(i))
    truth = F.transform("tokens", lambda w, i: F.when((i > 0) & first(i), "B").when((i > 1) & first(i - 1) & cap(w), "I").otherwise("O"))
    rows = stored(d.withColumn("truth", truth))
    model = tagger.fit(rows.where("fold > 0"), "tokens", "truth")
    return tagger.scores(tagger.tagged(rows.where("fold = 0"), "tokens", model), "truth", "tags", "lang")
