"""Queries: distributions, cross tables, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agreement, classify
from ..functions.lexicons import CATEGORIES, EMOTIONS, INSULTS, NEGATIVE, PRONOUNS, STOPWORDS
from ..operators import aggregates as A
from .tables import DOCS, POSTS, docs, posts, sql_any, table
from .text import _FRAMES

QUERIES, ORACLE = {}, {}
LABELS, AGREEMENTS = ("hate", "normal", "offensive"), ("unanimous", "majority", "split")
BINS = ((1, 10), (11, 20), (21, 50), (51, 100), (101, 500), (501, None))
FIRST, SECOND = ("the", "der", "les", "los"), INSULTS


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSTS} SELECT coalesce(label, 'none') AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM p GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, P7."""
    return A.value_counts(posts(spark, sf_dir).select(F.coalesce("label", F.lit("none")).alias("label")), "label")


@query(f"WITH {POSTS} SELECT source, agreement, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM p GROUP BY 1, 2")
def source_agreement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return A.value_counts(posts(spark, sf_dir), "source", "agreement")


_CELLS = ", ".join(f"count(*) FILTER (WHERE agreement = '{a}') AS n_{a}" for a in AGREEMENTS)


@query(f"WITH {POSTS} SELECT coalesce(label, 'none') AS label, {_CELLS} FROM p GROUP BY 1")
def crosstab_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return A.crosstab(posts(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit("none"))), "label", "agreement", AGREEMENTS)


@query(f"WITH {POSTS}, c AS (SELECT lang, {_CELLS} FROM p GROUP BY 1) SELECT lang, {', '.join(f'round(100.0 * n_{a} / (n_unanimous + n_majority + n_split), 4) AS pct_{a}' for a in AGREEMENTS)} FROM c")
def crosstab_row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, row by row to 100."""
    return A.row_shares(A.crosstab(posts(spark, sf_dir), "lang", "agreement", AGREEMENTS), "lang")


@query(f"WITH {DOCS} SELECT lang, count(n) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, CAST(min(n) AS DOUBLE) AS min, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, CAST(max(n) AS DOUBLE) AS max FROM d GROUP BY 1")
def length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return A.describe(docs(spark, sf_dir).select("lang", F.col("n").alias("len")), "len", "lang")


@query(f"WITH {DOCS}, s AS (SELECT lang, list(n ORDER BY n) AS s FROM d GROUP BY 1) SELECT lang, len(s) AS n, s[1 + len(s) // 4] AS q1, s[1 + 2 * len(s) // 4] AS q2, s[1 + 3 * len(s) // 4] AS q3 FROM s")
def length_rank_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return A.rank_quartiles(docs(spark, sf_dir).select("lang", F.col("n").alias("len")), "len", "lang")


_BIN = "CASE " + " ".join(f"WHEN n >= {a}" + (f" AND n <= {b} THEN '{a}-{b}'" if b else f" THEN '{a}+'") for a, b in BINS) + " END"


@query(f"WITH {DOCS}, b AS (SELECT lang, {_BIN} AS bin FROM d) SELECT lang, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1, 2")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8."""
    return A.histogram(docs(spark, sf_dir).select("lang", F.col("n").alias("len")), "len", BINS, "lang")


@query(f"""WITH {POSTS} SELECT g AS target, count(*) AS n, round(100 * avg(CAST(majority = 0 AS INTEGER)), 4) AS pct_hate, round(100 * avg(CAST(majority = 2 AS INTEGER)), 4) AS pct_off, round(100 * avg(CAST(agreement = 'unanimous' AS INTEGER)), 4) AS pct_unanimous,
round(100 * avg(has_cue), 4) AS pct_cue, round(100 * avg(CAST(len(targets) > 1 AS INTEGER)), 4) AS pct_multi, round(avg(n), 6) AS mean_len FROM (SELECT *, unnest(targets) AS g FROM p) GROUP BY 1 HAVING count(*) >= 5""")
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per group named, groups of some size."""
    d = posts(spark, sf_dir).withColumn("target", F.explode("targets"))
    flags = {"hate": F.col("majority") == 0, "off": F.col("majority") == 2, "unanimous": F.col("agreement") == "unanimous", "cue": F.col("has_cue") == 1, "multi": F.size("targets") > 1}
    mean = d.groupBy("target").agg(F.round(F.avg("n"), 6).alias("mean_len"))
    return A.rates(d, flags, "target", least=5).join(mean, "target")


@query(f"WITH {POSTS} SELECT count(*) AS n, round(100 * avg(CAST(list_sort(list_distinct(votes)) = [0, 1] AS INTEGER)), 4) AS pct_hate_normal, round(100 * avg(CAST(list_sort(list_distinct(votes)) = [1, 2] AS INTEGER)), 4) AS pct_normal_off, round(100 * avg(CAST(list_sort(list_distinct(votes)) = [0, 2] AS INTEGER)), 4) AS pct_hate_off FROM p")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels annotators confuse."""
    kinds = F.array_sort(F.array_distinct("votes"))
    return A.rates(posts(spark, sf_dir), {k: kinds == F.array(*map(F.lit, v)) for k, v in {"hate_normal": (0, 1), "normal_off": (1, 2), "hate_off": (0, 2)}.items()})


@query(f"WITH {POSTS}, m AS (SELECT majority, unnest(votes) AS v FROM p) SELECT majority, v AS minority_vote, count(*) AS n FROM m WHERE v <> majority AND majority >= 0 GROUP BY 1, 2")
def minority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    m = posts(spark, sf_dir).where("majority >= 0").select("majority", F.explode("votes").alias("minority_vote"))
    return m.where("minority_vote <> majority").groupBy("majority", "minority_vote").agg(F.count("*").alias("n"))


@query(f"WITH {POSTS}, s AS (SELECT agreement, len(list_distinct([array_to_string(list_sort(targets), ','), array_to_string(list_sort(targets[1:1]), ','), array_to_string(list_sort(targets[2:2]), ',')])) AS k FROM p) SELECT agreement, CASE k WHEN 1 THEN 'all_same' WHEN 3 THEN 'all_different' ELSE 'partial' END AS target_agreement, count(*) AS n FROM s GROUP BY 1, 2")
def set_valued_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement on sets, three annotators' sets being all, the first and the second group."""
    s = posts(spark, sf_dir).select("agreement", agreement.set_agreement(F.col("targets"), F.slice("targets", 1, 1), F.slice("targets", 2, 1)).alias("target_agreement"))
    return s.groupBy("agreement", "target_agreement").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS}, k AS (SELECT array_to_string(list_sort(list_distinct(cues)), '+') AS combo FROM d WHERE len(cues) > 0), c AS (SELECT combo, count(*) AS n FROM k GROUP BY 1) SELECT * FROM c ORDER BY n DESC, combo LIMIT 15")
def cue_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, T2."""
    k = docs(spark, sf_dir).where(F.size("cues") > 0).groupBy(F.array_join(F.array_sort(F.array_distinct("cues")), "+").alias("combo")).agg(F.count("*").alias("n"))
    return A.top_k(k, 15, "n", "combo")


_LEX = ", ".join(f"('{k}', '{w}')" for k, ws in CATEGORIES.items() for w in ws)


@query(f"WITH {DOCS}, x AS (SELECT unnest(t) AS token FROM d), l(category, token) AS (VALUES {_LEX}), c AS (SELECT category, token, count(*) AS n FROM x JOIN l USING (token) GROUP BY 1, 2) SELECT category, token, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS i FROM c) WHERE i <= 3")
def top_tokens_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are counted before they meet the lexicon."""
    lexicon = spark.createDataFrame([(k, w) for k, ws in CATEGORIES.items() for w in ws], "category string, token string")
    counts = docs(spark, sf_dir).select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return A.top_k(counts.join(F.broadcast(lexicon), "token").select("category", "token", "n"), 3, "n", "token", "category")


@query(f"WITH {DOCS}, x AS (SELECT unnest(t) AS token FROM d), c AS (SELECT token, count(*) AS n FROM x WHERE length(token) > 2 AND NOT starts_with(token, 'http') AND token NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) GROUP BY 1) SELECT * FROM c ORDER BY n DESC, token LIMIT 30")
def vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, W9."""
    x = docs(spark, sf_dir).select(F.explode("t").alias("token")).where((F.length("token") > 2) & ~F.col("token").startswith("http") & ~F.col("token").isin(*STOPWORDS))
    return A.top_k(x.groupBy("token").agg(F.count("*").alias("n")), 30, "n", "token")


_LONG = "list_filter(t, lambda x: length(x) > 2)"


@query(f"WITH {DOCS}, l AS (SELECT {_LONG} AS l FROM d), b AS (SELECT l[i] AS a, l[i + 1] AS b FROM (SELECT l, unnest(range(1, len(l))) AS i FROM l)), c AS (SELECT a || ' ' || b AS bigram, count(*) AS n FROM b WHERE NOT (a IN ({', '.join(repr(w) for w in STOPWORDS)}) AND b IN ({', '.join(repr(w) for w in STOPWORDS)})) GROUP BY 1) SELECT * FROM c ORDER BY n DESC, bigram LIMIT 30")
def bigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    b = docs(spark, sf_dir).select(F.explode(A.bigrams(F.col("t"), STOPWORDS)).alias("bigram"))
    return A.top_k(b.groupBy("bigram").agg(F.count("*").alias("n")), 30, "n", "bigram")


@query(f"WITH {DOCS}, x AS (SELECT lang, unnest(t) AS token FROM d) SELECT lang, count(*) AS total, count(DISTINCT token) AS distinct_tokens, round(count(DISTINCT token) / count(*), 6) AS ttr FROM x GROUP BY 1")
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per language and token first, so that no language's tokens meet in one task."""
    c = docs(spark, sf_dir).select("lang", F.explode("t").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("c"))
    s = c.groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("distinct_tokens"))
    return s.withColumn("ttr", F.round(F.try_divide(F.col("distinct_tokens").cast("double"), F.col("total")), 6))


@query(f"WITH {DOCS} SELECT lang, count(*) AS n, {', '.join(f'round(100 * avg(CAST({sql_any('t', v)} AS INTEGER)), 4) AS pct_{k}' for k, v in PRONOUNS.items())} FROM d GROUP BY 1")
def pronoun_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return A.rates(docs(spark, sf_dir), {k: classify.has_any(F.col("t"), v) for k, v in PRONOUNS.items()}, "lang")


@query(f"WITH {DOCS}, f AS (SELECT {_FRAMES} AS f FROM d), x AS (SELECT f, unnest(f) AS a FROM f), y AS (SELECT a, unnest(f) AS b FROM x) SELECT a, b, count(*) AS n FROM y WHERE a <> b GROUP BY 1, 2")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, J12, U4, U5."""
    d = docs(spark, sf_dir)
    found = F.filter(classify.frames(F.col("t"), F.col("low")), lambda x: x != "NONE_DETECTED")
    return A.co_occurrence(d, "doc_id", found)


@query(f"WITH {DOCS}, f AS (SELECT lang, CASE WHEN len({_FRAMES}) = 0 THEN ['NONE_DETECTED'] ELSE {_FRAMES} END AS f FROM d) SELECT lang, item, count(*) AS n FROM (SELECT lang, unnest(f) AS item FROM f) GROUP BY 1, 2")
def frames_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    d = docs(spark, sf_dir)
    return A.explode_counts(d, classify.frames(F.col("t"), F.col("low")), "lang")


@query(f"""WITH {DOCS}, q AS (SELECT doc_id, list_filter(range(1, n + 1), lambda i: t[i] IN ({', '.join(repr(w) for w in FIRST)})) AS a, list_filter(range(1, n + 1), lambda i: t[i] IN ({', '.join(repr(w) for w in SECOND)})) AS b FROM d),
m AS (SELECT doc_id, min(abs(i - j)) AS dist FROM (SELECT doc_id, i, unnest(b) AS j FROM (SELECT doc_id, b, unnest(a) AS i FROM q)) GROUP BY 1)
SELECT CASE WHEN dist <= 1 THEN '0-1' WHEN dist <= 3 THEN '2-3' WHEN dist <= 5 THEN '4-5' WHEN dist <= 10 THEN '6-10' ELSE '11+' END AS bin, count(*) AS n FROM m GROUP BY 1""")
def cue_target_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, J11, X18."""
    d = docs(spark, sf_dir).select(A.least_distance(F.col("t"), FIRST, SECOND).alias("dist")).where("dist IS NOT NULL")
    return A.histogram(d, "dist", ((0, 1), (2, 3), (4, 5), (6, 10), (11, None)))


_LIFT = {"has_function": ("the", "and"), "has_not": ("not", "nicht", "ne"), "has_que": ("que",)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS feature, (SELECT count(*) FROM {{0}} WHERE {sql_any('t', v)}) AS n1, (SELECT round(avg(CAST(majority = 1 AS INTEGER)), 6) FROM {{0}} WHERE {sql_any('t', v)}) AS rate1, (SELECT round(avg(CAST(majority = 1 AS INTEGER)), 6) FROM {{0}} WHERE NOT {sql_any('t', v)}) AS rate0, (SELECT round(avg(CASE WHEN {sql_any('t', v)} THEN CAST(majority = 1 AS INTEGER) END) - avg(CASE WHEN NOT {sql_any('t', v)} THEN CAST(majority = 1 AS INTEGER) END), 6) FROM {{0}}) AS lift" for k, v in _LIFT.items()).replace("{0}", f"(WITH {POSTS} SELECT * FROM p)"))
def feature_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, A24, X23."""
    return A.feature_lift(posts(spark, sf_dir), F.col("majority") == 1, {k: classify.has_any(F.col("t"), v) for k, v in _LIFT.items()})


_EMO = {k: f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in v)})))" for k, v in EMOTIONS.items()}


@query(f"WITH {DOCS} SELECT lang, {', '.join(f'round(avg({c}), 6) AS mean_{k}' for k, c in _EMO.items())}, round(avg({' + '.join(_EMO[k] for k in NEGATIVE)}), 6) AS mean_negative FROM d GROUP BY 1")
def emotion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per row in the row, no join of tokens."""
    d = docs(spark, sf_dir)
    n = {k: F.size(classify.hits(F.col("t"), v)) for k, v in EMOTIONS.items()}
    return d.groupBy("lang").agg(*[F.round(F.avg(c), 6).alias(f"mean_{k}") for k, c in n.items()], F.round(F.avg(sum((n[k] for k in NEGATIVE), F.lit(0))), 6).alias("mean_negative"))


@query(f"WITH {POSTS} SELECT coalesce(label, 'none') AS label, count(*) AS n, round(avg(len(cues)), 6) AS mean_cues, round(avg(n), 6) AS mean_tokens, count(DISTINCT source) AS n_sources FROM p GROUP BY 1")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A30, A33."""
    p = posts(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit("none")))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("cues")), 6).alias("mean_cues"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.countDistinct("source").alias("n_sources"))


@query(f"WITH {POSTS} SELECT CASE WHEN len(cues) >= 3 THEN '3+' ELSE CAST(len(cues) AS VARCHAR) END AS bucket, count(*) AS n, round(100 * avg(toxic), 4) AS pct_toxic FROM p GROUP BY 1 HAVING count(*) >= 3")
def rate_by_cue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    bucket = F.when(F.size("cues") >= 3, "3+").otherwise(F.size("cues").cast("string"))
    return A.rates(posts(spark, sf_dir).withColumn("bucket", bucket), {"toxic": F.col("toxic") == 1}, "bucket", least=3)


@query(f"""WITH {POSTS}, s AS (SELECT votes, {sql_any('t', CATEGORIES['ability'])} AS a, {sql_any('t', CATEGORIES['moral'])} AS b FROM p) SELECT count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS ability_only, count(*) FILTER (WHERE b AND NOT a) AS moral_only, count(*) FILTER (WHERE a AND b) AS both_kinds, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM s""")
def strategy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    a, b = (classify.has_any(F.col("t"), CATEGORIES[k]) for k in ("ability", "moral"))
    return posts(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("ability_only"), F.count_if(b & ~a).alias("moral_only"), F.count_if(a & b).alias("both_kinds"), F.count_if(~a & ~b).alias("neither"))


@query(f"WITH {POSTS} SELECT doc_id, CAST(majority AS INTEGER) AS majority, agreement, round(len(list_filter(votes, lambda x: x = 1)) / 3, 6) AS normal_share, CASE len(list_filter(votes, lambda x: x = 1)) WHEN 3 THEN 'perfect' WHEN 2 THEN 'majority' ELSE 'minority' END AS bucket, len(list_filter(votes, lambda x: x = 1)) = 2 AS borderline, array_to_string(targets, ',') AS targets FROM p")
def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 to P11."""
    v = F.col("votes")
    return posts(spark, sf_dir).select("doc_id", "majority", "agreement", F.round(agreement.normal_share(v), 6).alias("normal_share"), agreement.agreement_bucket(v).alias("bucket"), agreement.is_borderline(v).alias("borderline"), F.array_join("targets", ",").alias("targets"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 over a large table: the filter reaches the scan, two columns of keys are summed in parts."""
    d = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
