"""Queries: round trips through files, lookups and guards, row rules that other queries leave out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..functions.lexicons import CATEGORIES, EMOTIONS, FRAME_WORDS, GROUPS, INSULTS, NEGATIVE, REFUSALS, SUFFIXES
from ..operators import gates as G
from ..operators import generate, guards
from ..sources import readers, sinks
from .tables import DOCS, POSTS, docs, folder, posts, sql_any, sql_list, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line ends and quotes, written and read as delimited text."""
    path = _path(spark, "csv")
    sinks.csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")), path, quote_all=True)
    return readers.csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    path = _path(spark, "tsv")
    sinks.csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, sep="\t")
    return readers.csv(spark, path, "n_nationkey long, n_name string, n_regionkey long", sep="\t")


_EMOTION_ROWS = ", ".join(f"('{w}', '{k}')" for k, ws in EMOTIONS.items() for w in ws)
_VOCABULARY = f"WITH {DOCS}, voc AS (SELECT DISTINCT unnest(t) AS word FROM d), l(word, emotion) AS (VALUES {_EMOTION_ROWS})"


def _corpus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The emotions of all words of the corpus, by a headerless table of each word, emotion and 0 or 1 that is written and read."""
    path = _path(spark, "lexicon")
    words = docs(spark, sf_dir).select(F.explode("t").alias("word")).distinct()
    each = F.array(*[F.struct(F.lit(k).alias("emotion"), F.col("word").isin(*ws).cast("int").alias("association")) for k, ws in EMOTIONS.items()])
    sinks.csv(words.select("word", F.inline(each)), path, sep="\t", header=False)
    return readers.emotion_lexicon(spark, path)


@query(f"{_VOCABULARY} SELECT word, emotion FROM voc JOIN l USING (word)")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a headerless table of every word of the corpus, emotion and 0 or 1."""
    return _corpus_lexicon(spark, sf_dir)


@query(f"{_VOCABULARY} SELECT word, count(DISTINCT emotion) AS n FROM voc JOIN l USING (word) WHERE list_contains({sql_list(NEGATIVE)}, emotion) GROUP BY 1 HAVING count(DISTINCT emotion) >= 1")
def negative_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's words with negative emotions, and how many."""
    return readers.negative_words(_corpus_lexicon(spark, sf_dir), NEGATIVE, 1)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'efbbbf' AS head, 'results/nation.csv' AS file FROM nation")
def moved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as one file with a byte-order mark, moved into a folder of results and read from there."""
    path = _path(spark, "artefacts")
    sinks.one_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{path}/nation.csv")
    (moved,) = sinks.move(spark, [f"{path}/nation.csv", f"{path}/absent.csv"], f"{path}/results")
    head = spark.read.format("binaryFile").load(moved).select(F.lower(F.hex(F.substring("content", 1, 3))).alias("head"), F.regexp_extract("path", "results/[^/]*$", 0).alias("file"))
    return readers.csv(spark, moved, "n_nationkey long, n_name string").crossJoin(F.broadcast(head))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_custkey % 3 <> 0")
def arity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too few fields are left out."""
    path = _path(spark, "lines")
    o = table(spark, sf_dir, "orders")
    three = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    o.select(F.when(F.col("o_custkey") % 3 == 0, F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))).otherwise(three).alias("value")).write.text(path)
    return readers.pairs_with_arity(spark, path, ["k", "status", "priority"], 3)


@query(f"WITH {POSTS} SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n AS INTEGER) AS n_tokens, array_to_string(votes, ',') AS votes, CAST(n AS INTEGER) AS n_marks, CAST(len(cues) AS INTEGER) AS n_marked FROM p")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with annotators and rationales as JSON objects keyed by id, in files of about 500 posts each."""
    path = _path(spark, "posts")
    p = posts(spark, sf_dir)
    marks = F.transform("t", lambda t: t.isin(*INSULTS).cast("int"))
    who = F.transform("votes", lambda v: F.struct(v.cast("string").alias("label"), F.col("targets").alias("target")))
    body = F.struct(F.col("t").alias("post_tokens"), who.alias("annotators"), F.array(marks).alias("rationales"))
    files = p.count() // 500 + 1
    whole = p.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), body))).alias("m"))
    whole.select("part", F.to_json("m").alias("value")).write.partitionBy("part").text(path)
    found = readers.nested_posts(spark, path)
    first = F.get("rationales", F.lit(0))
    return found.select("id", F.size("post_tokens").alias("n_tokens"), F.array_join(F.transform("annotators", lambda a: a.label), ",").alias("votes"), F.size(first).alias("n_marks"), F.size(F.filter(first, lambda x: x == 1)).alias("n_marked"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended to a log; then the table is built once and read."""
    log, built = _path(spark, "log"), _path(spark, "cached")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("O", "F", "P"):
        sinks.append(o.where(F.col("o_orderstatus") == status), log)
    sums = readers.cached(spark, built, lambda: spark.read.parquet(log).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys")))
    assert sums.columns == readers.cached(spark, built, lambda: spark.createDataFrame([], "never int")).columns
    return sums


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def files_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a folder for each language; a class is read without the others."""
    path = _path(spark, "classes")
    sinks.by_class(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), path, "lang")
    return spark.read.schema("doc_id long, n_chars long, lang string").parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query(f"""WITH {POSTS} SELECT doc_id, array_to_string(targets, ',') AS parsed, CAST(len(targets) AS INTEGER) AS n, list_contains(targets, 'EN') AS has_en, array_to_string(list_sort(list_filter(targets, lambda x: x IN ('EN', 'DE'))), ',') AS both,
array_to_string(list_sort(list_filter(targets, lambda x: x NOT IN ('EN', 'DE'))), ',') AS without, CASE label WHEN 'hate' THEN 1 WHEN 'normal' THEN 0 END AS code, regexp_matches(low, '(nicht|not)') AS any_of FROM p""")
def literals_and_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List literals, label codes, sets of targets, one of several patterns."""
    p = posts(spark, sf_dir)
    literal = F.concat(F.lit("["), F.array_join(F.transform("targets", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    q = p.withColumn("list", parse.list_literal(literal))
    some = classify.words("EN", "DE")
    return q.select(
        "doc_id", F.array_join("list", ",").alias("parsed"), F.size("list").alias("n"), F.array_contains("list", "EN").alias("has_en"), F.array_join(F.array_sort(F.array_intersect("list", some)), ",").alias("both"),
        F.array_join(F.array_sort(F.array_except("list", some)), ",").alias("without"), parse.label_code(F.col("label")).alias("code"), F.col("low").rlike("nicht|not").alias("any_of"),
    )


@query("SELECT source AS group_name, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def counts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group_name")).agg(F.count("*").alias("n")).orderBy("group_name")


_PARTS = {"nothing": ("no", "thing"), "into": ("in", "to"), "der": ("d", "er")}
_SPLIT = "CASE x " + " ".join(f"WHEN '{k}' THEN {sql_list((k, *v))}" for k, v in _PARTS.items()) + " ELSE [x] END"


@query(f"WITH {DOCS} SELECT doc_id, md5(array_to_string(flatten(list_transform(t, lambda x: {_SPLIT})), ' ')) AS split_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain_md5 FROM d")
def compounds_and_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words followed by their parts; emoji put into every text and taken out again."""
    d = docs(spark, sf_dir)
    with_emoji = F.concat(F.lit("\U0001f600 "), F.col("text"), F.lit(" ☀️"))
    return d.select("doc_id", F.md5(F.array_join(parse.compound_split(F.col("t"), _PARTS), " ")).alias("split_md5"), F.md5(parse.without_emoji(with_emoji)).alias("plain_md5"))


@query(f"WITH {DOCS}, l AS (SELECT DISTINCT lang AS category, unnest(t) AS w FROM d), e AS (SELECT DISTINCT category, w || s AS term FROM l, (SELECT unnest({sql_list(SUFFIXES)}) AS s)) SELECT category, count(*) AS n, CAST(sum(length(term)) AS BIGINT) AS chars, min(term) AS first, max(term) AS last FROM e GROUP BY 1")
def expanded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of each language with its regular endings, summed up."""
    words = docs(spark, sf_dir).select(F.col("lang").alias("category"), F.explode("t").alias("term")).distinct()
    e = readers.expanded(words)
    return e.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("term")).cast("long").alias("chars"), F.min("term").alias("first"), F.max("term").alias("last"))


_LEMMAS = (("was", "be"), ("is", "be"), ("are", "be"), ("des", "de"), ("los", "el"))


@query(f"WITH {DOCS}, x AS (SELECT DISTINCT doc_id, unnest(t) AS word FROM d), l(word, lemma) AS (VALUES {', '.join(map(str, _LEMMAS))}), f AS (SELECT doc_id, word AS form FROM x UNION SELECT doc_id, lemma FROM x JOIN l USING (word)) SELECT d.doc_id, count(form) AS n_forms, md5(coalesce(string_agg(form, ' ' ORDER BY form), '')) AS forms_md5 FROM d LEFT JOIN f USING (doc_id) GROUP BY 1")
def lemma_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words and their lemmas by a lookup table."""
    found = guards.lemmas(docs(spark, sf_dir), "doc_id", "t", spark.createDataFrame(_LEMMAS, "word string, lemma string"))
    return found.select("doc_id", F.size("forms").cast("long").alias("n_forms"), F.md5(F.array_join("forms", " ")).alias("forms_md5"))


@query(f"WITH {POSTS}, m AS (SELECT lang, n, list_filter(range(1, n + 1), lambda i: list_contains(cues, t[i])) AS m FROM p) SELECT lang, count(*) AS n, round(median(len(m) / n), 6) AS coverage, round(median(CAST(m[len(m)] - m[1] + 1 AS DOUBLE)), 6) AS span FROM m WHERE len(m) > 0 GROUP BY 1")
def rationale_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first rationale that marks anything; one that marks nothing comes before it."""
    marks = F.transform("t", lambda t: t.isin(*INSULTS).cast("int"))
    none = F.transform("t", lambda t: F.lit(0))
    return guards.rationale_medians(posts(spark, sf_dir).withColumn("r", F.array(none, marks)), "r", "lang")


@query(f"WITH {POSTS}, c AS ({' UNION ALL '.join(f'''SELECT '{k}' AS category, {sql_any('t', ws)} AS hit, agreement FROM p''' for k, ws in CATEGORIES.items())}) SELECT category, count(*) FILTER (WHERE hit) AS n, round(100 * avg(CAST(hit AS INTEGER)), 4) AS pct, round(100 * avg(CASE WHEN hit THEN CAST(agreement = 'majority' AS INTEGER) END), 4) AS pct_borderline FROM c GROUP BY 1")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each category, their share, and the share of them that is borderline; one scan."""
    each = F.array(*[F.struct(F.lit(k).alias("category"), classify.has_any(F.col("t"), ws).alias("hit")) for k, ws in CATEGORIES.items()])
    rows = posts(spark, sf_dir).select("agreement", F.inline(each))
    split = F.when(F.col("hit"), (F.col("agreement") == "majority").cast("int"))
    return rows.groupBy("category").agg(F.count_if("hit").alias("n"), F.round(100 * F.avg(F.col("hit").cast("int")), 4).alias("pct"), F.round(100 * F.avg(split), 4).alias("pct_borderline"))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN {sql_any('t', CATEGORIES['moral'])} THEN 'strong' WHEN {sql_any('t', CATEGORIES['ability'])} THEN 'medium' WHEN {sql_any('t', CATEGORIES['status'])} THEN 'weak' ELSE 'Other' END AS strength, CASE source WHEN 'src1' THEN 'keep' WHEN 'src2' THEN 'drop' ELSE 'ask' END AS rule FROM d")
def strength_and_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's strongest class of categories; the rule for its kind's first word."""
    found = F.array_compact(F.array(*[F.when(classify.has_any(F.col("t"), ws), F.lit(k)) for k, ws in CATEGORIES.items()]))
    kind = F.concat(F.lit(" "), F.col("source"), F.lit(" / other"))
    return docs(spark, sf_dir).select("doc_id", classify.category_strength(found).alias("strength"), guards.type_rule(kind, {"SRC1": "keep", "SRC2": "drop"}, "ask").alias("rule"))


_FIRST_GROUP = GROUPS[0][0]


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN '{_FIRST_GROUP}' ELSE 'women' END AS group_name, regexp_matches(substr(text, 1, 200), '[a-z,] [A-Z][a-z]+ [A-Z][a-z]+') AS person FROM documents WHERE lang IN ('en', 'de')")
def guarded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no rule maps are left out, values are known ones, a text's head names a person."""
    d = table(spark, sf_dir, "documents").withColumn("name", F.when(F.col("lang") == "en", f"{_FIRST_GROUP} people").when(F.col("lang") == "de", "Women (18-30)").otherwise("of no group"))
    mapped, _ = guards.mapped_groups(d, "name")
    return guards.only_known(mapped, "lang", ("en", "de")).select("doc_id", F.col("group").alias("group_name"), guards.names_person(F.col("text")).alias("person"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5, row_number() OVER (ORDER BY coalesce(length(text), -1) DESC, doc_id) - 1 AS place, (row_number() OVER (ORDER BY coalesce(length(text), -1) DESC, doc_id) - 1) // 64 AS batch FROM documents")
def batches_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 from the longest text on; places bring results back to their rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return guards.length_batches(d, "doc_id", "text", 64).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"), "place", "batch")


_NEGATIVE = ("not", "nicht", "no", "ne")
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"SELECT doc_id, CASE WHEN NOT {sql_any(_WORDS, _NEGATIVE)} AND NOT ({' OR '.join(f'''strpos(lower(text), '{w}') > 0''' for w in FRAME_WORDS)}) THEN 'SOFT: no frame' ELSE 'PASS' END AS verdict FROM documents")
def neutral_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft flag of texts without a negative word or a frame's, as a verdict."""
    flag = G.no_frame_signal(F.col("text"), _NEGATIVE)
    return table(spark, sf_dir, "documents").select("doc_id", G.verdict([("SOFT: no frame", flag)]).alias("verdict"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 3 THEN md5(text) END AS text_md5, conv_id % 4 <> 3 AS parsed FROM conversations")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies in a code fence or without; short ones fail."""
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("answer"), F.lit("some words").alias("more")))
    fenced = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 4 == 3, "{}").otherwise(body)
    reply = generate.parsed_reply(fenced, "answer string, more string")
    return c.select("conv_id", "turn", F.md5(reply.answer).alias("text_md5"), reply.isNotNull().alias("parsed"))


_REFUSED = " OR ".join(f"strpos(lower(text), '{x.replace(chr(39), chr(39) * 2)}') > 0" for x in REFUSALS)


@query(f"""WITH c AS (SELECT conv_id, turn, text, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS n, {_REFUSED} AS refused FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'skipped' WHEN refused THEN 'refused' ELSE 'ok' END AS status, CASE WHEN n > 0 AND NOT refused THEN CAST(n - 8 AS VARCHAR) END AS length_diff, CASE WHEN n > 0 AND NOT refused THEN 'about sport 8 7 9 ' || CAST(n AS VARCHAR) END AS checked FROM c""")
def domain_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3, L4: turns about a domain in a budget; the stand-in drops the prompt's first word, so the rewrite is the input."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumns({"domain": F.lit("sport"), "n_tokens": F.lit(8)})
    keys = [("rewrite", "Rewrite {input}"), ("check", "x about {domain} {target_token_count} {min_token_count} {max_token_count} {candidate_token_count}")]
    found = generate.domain_turns(d, lambda prompt, history: " ".join(prompt.split()[1:]), keys, opening=[{"role": "user", "content": "Change each text on its own."}])
    return found.select("conv_id", "turn", "status", F.try_element_at("turns", F.lit("length_diff")).alias("length_diff"), F.try_element_at("turns", F.lit("check")).alias("checked"))


_PLAIN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))".format
_BOTH = _PLAIN("coalesce(text, '') || ' ' || source")
_NO = " OR ".join(f"strpos(lower({_BOTH}), '{x.replace(chr(39), chr(39) * 2)}') > 0" for x in REFUSALS)


@query(f"SELECT doc_id, CASE WHEN source IS NULL OR source = 'src1' THEN 'SKIP:second_refusal' WHEN lang = 'en' OR strpos(coalesce(text, ''), 'refuse') > 0 OR {_NO} THEN 'SKIP:analyze_failed' ELSE '' END AS flag, CASE WHEN source IS NULL OR source = 'src1' OR lang = 'en' OR strpos(coalesce(text, ''), 'refuse') > 0 OR {_NO} THEN md5('') ELSE md5({_BOTH}) END AS result_md5 FROM documents")
def pair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6 over whole texts: a refused second text, a refused turn, and a last turn that falls back to the one before it."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("lang") == "en", "refuse").otherwise(F.col("text")).alias("first"), F.when(F.col("source") == "src1", "I cannot do that.").otherwise(F.col("source")).alias("second"))
    keys = [("analyze", "A {first} {second}"), ("rewrite", "B {first} {second}"), ("check", "refuse {rewrite}")]
    return generate.pair_chain(d, generate.echo, keys, "first", "second").select("doc_id", "flag", F.md5("result").alias("result_md5"))


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN strpos(text, 'refuse') > 0 THEN 'I cannot do that.' ELSE nullif({_PLAIN("text")}, '') END AS reply, text IS NULL AS none FROM documents),
f AS (SELECT *, reply IS NULL OR length(reply) >= 3000 AS long, reply IS NULL OR strpos(reply, '@') > 0 AS mail FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN long THEN 'short' END, CASE WHEN mail THEN 'no_mail' END], lambda x: x IS NOT NULL), ',') AS failed, CASE WHEN none THEN 0 WHEN long OR mail THEN 3 ELSE 1 END AS attempts, md5(reply) AS reply_md5 FROM f""")
def validated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 over whole texts: tried again while a check fails, then kept with the check's name."""
    checks = {"short": lambda text, reply: len(reply) < 3000, "no_mail": lambda text, reply: "@" not in reply}
    found = generate.validated(table(spark, sf_dir, "documents").select("doc_id", "text"), generate.echo, "Say {input}", checks, "text")
    return found.select("doc_id", F.array_join("failed", ",").alias("failed"), "attempts", F.md5("reply").alias("reply_md5"))
