"""Queries: parsing and classification of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..functions.lexicons import (
    ATTACK_TYPES, CATEGORIES, COMMANDS, DOMAIN_BLACKLIST, DOMAINS, EXCLUSION_PHRASES, FIRST_COMMANDS, FIRST_MOCKING, FRAMES, GENERAL_VERBS, GENERAL_WORDS, GROUP_MARKERS, HATE_PHRASES, INDIVIDUAL_MARKERS, MASKS, MEDIUM,
    MOCKING_WORDS, NARRATIVE_WORDS, PAST_WORDS, PREFERENCE_TRIGGERS, PREFERRED_DOMAINS, QUANTIFIERS, QUESTION_WORDS, STRONG, WEAK, WISHES,
)
from ..operators.select import order_key
from .tables import DOCS, POSTS, docs, posts, sql_any, sql_list, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(c):  # noqa: ANN001, ANN201
    return F.array_join(F.array_sort(c), ",")


@query(f"WITH {DOCS} SELECT doc_id, n AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, CAST(len(regexp_extract_all(low, '[a-z]+')) AS INTEGER) AS n_letter_runs, CAST(len(list_distinct(regexp_extract_all(low, '[a-z]+'))) AS INTEGER) AS n_letter_set FROM d")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P16, P17."""
    return docs(spark, sf_dir).select("doc_id", F.col("n").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.regexp_count("low", F.lit("[a-z]+")).alias("n_letter_runs"), F.size(parse.letter_set(F.col("text"))).alias("n_letter_set"))


@query("""WITH r AS (SELECT doc_id, '[' || array_to_string(list_concat(list_transform(coalesce(string_split(text, ' '), []), lambda x: CASE WHEN strpos(x, '''') = 0 THEN '''' || x || '''' WHEN strpos(x, '"') = 0 THEN '"' || x || '"' ELSE '''' || replace(x, '''', '\\''') || '''' END), ['"don''t"']), ' ') || ']' AS repr FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(repr, '''([^'']*)''|"([^"]*)"')) AS INTEGER) AS n_items, 'don''t' AS last_item, CAST(len(regexp_extract_all(repr, '''([^'']+)''')) AS INTEGER) AS n_single FROM r""")
def token_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P3 over token lists written as text: all tokens, in double quotes where one holds an apostrophe."""
    single, double = (F.lit(x) for x in "'\"")
    quoted = lambda t: (
        F.when(~t.contains("'"), F.concat(single, t, single)).when(~t.contains('"'), F.concat(double, t, double)).otherwise(F.concat(single, F.replace(t, single, F.lit("\\'")), single))
    )
    written = F.transform(F.coalesce(F.split("text", " "), F.array().cast("array<string>")), quoted)
    r = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(F.concat(written, F.array(F.lit('"don\'t"'))), " "), F.lit("]")).alias("repr"))
    items = parse.quoted_items(F.col("repr"))
    return r.select("doc_id", F.size(items).alias("n_items"), F.element_at(items, -1).alias("last_item"), parse.single_quoted_count(F.col("repr")).alias("n_single"))


@query(f"""WITH {POSTS}, q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' WHEN doc_id % 3 = 0 THEN '''label'': array([' || array_to_string(votes, ', ') || '])' ELSE '''label'': [' || array_to_string(votes, ',') || ']' END AS cell, votes FROM p)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE array_to_string(votes, ',') END AS parsed FROM q""")
def vote_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from either spelling, none from a blank cell."""
    p = posts(spark, sf_dir)
    comma = lambda s: F.array_join(F.transform("votes", lambda x: x.cast("string")), s)
    cell = F.when(F.col("doc_id") % 3 == 2, "").when(F.col("doc_id") % 3 == 0, F.concat(F.lit("'label': array(["), comma(", "), F.lit("])"))).otherwise(F.concat(F.lit("'label': ["), comma(","), F.lit("]")))
    return p.select("doc_id", F.array_join(F.transform(parse.vote_list(cell), lambda x: x.cast("string")), ",").alias("parsed"))


@query(f"WITH {DOCS} SELECT doc_id, {', '.join(f'CAST({sql_any('t', v)} AS INTEGER) AS has_{k}' for k, v in CATEGORIES.items())}, CAST({' + '.join(f'CAST({sql_any('t', v)} AS INTEGER)' for v in CATEGORIES.values())} AS INTEGER) AS n_categories FROM d")
def lexicon_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for each category, and how many are raised."""
    d = docs(spark, sf_dir)
    flags = classify.category_flags(F.col("t"))
    return d.select("doc_id", *[c.alias(f"has_{k}") for k, c in flags.items()], sum(flags.values(), F.lit(0)).alias("n_categories"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _frame_sql(f) -> str:  # noqa: ANN001
    parts = ([sql_any("t", f.words)] if f.words else []) + ([f"regexp_matches(low, {_quoted('|'.join(f.patterns))})"] if f.patterns else [])
    return f"CASE WHEN {' OR '.join(parts)} THEN '{f.name}' END"


_FRAMES = f"list_filter([{', '.join(map(_frame_sql, FRAMES))}], lambda x: x IS NOT NULL)"


@query(f"WITH {DOCS}, f AS (SELECT doc_id, {_FRAMES} AS f FROM d) SELECT doc_id, CASE WHEN len(f) = 0 THEN 'NONE_DETECTED' ELSE array_to_string(f, '+') END AS frames, CASE WHEN len(f) = 0 THEN 'NONE_DETECTED' ELSE f[1] END AS primary_frame, CAST(greatest(len(f), 1) AS INTEGER) AS n_frames FROM f")
def framing_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in table order, and the first."""
    d = docs(spark, sf_dir).select("doc_id", classify.frames(F.col("t"), F.col("low")).alias("f"))
    return d.select("doc_id", F.array_join("f", "+").alias("frames"), F.element_at("f", 1).alias("primary_frame"), F.size("f").alias("n_frames"))


_FIRST = FRAMES[0]
_EXCL = FRAMES[2]


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in _FIRST.words)})), ',') AS word_items, array_to_string(list_filter([{', '.join(f'''regexp_extract(low, {_quoted(f'({p})')}, 1)''' for p in _EXCL.patterns)}], lambda x: x <> ''), ',') AS pattern_items FROM d")
def framing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matched."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.array_join(classify.frame_items(F.col("t"), F.col("low"), _FIRST), ",").alias("word_items"), F.array_join(classify.frame_items(F.col("t"), F.col("low"), _EXCL), ",").alias("pattern_items"))


def _contains(terms) -> str:  # noqa: ANN001
    return " OR ".join(f"strpos(low, {_quoted(t)}) > 0" for t in terms)


_SETS = {"EXCLUSION": _contains(EXCLUSION_PHRASES), "GENERALIZATION": f"{sql_any('t', QUANTIFIERS)} AND {sql_any('t', GENERAL_VERBS)}"}


def _set_sql(f) -> str:  # noqa: ANN001
    return f"CASE WHEN {_SETS.get(f.name) or sql_any('t', f.words)} THEN '{f.name}' END"


_BY_SETS = f"list_filter([{', '.join(map(_set_sql, FRAMES))}], lambda x: x IS NOT NULL)"


@query(f"WITH {DOCS}, f AS (SELECT doc_id, {_BY_SETS} AS f FROM d) SELECT doc_id, CASE WHEN len(f) = 0 THEN 'NONE_DETECTED' ELSE array_to_string(f, '+') END AS frames FROM f")
def framing_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases for exclusion, a quantifier and a verb for generalisation."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(classify.frames_by_sets(F.col("t"), F.col("low")), "+").alias("frames"))


@query(f"""WITH {DOCS}, a AS (SELECT doc_id, list_filter([
CASE WHEN list_contains(t[1:n-1], 'you') THEN 'DIRECT_ADDRESS' END,
CASE WHEN {sql_any('t', ('they', 'all', 'every'))} AND {sql_any('t[2:n]', ('are', 'is', 'was', 'were'))} THEN 'GROUP_STATEMENT' END,
CASE WHEN {sql_any('t[1:3]', COMMANDS)} THEN 'IMPERATIVE' END,
CASE WHEN strpos(low, '?') > 0 OR list_contains({sql_list(QUESTION_WORDS)}, coalesce(t[1], '')) THEN 'QUESTION' END,
CASE WHEN {sql_any('t', ('wish', 'hope', 'should', 'deserve'))} OR strpos(low, 'need to') > 0 OR strpos(low, 'want to') > 0 THEN 'WISH_DESIRE' END,
CASE WHEN len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in PAST_WORDS)}))) >= 2 THEN 'NARRATIVE' END,
CASE WHEN n <= 6 THEN 'SHORT_LABEL' END,
CASE WHEN {sql_any('t', MOCKING_WORDS)} THEN 'MOCKERY_SARCASM' END,
CASE WHEN list_contains(t, 'hate') AND {sql_any('t', ('i', 'we'))} THEN 'HATE_DECLARATION' END], lambda x: x IS NOT NULL) AS a FROM d)
SELECT doc_id, CASE WHEN len(a) = 0 THEN 'OTHER' ELSE array_to_string(a, '+') END AS acts FROM a""")
def speech_act_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(classify.speech_acts(F.col("t"), F.col("low")), "+").alias("acts"))


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN {sql_any('t', ('you', 'your'))} THEN 'DIRECT_ADDRESS' WHEN {sql_any('t[1:3]', FIRST_COMMANDS)} THEN 'IMPERATIVE'
WHEN {_contains(WISHES)} THEN 'WISH_DESIRE' WHEN {sql_any('t', FIRST_MOCKING)} THEN 'MOCKERY_SARCASM' WHEN n <= 6 THEN 'SHORT_LABEL'
WHEN {sql_any('t', GENERAL_WORDS)} THEN 'GROUP_STATEMENT' WHEN strpos(low, '?') > 0 THEN 'QUESTION' WHEN {_contains(HATE_PHRASES)} THEN 'HATE_DECLARATION' WHEN {sql_any('t', NARRATIVE_WORDS)} AND n > 15 THEN 'NARRATIVE' ELSE 'UNCLEAR' END AS act FROM d""")
def speech_act_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11."""
    return docs(spark, sf_dir).select("doc_id", classify.speech_act(F.col("t"), F.col("low")).alias("act"))


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN {sql_any('t', GROUP_MARKERS)} AND {sql_any('t', INDIVIDUAL_MARKERS)} THEN 'MIXED' WHEN {sql_any('t', GROUP_MARKERS)} THEN 'GROUP_ONLY' WHEN {sql_any('t', INDIVIDUAL_MARKERS)} THEN 'INDIVIDUAL_ONLY' ELSE 'UNCLEAR' END AS scope,
CASE WHEN {sql_any('t', STRONG)} THEN 'Strong' WHEN {sql_any('t', MEDIUM)} THEN 'Medium' WHEN {sql_any('t', WEAK)} THEN 'Weak' ELSE 'None' END AS strength,
CAST(regexp_matches(low, 'not|no|never|n''t') AS INTEGER) AS negation, CAST({sql_any('t', ('not', 'no', 'never'))} AS INTEGER) AS negation_word, CAST(strpos(low, '?') > 0 AS INTEGER) AS question, CAST({sql_any('t', ('if', 'would', 'could', 'should', 'unless'))} AS INTEGER) AS conditional FROM d""")
def scope_and_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, X5, X12, X14."""
    d, t = docs(spark, sf_dir), F.col("t")
    return d.select("doc_id", classify.reference_scope(t).alias("scope"), classify.cue_strength(t).alias("strength"), classify.has_negation(F.col("text")).cast("int").alias("negation"), classify.has_negation_word(t).cast("int").alias("negation_word"), F.col("low").contains("?").cast("int").alias("question"), classify.has_conditional(t).cast("int").alias("conditional"))


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN {sql_any('t', STRONG)} THEN 'explicit' WHEN {sql_any('t', (*MEDIUM, *WEAK))} THEN 'casual' WHEN regexp_matches(low, 'the .{{0,30}} is') THEN 'contextual' ELSE 'none' END AS kind,
coalesce(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in STRONG)}))[1], list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in (*MEDIUM, *WEAK))}))[1], CASE WHEN regexp_matches(low, 'the .{{0,30}} is') THEN 'pattern:the..is' ELSE '' END) AS reason,
round(len(cues) / greatest(n, 1), 6) AS density, CAST(len(cues) AS INTEGER) AS n_cues, CAST(regexp_matches(low, '(^|[^A-Za-z0-9_])(idiot|scum)($|[^A-Za-z0-9_])') AS INTEGER) AS whole_word FROM d""")
def cue_reclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X13, X16, X17."""
    d = docs(spark, sf_dir).withColumn("r", classify.reclassified(F.col("t"), F.col("low")))
    return d.select("doc_id", "r.kind", "r.reason", F.round(F.size("cues") / F.greatest("n", F.lit(1)), 6).alias("density"), F.size("cues").alias("n_cues"), classify.whole_word(F.col("low"), ("idiot", "scum")).cast("int").alias("whole_word"))


def _mask_sql(c: str) -> str:
    for p, tag in MASKS:
        c = f"regexp_replace({c}, '{p}', '{tag}', 'gi')"
    return c


@query(f"SELECT doc_id, md5({_mask_sql('text')}) AS masked_md5, CAST(len(list_filter(regexp_extract_all({_mask_sql('text')}, '\\[[A-Z_0-9]+\\]'), lambda x: x <> '[TARGET]')) > 0 AS INTEGER) AS other_tag FROM documents")
def premask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27, P28."""
    m = table(spark, sf_dir, "documents").select("doc_id", parse.masked(F.col("text")).alias("m"))
    return m.select("doc_id", F.md5("m").alias("masked_md5"), parse.has_other_tag(F.col("m")).cast("int").alias("other_tag"))


#: A reply's sentence: the text's letters, digits and blanks, in one line.
_SENTENCE = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH h AS (SELECT doc_id, {_SENTENCE} AS w FROM documents)
SELECT doc_id, w AS same_line, w AS next_line, w AS whole, w AS field_value, '- Kind: individuals' AS enforced FROM h WHERE w <> ''""")
def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from replies of several shapes, whole texts being what they say."""
    h = table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Za-z0-9]")).select("doc_id", F.trim(F.regexp_replace("text", "[^\\p{Alnum}]+", " ")).alias("w"))
    w = F.col("w")
    return h.select(
        "doc_id", parse.final_sentence(F.concat(F.lit('Note.\n**Final Sentence:** "'), w, F.lit('"\nMore'))).alias("same_line"), parse.final_sentence(F.concat(F.lit("- Final Transformed Sentence:\n\n  '"), w, F.lit("'\n"))).alias("next_line"),
        parse.final_sentence(F.concat(F.lit(' "'), w, F.lit('" '))).alias("whole"), parse.field(F.concat(F.lit("x\n- kind: "), w, F.lit("  \ny")), "Kind").alias("field_value"),
        parse.enforce_choice(F.concat(F.lit("- Kind: "), w), "Kind", ("people", "visitors"), "individuals").alias("enforced"),
    )


_TYPES = "CASE " + " ".join(f"WHEN {_contains(v)} THEN '{k}'" for k, v in ATTACK_TYPES) + " ELSE 'NONE_DETECTED' END"


@query(f"WITH {DOCS} SELECT doc_id, {_TYPES} AS attack_type, CASE source WHEN 'src1' THEN 'women' ELSE 'OTHER' END AS canonical, trim(regexp_replace(replace(text, '\"\"', '\"'), '\\s+', ' ', 'g')) = trim(regexp_replace(text, '\\s+', ' ', 'g')) AS unchanged, md5(trim(regexp_replace(regexp_replace(low, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS leakage_md5 FROM d")
def normalised_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, P26, P30, X21."""
    d = docs(spark, sf_dir)
    group = F.when(F.col("source") == "src1", "Women (18-30)").otherwise("xyz")
    return d.select("doc_id", classify.attack_type(F.col("low")).alias("attack_type"), parse.canonical_group(group).alias("canonical"), (parse.tidy(F.col("text")) == F.trim(F.regexp_replace("text", r"\s+", " "))).alias("unchanged"), F.md5(parse.leakage_key(F.col("text"))).alias("leakage_md5"))


_BAD = {k: [w for n, ws in DOMAIN_BLACKLIST if n == k for w in ws] for k, _ in DOMAIN_BLACKLIST}
_POOL = "list_filter({0}, lambda x: NOT ({1}))".format(sql_list(DOMAINS), " OR ".join(f"(list_contains(f, '{k}') AND ({' OR '.join(f'''strpos(x, '{w}') > 0''' for w in ws)}))" for k, ws in _BAD.items()))


@query(f"""WITH {DOCS}, f AS (SELECT doc_id, t, {_FRAMES} AS f FROM d), c AS (SELECT doc_id, CASE WHEN {sql_any('t', PREFERENCE_TRIGGERS)} THEN {sql_list(PREFERRED_DOMAINS)} ELSE {_POOL} END AS pool FROM f)
SELECT doc_id, pool[1 + CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|7'), 1, 7)) AS BIGINT) % len(pool)] AS domain FROM c""")
def domain_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preferred domain for some words, else one of the pool that no frame rules out, by md5."""
    d = docs(spark, sf_dir).withColumn("f", classify.frames(F.col("t"), F.col("low")))
    pool = classify.words(*DOMAINS)

    def ruled_out(x):  # noqa: ANN001, ANN202
        out = F.lit(False)
        for k, ws in DOMAIN_BLACKLIST:
            out = out | (F.array_contains("f", k) & classify.has_phrase(x, ws))
        return out

    chosen = F.when(classify.has_any(F.col("t"), PREFERENCE_TRIGGERS), classify.words(*PREFERRED_DOMAINS)).otherwise(F.filter(pool, lambda x: ~ruled_out(x)))
    at = F.conv(F.substring(order_key(F.col("doc_id"), 7), 1, 7), 16, 10).cast("long")
    return d.select("doc_id", F.get(chosen, (at % F.size(chosen)).cast("int")).alias("domain"))


@query(f"WITH {DOCS} SELECT doc_id, CAST(greatest(1, round_even(CAST(n AS DOUBLE) * CAST(0.85 AS DOUBLE), 0)) AS INTEGER) AS low_budget, CAST(greatest(1, round_even(CAST(n AS DOUBLE) * CAST(1.15 AS DOUBLE), 0)) AS INTEGER) AS high_budget, 'row_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 5, '0') AS sequential FROM d")
def budgets_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P31, X27, X28. Sequential ids need one order of all rows: ids only are ranked, in ranges, and their counts added."""
    from .tables import stored

    d = docs(spark, sf_dir)
    low, high = classify.budget(F.col("n"))
    from pyspark.sql import Window

    ranged = stored(d.select("doc_id", low.alias("low_budget"), high.alias("high_budget")).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))).join(F.broadcast(before), "part")
    return placed.select("doc_id", "low_budget", "high_budget", F.concat(F.lit("row_"), F.lpad((F.col("before") + F.col("i")).cast("string"), 5, "0")).alias("sequential"))


@query(f"WITH {DOCS} SELECT doc_id, 'From ' || source || ' (' || coalesce(lang, '') || '): ' || CAST(n AS VARCHAR) || ' words; ' AS line FROM d")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing names are empty."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", parse.rendered("From {source} ({lang}): {n} words; {missing}", {"source": F.col("source"), "lang": F.col("lang"), "n": F.col("n")}).alias("line"))
