"""The corpus that the queries see, made from the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agreement, classify, parse
from ..functions.lexicons import INSULTS, STRIP, TARGETS
from ..storage import folder as folder
from ..storage import stored as stored

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens (``t``), lower-case text (``low``) and the cue words met (``cues``)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = d.withColumn("t", parse.tokens(F.col("text"))).withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    return d.withColumn("n", F.size("t")).withColumn("cues", classify.hits(F.col("t"), INSULTS))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with three annotators' votes, their majority and agreement, and the groups they name."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    cue, toxic, bad = F.size("cues") > 0, F.col("toxic") == 1, F.col("quality") == 0
    v1 = F.when(toxic, 0).otherwise(1)
    v2 = F.when(bad, 2).when(toxic & cue, 0).otherwise(1)
    v3 = F.when(cue, 0).otherwise(1)
    d = d.withColumn("votes", F.array(v1, v2, v3)).withColumn("has_cue", cue.cast("int"))
    targets = F.array_compact(F.array(*[F.when(classify.has_any(F.col("t"), w), F.lit(k)) for k, w in TARGETS.items()]))
    return d.withColumn("majority", agreement.majority(F.col("votes"), "none")).withColumn("agreement", agreement.agreement(F.col("votes"))).withColumn("label", agreement.label_name(F.col("majority"))).withColumn("targets", targets)


# --- The same in SQL, as the first parts of a WITH clause ---------------------------------------------------------


def sql_list(terms) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def sql_any(column: str, terms) -> str:  # noqa: ANN001
    return f"list_has_any({column}, {sql_list(terms)})"


_STRIP = STRIP.replace("'", "''")
DOCS = f"""d0 AS (SELECT doc_id, text, lang, source, lower(coalesce(text, '')) AS low FROM documents),
d1 AS (SELECT *, list_filter(list_transform(string_split_regex(low, '\\s+'), lambda x: trim(x, '{_STRIP}')), lambda x: x <> '') AS t FROM d0),
d AS (SELECT *, CAST(len(t) AS INTEGER) AS n, list_filter(t, lambda x: x IN ({", ".join(repr(w) for w in INSULTS)})) AS cues FROM d1)"""
_TARGETS = ", ".join(f"CASE WHEN {sql_any('t', w)} THEN '{k}' END" for k, w in TARGETS.items())
POSTS = f"""{DOCS},
p0 AS (SELECT d.*, quality, toxic, CAST(len(cues) > 0 AS INTEGER) AS has_cue,
       [CASE WHEN toxic = 1 THEN 0 ELSE 1 END, CASE WHEN quality = 0 THEN 2 WHEN toxic = 1 AND len(cues) > 0 THEN 0 ELSE 1 END, CASE WHEN len(cues) > 0 THEN 0 ELSE 1 END] AS votes,
       list_filter([{_TARGETS}], lambda x: x IS NOT NULL) AS targets FROM d JOIN labels USING (doc_id)),
p1 AS (SELECT *, len(list_distinct(votes)) AS kinds FROM p0),
p2 AS (SELECT *, CASE WHEN kinds = 3 THEN -1 WHEN votes[1] = votes[2] OR votes[1] = votes[3] THEN votes[1] ELSE votes[2] END AS majority,
       CASE kinds WHEN 1 THEN 'unanimous' WHEN 3 THEN 'split' ELSE 'majority' END AS agreement FROM p1),
p AS (SELECT *, CASE majority WHEN 0 THEN 'hate' WHEN 1 THEN 'normal' WHEN 2 THEN 'offensive' END AS label FROM p2)"""
