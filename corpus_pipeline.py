"""From raw documents to token ids: quality, near copies, benchmark passages, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.bpe import encode_texts
from corpuslab.llm.common import forget, once_each, table, written
from corpuslab.llm.decontaminate import remove_spans
from corpuslab.llm.jaccard import jaccard_components
from corpuslab.llm.quality import judge
from corpuslab.llm.secrets import redact


#: Bytes of a batch that goes to a Python worker; documents are long, and stages follow each other in one session.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles at 0.8 join: the one with the least id, then text.

    Of rows with one id and text, one by a checksum of the other columns. Documents without words link with nothing and stay.
    """
    spark.conf.set(*BATCH)
    keyed = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit(""))))
    found = jaccard_components(keyed.select("doc_id", "text", "__key"), 5, 80, keep=["doc_id", "__key"])
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "__key")).alias("f")).select("f.*")
    some = F.coalesce("text", F.lit("")).rlike("[^\\x20\\t-\\r]")
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    rows = keyed.withColumn("__rest", F.xxhash64(F.lit(0), *rest))
    # Of rows with one id and text, the one with the least checksum of the other columns.
    least = rows.where(some).groupBy("doc_id", "__key").agg(F.min("__rest").alias("__rest"))
    wanted = least.join(first.hint("merge"), least["__key"].eqNullSafe(first["__key"]) & least["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    digest = F.md5(F.concat_ws(":", "__key", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "__rest"))
    kept = once_each(rows.where(some).withColumn("__row", digest), written(wanted.select(digest.alias("__row")), "kept-rows"), "__row")
    return kept.select(docs.columns).unionByName(docs.where(~some))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of any 10-word window of the benchmark; those hit in over half of their words go."""
    spark.conf.set(*BATCH)
    return _counted(remove_spans(docs, table(spark, sf_dir, "benchmark"))).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    spark.conf.set(*BATCH)
    return _counted(redact(docs)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: little-endian unsigned 32-bit integers."""
    spark.conf.set(*BATCH)
    import public_tokenizers

    found = encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("BPE encoding", tokens)]

#: The removal of links' groups and of spans has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written; a stage's table goes when the next one's is there. Leaves the session as it was."""
    before = spark.conf.get(BATCH[0], None)
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for _, stage in STAGES:
            docs, last = written(stage(spark, docs, sf_dir), "stage"), docs
            forget(last)
    finally:
        if before is None:
            spark.conf.unset(BATCH[0])
        else:
            spark.conf.set(BATCH[0], before)
    return docs
