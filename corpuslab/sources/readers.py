"""Readers of annotated corpora, lexicons and artefacts. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import SUFFIXES

POSTS = "post_id string, text string, post_tokens string, annotators string, targets string, gold_label int"
POST = "struct<post_tokens:array<string>,annotators:array<struct<label:string,target:array<string>>>,rationales:array<array<int>>>"


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with quoted fields over several lines, doubled quotes, a byte-order mark or none."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def posts(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, POSTS)


def nested_posts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object keyed by id, as (id, post_tokens, annotators, rationales). A file is one record, so split large
    corpora over many files, or convert them to lines once."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{POST}>").alias("m"))
    return whole.select(F.explode("m").alias("id", "post")).select("id", "post.*")


def pairs_with_arity(spark: SparkSession, path: str, names: Sequence[str], least: int, sep: str = "\t") -> DataFrame:
    """Lines with ``least`` fields or more; others are left out."""
    parts = spark.read.text(path).select(F.split("value", sep).alias("p")).where(F.size("p") >= least)
    return parts.select(*[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, emotion) of a headerless table word, emotion, 0 or 1."""
    rows = csv(spark, path, "word string, emotion string, association int", "\t", header=False)
    return rows.where("association = 1").select(F.lower("word").alias("word"), "emotion")


def valences(spark: SparkSession, path: str, most: int = 500_000) -> dict[str, float]:
    """Words and valences of a headerless table whose first two fields they are; more than ``most`` words are an error."""
    rows = pairs_with_arity(spark, path, ["word", "valence"], 2).select(F.lower("word").alias("word"), F.col("valence").try_cast("double").alias("v")).where("v IS NOT NULL AND word <> ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words with valences")
    return {r["word"]: r["v"] for r in rows}


def negative_words(lexicon: DataFrame, negative: Sequence[str], least: int = 2) -> DataFrame:
    """Words with ``least`` negative emotions or more."""
    return lexicon.where(F.col("emotion").isin(*negative)).groupBy("word").agg(F.countDistinct("emotion").alias("n")).where(F.col("n") >= least)


def category_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) of a table with header and at least category, stereotype and lemma."""
    return pairs_with_arity(spark, path, ["category", "stereotype", "term"], 3).where((F.col("category") != "category") & (F.length("term") > 1)).select("category", F.lower("term").alias("term")).distinct()


def expanded(lexicon: DataFrame, term: str = "term", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """The lexicon with regular endings of every term."""
    return lexicon.withColumn(term, F.explode(F.array(*[F.concat(F.col(term), F.lit(s)) for s in suffixes]))).distinct()


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """(id): the first word of every line that is not blank and no comment."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.get(F.split(line, r"\s+"), F.lit(0)).alias("id")).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written first if its last write did not end."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values): rows of array files (.npy) under ``path``, read by the tasks; a vector has one row.

    More than two dimensions are flattened behind the first. Arrays of objects are refused, as reading them would run code.
    """
    import io

    import numpy as np
    import pandas as pd

    def work(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                rows = np.atleast_2d(found).reshape(1 if found.ndim < 2 else len(found), -1).astype(np.float64)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pd.DataFrame({"file": name, "row": np.arange(at, at + len(part)), "values": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(work, "file string, row long, values array<double>")


def model(path: str):  # noqa: ANN201
    """A fitted pipeline that ``sinks.model`` wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def union_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet tables one after the other; tables that are not there are left out, columns that lack are null."""
    found = [spark.read.parquet(p) for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(", ".join(paths))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def pair_columns(df: DataFrame) -> DataFrame:
    """``original`` and ``output``, whichever of the known names the columns have; hate_type stays in its row."""
    variants = {"original": ("original_text", "text_clean", "cell_a", "original"), "output": ("output_text", "generated_text", "cell_c_modified", "cell_c_generated", "output")}

    def one(name: str) -> Column:
        there = [F.col(c) for c in variants[name] if c in df.columns]
        if not there:
            raise ValueError(f"no column for {name}: {', '.join(variants[name])}")
        return F.coalesce(*there).alias(name)

    rest = [c for c in df.columns if c not in {*variants["original"], *variants["output"]}]
    return df.select(one("original"), one("output"), *rest)
