"""Queries that read rows many times read their texts once or twice, and tasks hold few rows at a time."""

import math
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab import batches
from corpuslab.operators import alignment, generate, ml, tagger
from corpuslab.plans import models


def texts_read(df):
    return "documents.parquet" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["logreg_coefficients", "logreg_cross_validation", "ols_coefficients"])
def test_fits_read_written_features(spark, sf_dir, name):
    assert not texts_read(models._features(spark, sf_dir))
    assert models.QUERIES[name](spark, sf_dir).count() > 0


def shuffled(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_weights_leave_tasks_unshuffled(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a"]), (3, None), (4, []), (5, ["b", None])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = ml.tf_idf(df, "id", F.col("t"), 10, 1, 1.0)
    assert not shuffled(got)
    found = {(r["id"], r["token"]): r["weight"] for r in got.collect()}
    idf = {t: math.log(6 / 3) + 1 for t in "ab"}
    length = math.sqrt((2 * idf["a"]) ** 2 + idf["b"] ** 2)
    assert found == pytest.approx({(1, "a"): 2 * idf["a"] / length, (1, "b"): idf["b"] / length, (2, "a"): 1.0, (5, "b"): 1.0})


def test_rows_with_one_id_count_as_one(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (None, ["b"]), (None, ["b"])], "id int, t array<string>")
    found = {(r["id"], r["token"]): r["weight"] for r in ml.tf_idf(df, "id", F.col("t"), 10, 1, 1.0).collect()}
    a, b = 2 * (math.log(5 / 2) + 1), math.log(5 / 3) + 1
    length = math.sqrt(a * a + b * b)
    assert found == pytest.approx({(1, "a"): a / length, (1, "b"): b / length, (None, "b"): 1.0})


def test_batches_are_cut():
    rows = [["a"] * 60_000, None, [], ["b"] * 60_000, ["c"] * 250_000, ["d"]]
    parts = [*batches.cut(iter([pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["t"])]), "t")]
    assert [p.num_rows for p in parts] == [3, 1, 2]
    assert [r for p in parts for r in p.column("t").to_pylist()] == rows
    texts = pa.RecordBatch.from_arrays([pa.array(["x" * 70_000, None, "y" * 70_000])], names=["t"])
    assert [p.num_rows for p in batches.cut(iter([texts]), "t")] == [2, 1]


def test_chains_hold_few_texts_at_a_time():
    frame = pd.DataFrame({"a": ["x" * 600_000, None, "y" * 600_000], "b": ["z", "z", None]})
    parts = [*generate._parts(frame, ["a", "b"])]
    assert [len(p) for p in parts] == [2, 1] and pd.concat(parts).equals(frame)


def test_tags_keep_their_rows(spark):
    rows = [(1, ["we", "saw", "Anna"], ["O", "O", "B"]), (2, None, None), (3, [], []), (4, ["Bo"], ["B"])]
    df = spark.createDataFrame(rows, "id int, t array<string>, g array<string>")
    found = {r["id"]: r["tags"] for r in tagger.tagged(df, "t", tagger.fit(df, "t", "g", least=1)).collect()}
    assert {k: None if v is None else len(v) for k, v in found.items()} == {1: 3, 2: None, 3: 0, 4: 1}


def test_rows_align_where_they_are(spark, monkeypatch):
    """Few words: no shuffle of rows' words. Many: those beyond the most frequent come by a join, with the same results."""
    rows = [(k, [f"w{k % 7}", f"w{k % 5}", "the", "the"], [f"w{k % 3}", "the", f"u{k}"]) for k in range(40)] + [(40, None, ["a"]), (41, [], None)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    weights = spark.createDataFrame([("the", 0.1), *[(f"w{k}", 1.0 + k) for k in range(7)], *[(f"u{k}", 3.0) for k in range(0, 40, 2)]], "word string, idf double")
    told = spark.createDataFrame([(f"w{k}", [math.cos(k), math.sin(k)]) for k in range(7)], "word string, x array<double>")
    for known in (told, told.limit(0)):
        found = alignment.alignment(df, "id", "a", "b", known, weights)
        assert not shuffled(found)
        want = {tuple(r) for r in found.collect()}
        with monkeypatch.context() as m:
            m.setattr(alignment, "FEW_WORDS", 3)
            assert {tuple(r) for r in alignment.alignment(df, "id", "a", "b", known, weights).collect()} == want


def test_next_rows_align_in_blocks(spark):
    """Each row and the next, whatever their blocks, as pairs of rows have it; a row's words move once, by block."""
    rows = [(k, [f"w{k % 7}", f"w{k % 5}", "the", "the", f"u{k // 2}"] if k % 9 else None) for k in range(-9, 60) if k != 20] + [(30, ["the", "u15"]), (None, ["the"]), (70, [])]
    df = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    pairs = df.select("id", F.col("t").alias("a")).join(df.select((F.col("id") - 1).alias("id"), F.col("t").alias("b")), "id")
    weights = alignment.idf(df, "t").where("word <> 'u3'")
    none = spark.createDataFrame([], "word string, x array<double>")
    near = lambda found: sorted(tuple(round(x, 9) for x in r) for r in found.collect())
    want = near(alignment.alignment(pairs, "id", "a", "b", none, weights))
    assert len(want) == 68
    for few, block in ((100, 256), (3, 4), (0, 1)):
        assert near(alignment.next_alignment(df, "id", "t", weights, few=few, block=block)) == want


def test_next_rows_align_by_counted_contexts(spark, monkeypatch):
    """Vectors made in tasks from counted contexts, of frequent words and of those that come to the blocks, align as word vectors do."""
    rng = random.Random(5)
    rows = [(k, [rng.choice(["the", "of", "a", f"w{rng.randrange(30)}", f"u{rng.randrange(200)}"]) for _ in range(rng.randrange(15))]) for k in range(40)] + [(50, None)]
    df = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    pairs = df.select("id", F.col("t").alias("a")).join(df.select((F.col("id") - 1).alias("id"), F.col("t").alias("b")), "id")
    weights = alignment.idf(df, "t")
    near = lambda found: sorted(tuple(round(x, 7) for x in r) for r in found.collect())
    want = near(alignment.alignment(pairs, "id", "a", "b", alignment.word_vectors(df, "t", contexts=20, size=6), weights))
    counted = alignment.word_rows(df, "t", contexts=20, size=6)
    with monkeypatch.context() as m:  # counts that move in parts
        m.setattr(alignment, "SHORT", 25)
        assert sorted(alignment.word_rows(df, "t", contexts=20, size=6)[0].collect()) == sorted(counted[0].collect())
    assert len(want) == 39 and want != near(alignment.next_alignment(df, "id", "t", weights))
    for few, block in ((1000, 256), (5, 8)):
        assert near(alignment.next_alignment(df, "id", "t", weights, *counted, few=few, block=block)) == want
