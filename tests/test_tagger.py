"""The tagger against brute force over all tag sequences, and on rows it has not seen."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import tagger

FIRST, LAST = ["Ann", "Bob", "Cleo", "Dan"], ["Reed", "Stone", "Vale"]


def made(rng, n):
    rows = []
    for k in range(n):
        tokens, tags = [], []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                tokens += [rng.choice(["met", "saw", "with"])]
                tags += ["O"]
                name = [rng.choice(FIRST) if rng.random() < 0.7 else f"N{rng.choice('aeiou')}{rng.choice('lmnr')}{k}".rstrip("0123456789") + rng.choice("aeo"), rng.choice(LAST)]
                tokens += name
                tags += ["B", "I"]
            words = ["The", *rng.choices(["river", "runs", "house", "old", "small"], k=3), "end."]
            tokens += words
            tags += ["O"] * 5
        rows.append((k, tokens, tags))
    return rows


def test_tagger(spark):
    rng = random.Random(1)
    schema = "id long, tokens array<string>, tags array<string>"
    train, test = made(rng, 300), made(rng, 100)
    model = tagger.fit(spark.createDataFrame([*train, (998, None, None), (999, ["x"], [])], schema), "tokens", "tags", least=20)
    got = tagger.tagged(spark.createDataFrame([*test, (997, None, None), (996, [], [])], schema).withColumnRenamed("tags", "truth"), "tokens", model).orderBy("id").collect()
    assert {r["id"]: r["tags"] for r in got if r["id"] > 900} == {996: [], 997: None}
    df = spark.createDataFrame([(r["truth"], r["tags"]) for r in got if r["truth"]], "truth array<string>, found array<string>")
    s = tagger.scores(df, "truth", "found").first()
    assert s["precision"] > 0.95 and s["recall"] > 0.95 and s["n"] == sum(t.count("B") for _, _, t in test)
    for r in got[:20]:
        row = [(o["word"], o["shape"]) for o in spark.createDataFrame([(r["tokens"][:5],)], "t array<string>").select(tagger.observed(F.col("t")).alias("o")).first()["o"]]

        def weight(tags, row=row):
            here = lambda w, s, g: model.words[w, g] if w in model.known else model.rare[g] + model.shapes.get((s, g), model.shapes["", g])
            return sum(model.after[a, g] + here(w, s, g) for (w, s), a, g in zip(row, ("", *tags), tags))

        best = max(itertools.product(tagger.TAGS, repeat=len(row)), key=weight)
        assert weight(tuple(tagger.viterbi(model, row))) == pytest.approx(weight(best))


def test_names_and_scores(spark):
    df = spark.createDataFrame([(["a", "Ann", "Reed", "Bob", "x"], ["O", "B", "I", "B", "O"], ["O", "B", "O", "B", "O"]), ([], [], []), (["Cleo"], ["B"], ["O"])], "t array<string>, g array<string>, f array<string>")
    assert [r[0] for r in df.select(tagger.names(F.col("t"), F.col("g"))).collect()] == [["Ann Reed", "Bob"], [], ["Cleo"]]
    s = tagger.scores(df, "g", "f").first()
    assert (s["n"], s["precision"], s["recall"]) == (3, 0.5, 0.333333)
    assert tagger.scores(df.where("size(t) = 0"), "g", "f").first()["precision"] is None


def test_shapes_and_ways_in_batches(spark):
    """Shapes of distinct words are those of the patterns, and rows that go step by step together get the tags that each gets by itself."""
    rng = random.Random(7)
    words = ["Ann", "reed", "\u00c9a", "\u00c9", "NASA", "end.", "End!", "a1", "9", "x,", "\u65e5\u672c", "Ab\u2028", "ab\u0085", "is:\u2029", "", "N\u00e9e", "\u01c5a", "-", None]
    rows = [(k, [rng.choice(words) for _ in range(rng.randrange(9))]) for k in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1)
    want = [[(o["word"], o["shape"]) for o in r["o"]] for r in df.where("t IS NOT NULL").orderBy("id").select(tagger.observed(F.col("t")).alias("o")).collect()]
    row, word, known, look = tagger.looks(pa.array([t for _, t in rows], pa.list_(pa.string())))
    assert [(known[w].as_py(), None if known[w].as_py() is None else tagger.SHAPES[s]) for w, s in zip(word, look)] == [(w, None if w is None else s) for r in want for w, s in r]
    model = tagger.fit(df.withColumn("g", F.transform("t", lambda w, i: F.when(w.rlike("^A"), "B").when(i % 3 == 2, "I").otherwise("O"))), "t", "g", least=40)
    got = {r["id"]: r["tags"] for r in tagger.tagged(df, "t", model).collect()}
    assert got.pop(200) is None and [got[k] for k in range(200)] == [tagger.viterbi(model, r) for r in want]
    assert "rlike" not in tagger.tagged(df, "t", model)._jdf.queryExecution().toString().lower()
