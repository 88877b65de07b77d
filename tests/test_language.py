"""Sentiment, base forms, alignment, ablation: by hand and by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import sentiment
from corpuslab.operators import alignment, guards, vectors
from corpuslab.sources import readers

GOOD = {"good": 1.9, "bad": -2.5, "fun": 2.3}


def compound(x):
    return x / math.sqrt(x * x + 15)


@pytest.mark.parametrize(
    "text, score",
    [
        ("It is good.", 1.9), ("It is GOOD", 1.9 + 0.733), ("IT IS GOOD", 1.9), ("very good", 1.9 + 0.293), ("VERY good", 1.9 + 0.293 + 0.733), ("very is good", 1.9 + 0.293 * 0.95), ("slightly bad", -2.5 + 0.293), ("not good", 1.9 * -0.74),
        ("not really good", (1.9 + 0.293) * -0.74), ("good good", 3.8), ("good but bad", 1.9 * 0.5 - 2.5 * 1.5), ("good!!", 1.9 + 2 * 0.292), ("bad!!!!!!", -2.5 - 4 * 0.292), ("good??", 1.9 + 0.36), ("good?????", 1.9 + 0.96), ("plain words!", 0.0), ("not x y z good", 1.9),
    ],
)
def test_fold(text, score):
    neg, neu, pos, whole = sentiment.fold(text, GOOD)
    assert whole == pytest.approx(compound(score)) and neg + neu + pos == pytest.approx(1.0)


def test_shares_from_a_file(spark, tmp_path):
    assert sentiment.fold("good and bad day", GOOD)[:3] == pytest.approx((3.5 / 8.4, 2 / 8.4, 2.9 / 8.4))
    (tmp_path / "valences.txt").write_text("good\t1.9\tmore\nBad\t-2.5\nbroken\nodd\tx\n")
    known = readers.valences(spark, str(tmp_path / "valences.txt"))
    assert known == {"good": 1.9, "bad": -2.5}
    df = spark.createDataFrame([("good",), (None,), (" ",), ("?!",)], "t string")
    got = [tuple(r["s"]) for r in df.select(sentiment.shares(F.col("t"), known).alias("s")).collect()]
    assert got[0][3] == pytest.approx(compound(1.9)) and got[1:] == [(0.0, 0.0, 0.0, 0.0)] * 3
    with pytest.raises(ValueError):
        readers.valences(spark, str(tmp_path / "valences.txt"), 1)


def test_base_forms(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "glasses", "wolves", "boxes", "women", "flies", "running", "baked", "tried", "bigger", "nicest", "geese", "was", "s", "unknowns", "cat", None, "cats"]], "word string")
    vocabulary = ["cat", "glass", "glasse", "wolf", "box", "woman", "fly", "run", "bake", "try", "big", "nice", "goose", "be", "wa"]
    exceptions = spark.createDataFrame([("geese", "n", "goose"), ("running", "v", "run"), ("tried", "v", "try"), ("was", "v", "be"), ("bigger", "a", "big"), ("x", None, "y")], "word string, pos string, lemma string")
    got = {r["word"]: (r["n"], r["v"], r["a"]) for r in guards.base_forms(words, spark.createDataFrame([(w,) for w in vocabulary], "word string"), exceptions).collect()}
    want = {"cats": ("cat", "cat", "cats"), "glasses": ("glass", "glass", "glasses"), "wolves": ("wolf", "wolves", "wolves"), "boxes": ("box", "box", "boxes"), "women": ("woman", "women", "women"), "flies": ("fly", "fly", "flies"), "running": ("running", "run", "running"), "baked": ("baked", "bake", "baked"), "tried": ("tried", "try", "tried")}
    want |= {"bigger": ("bigger", "bigger", "big"), "nicest": ("nicest", "nicest", "nice"), "geese": ("goose", "geese", "geese"), "was": ("wa", "be", "was"), "s": ("s", "s", "s"), "unknowns": ("unknowns",) * 3, "cat": ("cat",) * 3}
    assert got == want
    by_pos = spark.createDataFrame([("cat", "n")], "word string, pos string")
    assert {r["word"]: r["v"] for r in guards.base_forms(words, by_pos).collect()}["cats"] == "cats"


def test_alignment_by_hand(spark):
    vectors_ = spark.createDataFrame([("dog", [1.0, 0.0]), ("hound", [0.8, 0.6]), ("tax", [-1.0, 0.0])], "word string, x array<double>")
    weights = spark.createDataFrame([("dog", 2.0), ("hound", 3.0), ("the", 0.5)], "word string, idf double")
    rows = [(1, ["the", "dog"], ["the", "dog"]), (2, ["the", "dog", "dog"], ["hound"]), (3, ["dog"], ["tax"]), (4, [], None), (5, [], ["dog"]), (6, ["new"], ["new", "odd"])]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    got = {r["id"]: (r["precision"], r["recall"], r["f"]) for r in alignment.alignment(df, "id", "a", "b", vectors_, weights).collect()}
    assert got[1] == (1.0, 1.0, 1.0) and got[3] == (0.0, 0.0, 0.0) and got[4] == (1.0, 1.0, 1.0) and got[5] == (0.0, 0.0, 0.0)
    recall = 4 * 0.8 / 4.5
    assert got[2] == pytest.approx((0.8, recall, 2 * 0.8 * recall / (0.8 + recall))) and got[6] == pytest.approx((0.5, 1.0, 2 / 3))


def test_synonyms_are_nearer_than_other_words(spark):
    rng = random.Random(3)
    subjects = {"pets": ["dog", "hound", "bone", "bark", "leash"], "money": ["tax", "bank", "coin", "loan", "debt"]}
    rows = [(k, [rng.choice(["the", "a", "of"]) if rng.random() < 0.4 else rng.choice(subjects[s]) for _ in range(12)]) for k in range(200) for s in [rng.choice([*subjects])]]
    df = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    found = {r["word"]: np.array(r["x"]) for r in alignment.word_vectors(df, "t", contexts=8, size=4).collect()}
    assert found["dog"] @ found["hound"] > 0.9 > 0.3 > found["dog"] @ found["tax"]
    near = {(r["word"], r["token"]): r["weight"] for r in alignment.co_occurrences(spark.createDataFrame([(["x", "y", "x"],), ([],), (["x"],)], "t array<string>"), "t", spark.createDataFrame([("x",)], "token string")).collect()}
    assert near == {("y", "x"): 2.0, ("x", "x"): 1.0}


def test_ablation(spark):
    rng = np.random.default_rng(4)
    states, v, w = rng.standard_normal((60, 3, 2)), np.array([0.6, 0.8]), np.array([1.0, 0.5])
    y = (states.mean(axis=(1, 2)) + rng.standard_normal(60) * 0.3 > 0.2).astype(int)
    df = spark.createDataFrame([(s.tolist(), int(t)) for s, t in zip(states, y, strict=True)] + [([], 1), (None, 0)], "s array<array<double>>, y int")
    one = spark.createDataFrame([("v", v.tolist(), w.tolist(), -0.4)], "vector string, v array<double>, w array<double>, bias double")
    place = np.array([1, 2, 3]) / 6

    def counts(alpha, share):
        p = (np.einsum("ntd,t->nd", states, place) @ w - 0.4 + alpha * share * (v @ w)) > 0
        f = lambda a, b, c: 2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0
        tp, fp, fn, tn = (int(((y == t) & (p == q)).sum()) for t, q in ((1, True), (0, True), (1, False), (0, False)))
        return (f(tp, fp, fn) + f(tn, fn, fp)) / 2, p

    alphas = (0.2, 0.5, 1.0, 3.0)
    best = max(alphas, key=lambda a: (round(counts(a, 0.5)[0], 6), -a))
    base, p0 = counts(0, 0)
    got = {r["setting"]: r for r in vectors.ablation(df, one, alphas, "y", "s", 2).collect()}
    for name, factor, mode in vectors.SETTINGS:
        f, p = counts(best * factor, {"last": 0.5, "first": 1 / 6, "all": 1.0}[mode])
        missed = (y == 1) & ~p0
        assert got[name]["alpha"] == best and got[name]["macro_f1"] == round(f, 6) and got[name]["d_f1"] == pytest.approx(f - base, abs=1e-6)
        assert got[name]["fn_rec"] == pytest.approx((p & missed).sum() / missed.sum(), abs=1e-6)


def test_fold_adds_in_order_and_splits_as_sql():
    sides = {"a": 0.1, "b": 0.2, "c": 0.3, "n": -2.6}
    total = 0.0
    for v in (1.1, 1.2, 1.3):
        total += v
    assert total < 3.6  # so the negative side prevails by its rounding, as in SQL, and takes the mark
    neg, _, pos, _ = sentiment.fold("a b c n!", sides)
    assert neg == pytest.approx((3.6 + 0.292) / 7.492) and pos == pytest.approx(3.6 / 7.492)
    assert sentiment.fold("good day good", GOOD)[1] == pytest.approx(1 / 3.9)  # a no-break space parts no words
