"""Hand-computed rows for parsing, agreement, rules and gates."""

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import agreement, classify, parse, sentiment
from corpuslab.functions.stem import porter, stems
from corpuslab.operators import aggregates as A
from corpuslab.operators import gates


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"x{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


C = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """The tests' column; columns need a session."""
    global C  # noqa: PLW0603
    C = F.col("c")


def test_lists_and_votes(spark):
    assert values(spark, ["""['u' 'really' "don't"]""", "", None, "['a' ' ']"], parse.quoted_items(C), parse.quoted_items(C, True)) == [(["u", "really", "don't"],) * 2, ([], []), ([], []), (["a", " "], ["a"])]
    assert values(spark, ["{'label': array([0, 2, 2]), 'x': 1}", "'label': [1,1,1]", "", None], parse.vote_list(C)) == [([0, 2, 2],), ([1, 1, 1],), ([],), ([],)]
    assert values(spark, ["['None']", "['GROUPA', 'GROUPB']", None, "plain"], parse.known_targets(C), parse.list_literal(C, True)) == [([], ["None"]), (["GROUPA", "GROUPB"],) * 2, ([], []), ([], ["plain"])]


def test_votes(spark):
    rows = [(0, [1, 1, 1]), (1, [0, 2, 2]), (2, [0, 1, 2]), (3, [])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    v = F.col("v")
    got = df.select("i", agreement.majority(v), agreement.majority(v, "none"), agreement.agreement(v), agreement.agreement_bucket(v), agreement.is_borderline(v)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, "unanimous", "perfect", False), (2, 2, "majority", "minority", False), (0, -1, "split", "minority", False), (None, None, None, "minority", False)]


def test_texts(spark):
    assert values(spark, ["A  b!", "a b", None], parse.leakage_key(C)) == [("a b",), ("a b",), (None,)]
    assert values(spark, ["The (cat), sat... ", None, " ' "], parse.tokens(C)) == [(["the", "cat", "sat"],), ([],), ([],)]
    assert values(spark, ['**Final Sentence:** "x y"', "Final Sentence:\n\n  z", '"whole"', None], parse.final_sentence(C)) == [("x y",), ("z",), ("whole",), ("",)]
    assert values(spark, ["```json\n{}\n```", "{}"], parse.without_fence(C)) == [("{}",), ("{}",)]
    assert values(spark, ["hi \U0001f600  there"], parse.without_emoji(C)) == [("hi there",)]
    assert values(spark, ["i know", "no"], classify.has_negation(C), classify.has_negation_word(parse.tokens(C))) == [(True, False), (True, True)]
    assert values(spark, ["all of them are", "nothing here"], classify.frames(parse.tokens(C), F.lower(C))) == [(["GENERALIZATION"],), (["NONE_DETECTED"],)]
    assert values(spark, ["Asian women", "xyz"], parse.canonical_group(C)) == [("asian",), ("OTHER",)]
    assert values(spark, ["[TARGET] x", "[OTHER_1]"], parse.has_other_tag(C)) == [(False,), (True,)]
    assert values(spark, ["ab cd"], parse.compound_split(parse.tokens(C), {"ab": ("a", "b")})) == [(["ab", "a", "b", "cd"],)]


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control", "sky": "sky"}
    assert {w: porter(w) for w in known} == known
    assert values(spark, ["cats sat"], stems(parse.tokens(C))) == [(["cats", "cat", "sat"],)]


def test_sentiment(spark):
    (a,), (b,), (c,) = values(spark, ["good", "not good", "nothing"], sentiment.raw_score(parse.tokens(C)))
    assert (a, round(b, 6), c) == (1.9, round(-0.74 * 1.9, 6), 0.0)


def test_gates(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (4, 1), (4, 0)], "b int, a int")
    assert [r[0] for r in df.select(gates.emotion_drop(F.col("b"), F.col("a"))).collect()] == [False, True, False, True]
    assert values(spark, ["a clown fish", "a clown", "you idiot"], gates.explicit_cues(C)) == [([],), (["clown"],), (["idiot"],)]
    assert values(spark, ["I'm sorry, but", None], gates.refusal(C)) == [(True,), (False,)]
    assert values(spark, ["x"], gates.verdict([("HARD:a", C == "x"), ("SOFT:b", C == "x"), ("SOFT:c", C == "y")]), gates.verdict([("HARD:a", C == "y")])) == [("HARD:a | SOFT:b", "PASS")]


def test_frames_as_written(spark):
    """Words are whole tokens and patterns keep to words' bounds; the order of the table decides the first frame."""
    want = {
        "small carpets are nice": ["NONE_DETECTED"],
        "all of them are nice": ["GENERALIZATION"],
        "every cat is a rat": ["DEHUMANIZATION", "GENERALIZATION"],
        "allow that they do": ["NONE_DETECTED"],
        "they don't belong, deport": ["EXCLUSION"],
        "the deportation office": ["NONE_DETECTED"],
        "sharia threat": ["CRIMINAL_DANGER", "RELIGIOUS"],
        "breeding plot": ["CONSPIRACY", "SEXUAL_GENDERED"],
        "all " + "x" * 40 + " are": ["NONE_DETECTED"],
    }
    df = spark.createDataFrame([(t,) for t in want], "low string")
    got = {r["low"]: r["f"] for r in df.select("low", classify.frames(parse.tokens(F.col("low")), F.col("low")).alias("f")).collect()}
    assert got == want
    sets = {r["low"]: r["f"] for r in df.select("low", classify.frames_by_sets(parse.tokens(F.col("low")), F.col("low")).alias("f")).collect()}
    assert sets["every cat is a rat"] == ["DEHUMANIZATION", "GENERALIZATION"] and sets["the deportation office"] == ["EXCLUSION"] and sets["allow that they do"] == ["NONE_DETECTED"]


def test_acts_as_written(spark):
    rows = [("i hate this", "SHORT_LABEL+HATE_DECLARATION", "SHORT_LABEL"), ("stop it now", "IMPERATIVE+SHORT_LABEL", "IMPERATIVE"), ("she told me and said that we hate all", "NARRATIVE+HATE_DECLARATION", "GROUP_STATEMENT")]
    df = spark.createDataFrame(rows, "low string, many string, first string")
    t = parse.tokens(F.col("low"))
    for r in df.select("*", F.array_join(classify.speech_acts(t, F.col("low")), "+").alias("a"), classify.speech_act(t, F.col("low")).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["many"], r["first"])


def test_distances_and_neighbours(spark):
    rows = [(["a", "x", "x", "b"], 3), (["a", "b", "a"], 1), (["c"], 0), (["a"], None), ([], None), (None, None), (["b", "x", "a", "x", "x", "b"], 2)]
    df = spark.createDataFrame(rows, "t array<string>, d int")
    assert all(r["found"] == r["d"] for r in df.select("d", A.least_distance(F.col("t"), ("a", "c"), ("b", "c")).alias("found")).collect())
    two = spark.createDataFrame([(["the", "and", "cat", "is", "the", "dogs"],), (["the"],), ([],)], "t array<string>")
    assert [r[0] for r in two.select(A.bigrams(F.col("t"), ("the", "and"))).collect()] == [["and cat", "cat the", "the dogs"], [], []]


def test_replies_are_trimmed_without_btrim(spark):
    """btrim makes two arrays of the whole text's length; a text of blank lines must not recurse either."""
    texts = ["* Final Sentence : **\t* \n \n*\t'x \"y' *\"* \nmore", "Note\n#- FINAL  transformed\nSentence** :\n\n", "' \"a *\" ", "a\nfinal sentence:'", "\n" * 5000 + "Final Sentence:" + "\n *" * 5000 + "x", "final sentence:\r\nz", ""]
    assert values(spark, texts, parse.final_sentence(C)) == [("x \"y' *",), ("",), ("a *",), ("",), ("x",), ("\r",), ("",)]
    plan = spark.createDataFrame([("x",)], "c string").select(parse.final_sentence(C))._jdf.queryExecution().optimizedPlan().toString()
    assert "Some(" not in plan  # a trim with characters of its own
