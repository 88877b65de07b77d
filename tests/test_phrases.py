"""Phrase lexicons, contained items, turns and batches against brute force."""

import random
from collections import Counter

import pytest

from corpuslab.operators import guards, phrases, select


def brute(rows, lexicon):
    """Every occurrence of every term, word by word."""
    terms = {}
    for term, category in lexicon:
        words = tuple((term or "").lower().split())
        if words and category is not None:
            terms.setdefault(words, set()).add(category)
    longest = max(map(len, terms), default=0)
    out = Counter()
    for k, tokens in rows:
        for at in range(len(tokens or ())):
            for n in range(1, longest + 1):
                words = tuple(tokens[at : at + n])
                if len(words) == n:
                    for c in terms.get(words, ()):
                        out[k, c, " ".join(words), at, n] += 1
    return out


@pytest.mark.parametrize("block", [16 << 20, 4000])
def test_ten_thousand_terms(spark, block):
    """Terms inside, across and next to each other; one category or several; blocks of any size give the same."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["a", "aa", "é", "日本", "x.y"]
    lexicon = [(" ".join(rng.choices(words, k=rng.randrange(1, 5))), f"c{rng.randrange(4)}") for _ in range(10_000)]
    lexicon += [("A  aa", "c9"), ("a aa", "c8"), (" aa ", "c9"), ("", "c1"), (None, "c1"), ("a", None)]
    rows = [(k % 150, [rng.choice(words) for _ in range(rng.randrange(0, 40))]) for k in range(200)] + [(900, None), (901, []), (902, ["a", "aa", "a", "aa"]), (903, ["a\x00aa", "aa\x00"]), (904, [None, "aa"]), (905, ["aaa", "a"])]
    df = spark.createDataFrame(rows, "doc long, t array<string>").repartition(4)
    found = phrases.phrase_hits(df, "doc", "t", spark.createDataFrame(lexicon, "term string, category string"), block)
    got = Counter((r["doc"], r["category"], r["term"], r["at"], r["words"]) for r in found.collect())
    assert got == brute(rows, lexicon)
    assert got[902, "c9", "a aa", 0, 2] == got[902, "c8", "a aa", 2, 2] == 1 and not any(k[0] == 903 for k in got)


def test_flags_and_empty_lexicon(spark):
    df = spark.createDataFrame([(1, ["no", "good", "at", "all"]), (2, ["fine"])], "doc long, t array<string>")
    lexicon = spark.createDataFrame([("no good", "bad"), ("good", "nice"), ("at all", "bad")], "term string, category string")
    profile = phrases.phrase_profile(phrases.phrase_hits(df, "doc", "t", lexicon), "doc")
    assert sorted((r["doc"], r["category"], r["hits"], r["terms"]) for r in profile.collect()) == [(1, "bad", 2, ["at all", "no good"]), (1, "nice", 1, ["good"])]
    flags = phrases.phrase_flags(df, profile, "doc", ["bad", "nice", "none"]).orderBy("doc").collect()
    assert [(r["has_bad"], r["has_nice"], r["has_none"], r["n_categories"]) for r in flags] == [(1, 1, 0, 2), (0, 0, 0, 0)]
    assert phrases.phrase_hits(df, "doc", "t", lexicon.limit(0)).count() == 0


def test_contained(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randrange(0, 60))]) for k in range(60)] + [(77, None), (None, list("abcabc"))]
    items = [(j, [rng.choice("abc") for _ in range(rng.randrange(2, 6))]) for j in range(40)] + [(99, None)]
    a, b = spark.createDataFrame(rows, "doc long, t array<string>"), spark.createDataFrame(items, "item long, u array<string>")
    want = {(j, k) for k, t in rows for j, u in items if k is not None and t and u and len(u) >= 3 and any(t[i : i + len(u)] == u for i in range(len(t)))}
    assert {tuple(r) for r in select.contained(a, "doc", "t", b, "item", "u", 3).collect()} == want and want


def test_turns_and_batches(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 7, "z"), (1, None, None), (2, 1, None), (None, 3, "q")]
    got = {r["c"]: r for r in guards.turn_columns(spark.createDataFrame(rows, "c long, turn int, v string"), "c", "turn", "v", [0, 1]).collect()}
    assert got[1]["turn_0"] == "b" and got[1]["turn_1"] is None and got[1]["more"] == {"7": "z", "null": ""}
    assert got[2]["turn_1"] is None and got[2]["more"] == {} and got[None]["more"] == {"3": "q"}
    texts = [(3, "aaa"), (1, "bb"), (2, "cc"), (4, None), (5, ""), (6, "dddd")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    placed = guards.length_batches(df, "id", "text", 2).orderBy("place").collect()
    assert [(r["id"], r["place"], r["batch"]) for r in placed] == [(6, 0, 0), (3, 1, 0), (1, 2, 1), (2, 3, 1), (5, 4, 2), (4, 5, 2)]
    assert guards.length_batches(df.limit(0), "id", "text", 2).count() == 0
