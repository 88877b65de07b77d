import random
import re
from collections import Counter

import pytest

from corpuslab.llm.divergence import audit, occurrences, op13_source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least=10, top=10):
    """Every share of every kept term, written out."""
    docs = [(lang or "", source or "", TERM.findall(low(text))) for lang, source, text in rows]
    df, counts = {}, {}
    for lang, source, w in docs:
        df.setdefault(lang, Counter()).update(set(w))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(w)
    out = []
    for lang, by in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(c) for s, c in by.items()}
        q = shares(sum(by.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            told = [(f(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", told)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(rng, n):
    vocab = [*"abcdefghij", "été", "ÉTÉ", "straße", "日本", "Łódź", "don't", "x1y", "a_b", "A", "AB", "ab"]
    rows = []
    for _ in range(n):
        weights = [rng.random() ** 3 for _ in vocab]
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None]), rng.choice([" ", "\n", ", ", "-"]).join(rng.choices(vocab, weights, k=rng.randrange(0, 40)))))
    return rows + [("en", "hot", "a A b ab")] * (n // 3) + [("fr", "one", "alone here"), ("fr", "two", None), ("fr", None, ""), ("xx", "only", "b " * 50_000)]


@pytest.mark.parametrize("block, small", [(4 << 20, False), (90, True)])
def test_audit(spark, block, small):
    rows = made(random.Random(3), 200)
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS p").repartition(5)
    more = {"held": 5, "most": 30} if small else {}
    assert got(audit(df, block=block, **more)) == brute(rows)
    assert got(audit(df, least=1, top=2, block=block, **more)) == brute(rows, 1, 2)


def test_recount(spark):
    """Neighbouring terms share a blank, and parts of longer terms are not counted."""
    df = spark.createDataFrame([("en", "s", "aa a aa a a aaa ba"), ("de", "s", "a")], "lang string, source string, text string")
    kept = spark.createDataFrame([("en", "a"), ("en", "aa"), ("de", "aa")], "lang string, term string")
    assert got(occurrences(df, kept)) == [("en", "s", "a", 3), ("en", "s", "aa", 2)]


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert audit(empty).count() == 0
    few = spark.createDataFrame([("en", "a", "one"), ("en", "b", None)], empty.schema)
    assert got(audit(few)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()]
    want = brute(rows)
    assert got(op13_source_divergence(spark, sf_dir)) == want and {r[2] for r in want} == {"pair", "term"}
