import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import lm
from corpuslab.llm.lm import END, op3_lm_score, pair_counts, score_texts, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def brute(rows):
    """(n_tokens, n_known, train_tokens, base) per row of (text, trains)."""
    c = Counter(t for text, trains in rows if trains for t in tokens(text))
    n = sum(c.values())
    for text, _ in rows:
        ts = tokens(text)
        yield len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in ts)


def test_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(op3_lm_score(spark, sf_dir).collect())
    rows = [(t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in docs]
    for r, want, (_, trains) in zip(got, brute(rows), rows, strict=True):
        assert r["held_out"] == (not trains)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm, "OWN", 4)
    monkeypatch.setattr(lm, "SHARED", 5)
    monkeypatch.setattr(lm, "SIZE", 6)


ROWS = [(k, f"the a{k % 5} of b{k % 3} the zz{k} a{k % 4}", k != 3) for k in range(30)]
SCHEMA = "doc_id long, text string, t boolean"


def test_other_words_come_by_the_join(spark, monkeypatch, small):
    """With few words known by heart the result is the same."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    full = sorted(score_texts(df, F.col("t"), keep=["doc_id"]).collect())
    monkeypatch.setattr(lm, "KNOWN_WORDS", 12)
    few = sorted(score_texts(df, F.col("t"), keep=["doc_id"]).collect())
    for a, b in zip(full, few, strict=True):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)


def by_hand(spark, rows):
    """P(token | tokens before) by the definitions, a word and a number at a time."""
    training = [tokens(text) for _, text, trains in rows if trains]
    c = Counter(t.encode() for ts in training for t in ts)
    own = [END, *[w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w != END][: lm.OWN - 1]]
    shared = lambda w: len(own) + zlib.crc32(w[-3:]) % lm.SHARED
    symbol = lambda w: own.index(w) if w in own else shared(w)
    once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    held = Counter()
    for w, n in c.items():
        held[symbol(w)] += n
    tables = [train(p).probabilities() for p in pair_counts(spark.createDataFrame([(t,) for _, t, trains in rows if trains], "text string"), own, lm.SHARED)]

    def p(before, token):
        w, last = token.encode(), [*reversed(before)]
        out = sum(float(t[symbol(last[k].encode()) if k < len(last) else 0, symbol(w)]) for k, t in enumerate(tables)) / len(tables)
        return out if w in own else out * (max(c[w], 1) - d) / max(held[symbol(w)], 1)

    return p, c, held, d, own


def test_scores_by_hand(spark, small):
    rows = [*ROWS, (100, "the new of a1", False), (101, None, False), (102, "q", False)]
    p = by_hand(spark, rows)[0]
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows, SCHEMA), F.col("t")).collect()}
    for k, text, _ in rows:
        ts = tokens(text)
        assert got[k] == pytest.approx(sum(math.log10(p(ts[:i], t)) for i, t in enumerate(ts)), rel=1e-6), k


def test_probabilities_sum_to_one(spark, small):
    """Over the words met, and D / (1 - D) times as many unmet ones of each symbol, after any tokens."""
    p, c, held, d, own = by_hand(spark, ROWS)
    types = Counter(len(own) + zlib.crc32(w[-3:]) % lm.SHARED for w in c if w not in own)
    unmet = {}
    for k in range(5000):
        unmet.setdefault(len(own) + zlib.crc32(f"u{k}".encode()[-3:]) % lm.SHARED, f"u{k}")
    for before in ([], ["the"], ["the", "a1", "never"]):
        met = sum(p(before, w.decode()) for w in c)
        rest = sum(p(before, unmet[s]) / (1 if types[s] else 1 - d) * (types[s] * d / (1 - d) if types[s] else 1) for s in range(len(own), len(own) + lm.SHARED))
        assert met + rest == pytest.approx(1, abs=1e-5)


def test_pairs_and_symbols(spark):
    texts = ["a b a c", "b", "", None, "zza b"]
    found = [*pair_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), [END, b"a", b"b"], 4)]
    symbols = lm.Symbols([END, b"a", b"b"], 4)
    for k, matrix in enumerate(found, 1):
        want = np.zeros((7, 7))
        for t in texts:
            ids = [symbols[w.encode()] for w in tokens(t)]
            for i, s in enumerate(ids):
                want[ids[i - k] if i >= k else 0, s] += 1
        assert np.array_equal(matrix, want)
    words = [(w,) for w in (b"a", b"xy", b"xyz", "ünï".encode(), b"longer")]
    for r in spark.createDataFrame(words, "w binary").select("w", lm.shared_symbol(F.col("w"), 3, 4).alias("s")).collect():
        assert lm.Symbols([END, b"1", b"2"], 4)[bytes(r["w"])] == r["s"]


def test_training_nears_the_counts():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 3, (12, 12)) * rng.integers(0, 400, (12, 12)).astype(float) + 1
    p = train(pairs, size=12, rounds=600, l2=0.0).probabilities()
    want = pairs / pairs.sum(axis=1, keepdims=True)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and np.abs(p - want).mean() < 0.02


def test_edges(spark, edge_docs):
    got = score_texts(edge_docs, F.col("doc_id") != 3)
    assert got.columns[: len(edge_docs.columns)] == edge_docs.columns
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert score_texts(edge_docs.limit(0), F.lit(True)).count() == 0
    none = score_texts(edge_docs.withColumn("score", F.lit("x")), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)
