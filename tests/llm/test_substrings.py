import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.substrings import PASSAGE, _keyed, op8_remove_repeats, pieces, remove_repeats, sliding_min


def brute(texts, length, passage):
    passages = Counter(t[i : i + passage] for t in texts for i in range(len(t) - passage + 1))
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        held = bytearray(len(t))
        for i in range(len(t) - passage + 1):
            if passages[t[i : i + passage]] > 1:
                held[i : i + passage] = b"\1" * passage
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), spans, sum(held)))
    return out


def test_sliding_min_and_pieces():
    rng = np.random.default_rng(1)
    for n in (5, 17, 60):
        x = rng.integers(0, 9, n).astype(np.uint64)
        assert sliding_min(x, 5).tolist() == [min(x[i : i + 5]) for i in range(n - 4)]
    text = bytes(rng.integers(97, 100, 900).astype(np.uint8))
    found = pieces(text, 100)
    assert [s for _, _, a, z in found for s in range(a, z + 1)] == list(range(801))
    anchor = {text[s : s + 100]: p - s for _, p, a, z in found for s in range(a, z + 1)}
    assert all(anchor[text[s : s + 100]] == p - s for _, p, a, z in found for s in range(a, z + 1))


def made(rng):
    letters = "abcdeé \n"
    word = lambda n: "".join(rng.choices(letters, k=n))
    passages = [word(rng.randrange(60, 400)) for _ in range(4)]
    texts = ["", None, "a" * 300, "ab" * 150, word(99), word(100)]
    for _ in range(60):
        parts = [word(rng.randrange(0, 300)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 80)
            parts.insert(rng.randrange(4), p[a : a + rng.randrange(60, 400)])
        texts.append("".join(parts))
    texts += [texts[9]] * 5 + [texts[10][:150] + "X" + texts[10][151:], texts[11][7:]]
    head = word(180)
    return texts + [head + word(40) for _ in range(40)]


@pytest.mark.parametrize(("crowd", "passage"), [(8192, 100), (8192, 70), (3, 64), (3, 80), (3, 100)])
def test_made_texts(spark, crowd, passage):
    for seed in (1, 2):
        texts = made(random.Random(seed))
        df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(4)
        want = brute([(t or "").encode() for t in texts], 100, passage)
        got = remove_repeats(df, 100, passage=passage, crowd=crowd)
        assert got.columns == ["doc_id", "text", "kept", "n_removed", "n_spans", "n_repeated"]
        rows = got.collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (bytes(r["kept"]), r["n_removed"], r["n_spans"], r["n_repeated"]) == want[r["doc_id"]], r["doc_id"]


def planted(rng):
    """Texts of their own, three of which hold a passage of 380 bytes, three one of 900; the first is there 70 times."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short, long = prose(200)[:380], prose(300)[:900]
    texts = [prose(300) for _ in range(40)]
    for k in (3, 4, 5):
        texts[k] = texts[k][:500] + short + texts[k][500:]
    for k in (6, 7, 8):
        texts[k] = texts[k][:500] + long + texts[k][500:]
    return [texts[0]] * 70 + texts[1:]


def test_passages_under_and_over_the_length(spark):
    texts = planted(random.Random(5))
    got = {r["i"]: r for r in remove_repeats(spark.createDataFrame([*enumerate(texts)], "i long, text string").repartition(70)).collect()}
    for i, t in enumerate(texts):
        k = max(0, i - 69)  # as planted
        n = len(t) if k == 0 else 900 if k in (6, 7, 8) else 380 if k in (3, 4, 5) else 0
        near = range(n, n + 9)  # what follows or precedes may agree by chance
        assert got[i]["n_repeated"] in near and got[i]["n_removed"] in (near if n >= 400 else (0,)), k


def test_a_text_in_very_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 20)
    texts = planted(random.Random(6))
    df = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "i long, text string").repartition(60)
    want = sorted((k % 50, len(b), g, s, h) for k, (t, (b, g, s, h)) in enumerate(zip(texts, brute([t.encode() for t in texts], 400, PASSAGE), strict=True)))
    got = remove_repeats(df).select("i", F.octet_length("kept"), "n_removed", "n_spans", "n_repeated")
    assert sorted(map(tuple, got.collect())) == want
    keyed = _keyed(df, "text")
    assert keyed.where("again = 1").count() <= 3 < 70  # alike in all columns
    assert keyed.select("key").distinct().count() == len(set(texts))


def test_edges(spark, edge_docs):
    got = remove_repeats(edge_docs, 400)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == edge_docs.count() and rows[1]["n_removed"] == 0 and rows[6]["kept"] == b"" and rows[6]["n_spans"] == 1
    assert remove_repeats(edge_docs.limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = brute([t for _, t in docs], 400, PASSAGE)
    got = sorted(op8_remove_repeats(spark, sf_dir).collect())
    for (i, t), (left, gone, spans, held), r in zip(docs, want, got, strict=True):
        assert tuple(r) == (i, len(t), gone, spans, hashlib.sha256(left).hexdigest(), held)
    assert sum(w[1] for w in want) > 0
