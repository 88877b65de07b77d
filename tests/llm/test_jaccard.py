import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import jaccard
from corpuslab.llm.jaccard import components, jaccard_components, linked, merge, op9_jaccard_join, shingle_sets, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def least(n, edges):
    root = list(range(n))
    for a, b in edges:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def brute(sets, percent):
    return least(len(sets), [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])


def made(rng, n):
    """Texts with near copies around the threshold, shared passages and very short ones."""
    vocab = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocab, k=40)
    out = []
    while len(out) < n:
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 200, 700]))
        if rng.random() < 0.4:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = rng.choices(vocab, k=rng.randrange(0, 2))
            out.append(rng.choice([" ", "\n", " \t"]).join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return out[:n]


def test_merge_and_search():
    rng = random.Random(2)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 20)))) for _ in range(rng.randrange(0, 9))]
        for t in (1, 2, 4):
            counts = {d: sum(d in x for x in map(set, lists)) for d in range(30)}
            assert merge(lists, t) == sorted((d, c) for d, c in counts.items() if c >= t)
    texts = made(rng, 250)
    for width, percent in ((4, 85), (5, 80), (1, 50)):
        sets = [shingles(t, width) for t in texts]
        own = shingle_sets([t.encode() for t in texts], width)
        assert [len(s) for s in own] == [len(s) for s in sets]
        assert linked(own, percent) == brute(sets, percent)


def test_every_link_shares_a_signature():
    rng = random.Random(4)
    for n in (1, 2, 5, 7, 13, 40, 99, 400, 2500):
        for _ in range(40):
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(a)
            while True:
                c = set(b)
                c.discard(rng.choice(sorted(c))) if rng.random() < 0.5 else c.add(rng.getrandbits(64))
                if not c or 100 * len(a & c) < 85 * len(a | c):
                    break
                b = c
            x, y = (set(signatures(np.array(sorted(s), np.uint64), 85).tolist()) for s in (a, b))
            assert x & y


@pytest.mark.parametrize("slice_bytes", [16 << 20, 3000])
def test_documents(spark, slice_bytes):
    rng = random.Random(9)
    texts = made(rng, 400)
    texts += [texts[0]] * 30 + ["", None, " \n ", "one two", "ONE two", "one two three"]
    want = brute([shingles(t, 4) for t in texts], 85)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    rows = jaccard_components(df, 4, 85, slice_bytes=slice_bytes).collect()
    groups, expected = {}, {}
    for r in rows:
        assert r["n_shingles"] == len(shingles(r["text"], 4)) and r["key"] == "x"
        if r["component"] is None:
            assert r["n_shingles"] == 0
        groups.setdefault(r["component"] or ("own", r["doc_id"]), set()).add(r["doc_id"])
        expected.setdefault(want[r["doc_id"]], set()).add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    want = least(150, edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: want[k] for e in edges if e[0] != e[1] for k in e}


def test_edges(spark, edge_docs):
    got = jaccard_components(edge_docs)
    assert got.columns == [*edge_docs.columns, "n_shingles", "component"] and got.count() == edge_docs.count()
    rows = got.collect()
    assert len({r["component"] for r in rows if r["doc_id"] in (4, 5)}) == 1 and all(r["component"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    assert jaccard_components(edge_docs.limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    sets = [shingles(t, 4) for _, t in docs]
    want = brute(sets, 85)
    got = sorted(op9_jaccard_join(spark, sf_dir).collect())
    assert [tuple(r) for r in got] == [(i, len(s), docs[w][0]) for (i, _), s, w in zip(docs, sets, want, strict=True)]
    assert len(set(want)) < len(want)


def test_large_blocks_lose_no_links(spark):
    """Texts that share passages: what leaves a block has no link, and rare shingles join all that have."""
    from corpuslab.llm.jaccard import can_be_linked, rare_edges

    texts = sorted(set(made(random.Random(6), 300)))
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string").repartition(6)
    left = {r["node"] for r in can_be_linked(df.unionByName(df.limit(50)), 5, 80).collect()}
    assert {k for e in links for k in e} <= left < set(range(len(texts)))
    edges = [(r["a"], r["b"]) for r in rare_edges(df, 5, 80).collect()]
    root = least(len(texts), edges)
    assert links and all(root[i] == root[j] for i, j in links)


def test_a_familys_pairs_become_a_forest():
    """All pairs of 300 nodes, and one more pair: what leaves the task has an edge fewer than nodes for each component."""
    pairs = [(max(x, y), min(x, y)) for x in range(300) for y in range(x)] + [(1001, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs]), pa.array([v for _, v in pairs])], names=["u", "v"])
    got = [e for b in jaccard.spanning(iter([batch])) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
    assert len(got) == 300 and {frozenset(e) for e in got} >= {frozenset((1000, 1001))}
    assert [*jaccard.spanning(iter([]))] == []
