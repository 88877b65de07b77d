import zlib
from collections import Counter

import numpy as np

from corpuslab.llm import sharding
from corpuslab.llm.sharding import communication_matrix, draw_row, op1_shard_shuffle, shuffle_shards


def test_matrix_sums_are_exact():
    for counts, shards in (([5, 0, 17, 3], 4), ([1], 24), ([], 3), ([1000] * 50, 24)):
        m = communication_matrix(counts, shards, 1)
        assert m.sum(axis=1).tolist() == counts
        assert m.min(initial=0) >= 0 and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_rows_of_the_matrix_are_hypergeometric(monkeypatch):
    """Both ways to draw, numpy's and place by place, have the distribution's mean and variance."""
    places, n, draws = np.array([40, 20, 60]), 30, 4000
    for large in (sharding.LARGE, 0):
        monkeypatch.setattr(sharding, "LARGE", large)
        rng = np.random.default_rng(3)
        x = np.array([draw_row(rng, places, n) for _ in range(draws)])
        share = places / places.sum()
        variance = n * share * (1 - share) * (places.sum() - n) / (places.sum() - 1)
        assert (x.sum(axis=1) == n).all() and (x <= places).all()
        assert np.allclose(x.mean(axis=0), n * share, atol=0.2) and np.allclose(x.var(axis=0), variance, rtol=0.15)


def check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_places_are_uniform(spark):
    df = spark.range(4000)
    rows = shuffle_shards(df, 4, rows_per_part=300).collect()  # several cells a shard
    check(rows, 4)
    place = np.array([r["shard"] * 1000 + r["slot"] for r in sorted(rows, key=lambda r: r["id"])])
    assert abs(np.corrcoef(np.arange(4000), place)[0, 1]) < 0.06
    thirds = np.histogram2d(np.arange(4000), place, bins=4)[0]
    assert ((thirds - 250) ** 2 / 250).sum() < 40
    again = shuffle_shards(df, 4, seed=8, rows_per_part=300).collect()
    assert [r["slot"] for r in sorted(again, key=lambda r: r["id"])] != [r["slot"] for r in sorted(rows, key=lambda r: r["id"])]


def test_edges(spark, edge_docs):
    found = shuffle_shards(edge_docs, 3)
    assert found.columns == [*edge_docs.columns, "shard", "slot"]
    rows = found.collect()
    check(rows, 3)
    assert sorted(str(r["text"])[:9] for r in rows) == sorted(str(r["text"])[:9] for r in edge_docs.collect())
    assert shuffle_shards(edge_docs.limit(0), 3).count() == 0
    hot = spark.range(3000).selectExpr("1 AS doc_id", "'same' AS text", "7 AS shard", "'x' AS uid", "2 AS part")
    rows = shuffle_shards(hot, 24).collect()
    check(rows, 24)
    assert len(rows) == 3000 and rows[0]["uid"] == "x"


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_shard_shuffle(spark, sf_dir).collect()
    check(rows, 24)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
