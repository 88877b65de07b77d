from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuslab.llm.quality import judge
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import least, shingles
from tests.llm.test_secrets import brute as found_secrets

DIR = "/root/testdata/sf0.01"


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = corpus_pipeline.quality(spark, docs, DIR)
    assert one.columns == docs.columns
    assert sorted(rows(one)) == sorted(r["doc_id"] for r in judge(docs).where("kept").collect())

    texts = sorted(rows(one).items())
    sets = [shingles(t, 5) for _, t in texts]
    root = least(len(sets), [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    two = corpus_pipeline.near_copies(spark, one, DIR)
    assert sorted(rows(two)) == [texts[k][0] for k in sorted(set(root))] and two.columns == docs.columns and len(set(root)) < len(root)

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, three = rows(two), corpus_pipeline.decontaminate(spark, two, DIR)
    after = rows(three)
    for k, t in before.items():
        n, hit, _ = hits(t, items)
        assert (k in after) == (len(hit) <= 0.5 * n)
        if k in after:
            assert (after[k] == t) == (not hit) and not hits(after[k], items)[1]
    assert any(after.get(k) != t for k, t in before.items()) and three.columns == docs.columns

    four = corpus_pipeline.secrets(spark, three, DIR)
    masked = rows(four)
    assert set(masked) == set(after) and any(found_secrets(t) for t in after.values())
    for k, t in after.items():
        assert bool(found_secrets(t)) == (masked[k] != t) and not found_secrets(masked[k])
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.tokens(spark, four, DIR).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(masked[r["doc_id"]], add_special_tokens=False).ids


def test_edges(spark, edge_docs):
    docs = edge_docs.drop("row")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_copies(spark, docs, DIR).collect()) == [0, 1, 2, 3, 4, 6]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
        assert stage(spark, docs, DIR).count() <= docs.count()
