import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslab.llm.bpe import WordBpe, encode_texts, op7_bpe_digest

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SOURCE)
OWN = WordBpe(SOURCE)


def check(texts, own=OWN):
    ids = own.encode(texts)
    for t, got, decoded in zip(texts, ids, own.decode(ids), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert decoded.decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_chosen_texts():
    check(["", " ", "Hello wOrld's it'llé 12 <|endoftext|> x<|startoftext|>ΑΣ İ ſ", "a b c\x1cd​e \x85f", "日本語 ñ!!?~~ <|end<|endoftext|>", "aaaaaaaaaaaa ''s''ll <|ENDOFTEXT|>", "é ́x", "KK"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from("aeinrst '\n<|>dof")), max_size=60))
def test_any_text(text):
    check([text])


def test_forgetting_words_changes_nothing():
    own = WordBpe(SOURCE, keep=3)
    for _ in range(2):
        check(["some words here", "other words there and more of them"], own)


def test_edges(spark, edge_docs):
    found = encode_texts(edge_docs, PATH)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows[1]["ids"]) == 0 and rows[2]["decoded"] == "" and rows[4]["ids"] == rows[5]["ids"]
    assert np.frombuffer(rows[6]["ids"], "<u4").tolist() == LIBRARY.encode(rows[6]["text"], add_special_tokens=False).ids
    assert encode_texts(edge_docs.limit(0), PATH).count() == 0
    assert encode_texts(spark.createDataFrame([("x", "y")], "text string, ids string"), PATH).columns == ["text", "ids", "decoded"]


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_bpe_digest(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
