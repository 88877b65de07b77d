from collections import Counter

from corpuslab.llm.quality import judge, op6_quality_rules

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ")


def brute(text):
    text = text or ""
    w = [x for x in words(text) if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if any(c not in SPACE for c in x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def check(rows):
    for r in rows:
        got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
        assert got == brute(r["text"])
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = judge(docs).collect()
    check(rows)
    kept = [r["kept"] for r in rows if not r["base_failed"]]
    assert 0.85 < sum(kept) / len(kept) < 1
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    assert all(r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"])


def test_edges(spark, edge_docs):
    rows = judge(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    check(rows)
    assert judge(edge_docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("a b c d e a b c d e a b\nx\nx\n x \x0b\x0c\x85y", None, "k"), ("#*$%&|<> ſé日", "xx", None)], "text string, lang string, kept string")
    check(judge(odd).collect())


def test_query_columns(spark, sf_dir):
    found = op6_quality_rules(spark, sf_dir)
    assert dict(found.dtypes)["n_symbols"] == "bigint" and dict(found.dtypes)["kept"] == "boolean"
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
