import hashlib
import random
import re

from corpuslab.llm.decontaminate import Matcher, contaminated_spans, op4_decontaminate, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        grams = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1):
            if n and tuple(w[p : p + n]) in grams:
                hit.update(range(p, p + n))
                found.add(name)
    return len(w), hit, found


def test_against_brute_force():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "É", "x9"]
    for window in (1, 3, 5):
        for _ in range(200):
            items = [(str(k), " ".join(rng.choices(vocab, k=rng.randrange(0, 9)))) for k in range(5)]
            matcher = Matcher([(k, t.encode()) for k, t in items], window)
            for _ in range(5):
                text = rng.choice([" ", "-", "\n"]).join(rng.choices([*vocab, "zz"], k=rng.randrange(0, 30)))
                n, spans, found = matcher.match(text.encode())
                assert (n, {p for a, b in spans for p in range(a, b)}, {matcher.ids[k] for k in found}) == brute(text, items, window)


def test_blocks_agree_with_one_automaton(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = contaminated_spans(docs, items, 4).collect()
    many = contaminated_spans(docs, items, 4, block_words=200).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(r["hits"] for r in one)


def test_edges(spark, edge_docs):
    items = spark.createDataFrame([(1, "small text of a few words"), (None, "the id of nobody"), (2, None), (3, "..."), (1, "one small")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in contaminated_spans(edge_docs, items).collect()}
    assert rows[1]["n_words"] == 0 and rows[2]["hits"] == [] and rows[4]["items"] == ["1"] and [tuple(h) for h in rows[4]["hits"]] == [(0, 7)]
    assert contaminated_spans(edge_docs.limit(0), items).count() == 0
    assert all(r["hits"] == [] for r in contaminated_spans(edge_docs, items.limit(0)).collect())
    left = {r["doc_id"]: r["text"] for r in remove_spans(edge_docs, items).collect()}
    assert 4 not in left and left[1] is None and left[6] == "lorem ipsum dolor sit amet " * 8000
    longer = spark.createDataFrame([(9, "Keep, Small text of a FEW words! and more of the rest, all of it.", 1)], "doc_id long, text string, hits int")
    assert [tuple(r) for r in remove_spans(longer, items).collect()] == [(9, "Keep, ! and more of the rest, all of it.", 1)]


def test_query(spark, sf_dir):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_decontaminate(spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r["contaminated"] for r in got)
    for r in got:
        n, hit, found = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
