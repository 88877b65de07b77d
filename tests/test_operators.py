"""Selection, aggregation, statistics, vectors, generation, sources and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import parse
from corpuslab.operators import aggregates, generate, guards, ml, order, select, stats, vectors
from corpuslab.sources import readers, sinks
from corpuslab.streaming.resume import run_items, windowed_counts


def test_reason_order_and_funnel(spark):
    df = spark.createDataFrame([(1, "bad", 5), (2, "ok", 9), (3, "ok", 10), (4, "ok", 60), (5, "ok", 61), (6, None, 20)], "id int, label string, n int")
    checks = [("label", F.col("label") != "ok"), ("token_len", ~F.col("n").between(10, 60))]
    got = {r["id"]: r["r"] for r in df.select("id", select.first_reason(checks).alias("r")).collect()}
    assert got == {1: "label", 2: "token_len", 3: "ok", 4: "ok", 5: "token_len", 6: "label"}
    f = [tuple(r) for r in select.funnel(df, checks).orderBy("step").collect()]
    assert f == [(0, "input", 6, 0), (1, "label", 4, 2), (2, "token_len", 2, 2)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"))
    one, many = (sorted(r["id"] for r in select.sample_per_group(df.repartition(n), ["g"], "id", 25).collect()) for n in (1, 13))
    assert one == many and len(one) == 50
    parts = select.split(df, ["g"], "id", 0.2).groupBy("g", "part").count().collect()
    assert {(r["g"], r["part"]): r["count"] for r in parts}["cold", "test"] == 333


def test_priority_cap_has_no_refill(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "b")], "id int, target string")
    got = select.priority_cap(e, "id", "target", F.lit(0), [("a", 5), ("b", 5)]).collect()
    assert sorted((r["id"], r["target"]) for r in got) == [(1, "a"), (2, "b"), (3, "b")]


def test_quartiles_and_crosstab(spark):
    df = spark.createDataFrame([(x, "k") for x in range(1, 6)], "v int, g string")
    assert tuple(aggregates.rank_quartiles(df, "v", "g").first()) == ("k", 5, 2, 3, 4)
    assert tuple(aggregates.crosstab(df.withColumn("c", F.lit("x")), "g", "c", ["x", "y"]).first()) == ("k", 5, 0)
    assert aggregates.rates(df.limit(0), {"a": F.col("v") > 1}).first()["pct_a"] is None


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 0), (1, 1, 1), (0, 0, 0)], "y int, p int, q int")
    m = stats.metrics(stats.confusion(df, F.col("y"), F.col("p"))).first()
    assert m["macro_f1"] == 1.0 and stats.mcnemar(df, F.col("y"), F.col("p"), F.col("q")).first()["p_value"] == 1.0
    assert stats.metrics(stats.confusion(df.limit(0), F.col("y"), F.col("p"))).first()["f1"] == 0.0
    known = spark.createDataFrame([(113, 176)], "b int, c int").select(stats.mcnemar_p("b", "c").alias("p")).first()["p"]
    assert abs(known - 2.5e-4) < 2e-5  # a published figure
    ranks = {r["v"]: r["rank"] for r in order.mid_ranks(spark.createDataFrame([(5,), (7,), (7,), (9,)], "v int"), "v").collect()}
    assert ranks == {5: 1.0, 7: 2.5, 9: 4.0}


def test_vectors(spark):
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in zero.select(vectors.unit(F.col("v"))).collect()]
    assert got[0] == [0.0, 0.0] and abs(got[1][0] - 0.6) < 1e-6
    grid = spark.createDataFrame([("v", 1, 0.5), ("v", 1, 1.0)], "vector string, layer int, alpha double")
    assert vectors.remaining(grid, grid.limit(1)).count() == 1 and vectors.remaining(grid, grid).count() == 0
    top = spark.createDataFrame([("v", 0, 0.25)], "vector string, layer int, alpha double")
    points = {(r["layer"], r["alpha"]) for r in vectors.fine_grid(top, 0, 9).collect()}
    assert points == {(k, a) for k in (0, 1, 2) for a in (0.25, 0.5, 0.75, -0.25)}


def test_generation(spark):
    df = spark.createDataFrame([(1, "say hello there"), (2, None), (3, "please refuse"), (4, "one")], "id int, text string")
    rows = {r["id"]: r for r in generate.run_turns(df, generate.echo, [("a", "{input}"), ("b", "{a} {missing}x")]).collect()}
    assert rows[1]["status"] == "ok" and rows[1]["turns"]["turn_1"] == "hello there" and rows[1]["reply"] == "there {missing}x"
    assert (rows[2]["status"], rows[3]["status"], rows[4]["status"]) == ("skipped", "refused", "empty") and rows[4]["attempts"] == 2
    back = generate.run_turns(df.where("id = 3"), generate.echo, [("a", "{input}")], fallback=str.upper).first()
    assert (back["status"], back["reply"]) == ("fallback", "PLEASE REFUSE")
    wide = generate.turns_wide(generate.run_turns(df, generate.echo, [("a", "{input}")]), ["a", "zz"])
    assert {"a", "zz"} <= set(wide.columns)
    parsed = spark.createDataFrame([('```json\n{"k": "value"}\n```',), ("{}",)], "c string").select(generate.parsed_reply(F.col("c"), "k string").alias("p")).collect()
    assert parsed[0]["p"]["k"] == "value" and parsed[1]["p"] is None


def test_chains(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "I cannot do that."), (3, "a", None), (4, "refuse", "b"), (5, None, "b")], "flag int, first string, second string")
    keys = [("one", "A {first} {second}"), ("two", "B {one}x"), ("three", "refuse {two}")]
    got = [(r["first"], r["second"], r["result"], r["flag"], len(r["turns"])) for r in generate.pair_chain(df, generate.echo, keys, "first", "second").collect()]
    assert got == [("a", "b", "a bx", "", 3), (None, "I cannot do that.", "", "SKIP:second_refusal", 0), ("a", None, "", "SKIP:second_refusal", 0), ("refuse", "b", "", "SKIP:one_failed", 0), (None, "b", "bx", "", 3)]
    assert generate.pair_chain(df.limit(0), generate.echo, keys, "first", "second").count() == 0
    d = spark.createDataFrame([(1, "one two three", "sport", 4), (2, "one", None, None), (3, None, "x", 1)], "id int, text string, domain string, n_tokens int")
    rows = {r["id"]: r for r in generate.domain_turns(d, generate.echo, [("rewrite", "x {input}"), ("check", "x {domain} {max_token_count} {length_ratio}")]).collect()}
    assert rows[1]["turns"]["check"] == "sport 5 0.75" and rows[1]["turns"]["length_diff"] == "-1" and rows[1]["domain"] == "sport"
    assert rows[2]["turns"]["check"] == "1 0" and rows[3]["status"] == "skipped"
    v = generate.validated(d, generate.echo, "x {input}", {"long": lambda text, reply: len(reply) > 5}, max_retries=1)
    assert [(r["id"], r["reply"], r["failed"], r["attempts"]) for r in v.collect()] == [(1, "one two three", [], 1), (2, "one", ["long"], 2), (3, None, ["long"], 0)]


def test_tails(spark):
    from math import erfc, sqrt

    zs = [0.0, 0.01, 0.7, 1.96, 2.999, 3.0, 3.5, 5.0, 8.0, 12.0]
    rows = stats.with_tails(spark.createDataFrame([(z,) for z in [*zs, -1.0, None]], "z double"), F.col("z")).collect()
    for r in rows[:-2]:
        assert r["p"] == pytest.approx(erfc(r["z"] / sqrt(2)), rel=1e-9, abs=1e-14)
    assert rows[-2]["p"] == 1.0 and rows[-1]["p"] is None
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, None), (None, 0)], "v double, g int")
    assert tuple(stats.mann_whitney(df, "v", F.col("g") == 1).first())[:2] == (2, 0) and stats.mann_whitney(df, "v", F.col("g") == 1).first()["p"] is None
    assert tuple(stats.mann_whitney(df.limit(0), "v", F.col("g") == 1).first()) == (0, 0, None, None, None)
    # Ranks 1, 2.5 against 2.5, 4, by hand.
    two = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0)], "v double, g int")
    r = stats.mann_whitney(two, "v", F.col("g") == 1).first()
    assert (r["u"], r["z"]) == (0.5, round(1.0 / sqrt(4 / 12 * (5 - 6 / 12)), 4)) and abs(r["p"] - erfc((1.0 / sqrt(1.5)) / sqrt(2))) < 1e-6
    with pytest.raises(ValueError, match="fewer than two values"):
        ml.logistic(spark.createDataFrame([], "x double, y double"), ["x"], "y")


def test_positions(spark):
    df = spark.createDataFrame([([[0.0], [1.0], [2.0]], m) for m in ("last", "first", "all", "none", "other")] + [([], "last"), (None, "all")], "t array<array<double>>, m string")
    got = [r[0] for r in df.select(vectors.injected_at(F.col("t"), F.array(F.lit(10.0)), F.lit(0.5), F.col("m"))).collect()]
    assert got == [[[0.0], [1.0], [7.0]], [[5.0], [1.0], [2.0]], [[5.0], [6.0], [7.0]], [[0.0], [1.0], [2.0]], [[0.0], [1.0], [2.0]], [], None]
    padded = df.limit(2).select(vectors.injected_at(F.col("t"), F.array(F.lit(10.0)), F.lit(0.5), F.lit("first"), F.lit(1))).collect()
    assert padded[0][0] == [[0.0], [6.0], [2.0]]


def test_files_of_arrays_and_models(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    np.save(tmp_path / "b.npy", np.array([1.5, 2.5, 3.5], np.float32))
    rows = {(r["file"][-5:], r["row"]): r["values"] for r in readers.arrays(spark, str(tmp_path)).collect()}
    assert rows == {("a.npy", 0): [0, 1], ("a.npy", 1): [2, 3], ("a.npy", 2): [4, 5], ("b.npy", 0): [1.5, 2.5, 3.5]}
    df = spark.createDataFrame([(float(i % 2), float(i % 7)) for i in range(40)], "y double, x double")
    sinks.model(ml.logistic(df, ["x"], "y"), str(tmp_path / "model"))
    assert readers.model(str(tmp_path / "model")).transform(ml.assembled(df, ["x"])).count() == 40
    new = sinks.move(spark, [str(tmp_path / "a.npy"), str(tmp_path / "none.npy")], str(tmp_path / "results"))
    assert len(new) == 1 and (tmp_path / "results" / "a.npy").exists() and not (tmp_path / "a.npy").exists()
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.arrays(df.select(F.array("x").alias("v")), str(tmp_path / "c.npy"), "v", "v", most=1)
    bars = sinks.plot_table(df, "bar", "x", "y").first()
    assert (bars["kind"], bars["series"]) == ("bar", "")


def test_singular_values(spark):
    import numpy as np

    rows = [[float((i * k) % 7) for k in range(1, 5)] for i in range(20)]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "v array<float>")
    got = [r["value"] for r in ml.singular_values(df, "v", 3).collect()]
    assert got == pytest.approx(np.linalg.svd(np.array(rows), compute_uv=False)[:3].tolist(), rel=1e-6)


def test_models(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 7), i) for i in range(60)], "y double, x double, id int")
    model = ml.logistic(df, ["x"], "y")
    assert {r["feature"] for r in ml.coefficients(model, ["x"], df).collect()} == {"x", "intercept"}
    z = ml.standardised(df, ["x"]).agg(F.round(F.avg("x"), 9), F.round(F.stddev_pop("x"), 9)).first()
    assert tuple(z) == (0.0, 1.0)


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text('﻿post_id,text,post_tokens,annotators,targets,gold_label\n1,"two\nlines, ""quoted""","[\'a\']",x,"[\'None\']",0\n', encoding="utf-8")
    row = readers.posts(spark, str(p)).first()
    assert row["text"] == 'two\nlines, "quoted"' and row["gold_label"] == 0
    j = tmp_path / "posts.json"
    j.write_text(json.dumps({"k1": {"post_tokens": ["a"], "annotators": [{"label": "normal", "target": ["None"]}], "rationales": [[0, 1]]}}))
    assert readers.nested_posts(spark, str(j)).first()["annotators"][0]["label"] == "normal"
    n = tmp_path / "emotions.txt"
    n.write_text("Bad\tanger\t1\nbad\tfear\t1\ngood\tjoy\t0\n")
    lexicon = readers.emotion_lexicon(spark, str(n))
    assert [tuple(r) for r in readers.negative_words(lexicon, ["anger", "fear"]).collect()] == [("bad", 2)]
    d = tmp_path / "deny.txt"
    d.write_text("# comment\n\n17 because\n18\n")
    assert {r["id"] for r in readers.denylist(spark, str(d)).collect()} == {"17", "18"}
    c = tmp_path / "lex.tsv"
    c.write_text("category\tstereotype\tlemma\nan\tyes\tpest\nshort\tline\n")
    found = readers.category_lexicon(spark, str(c))
    assert [tuple(r) for r in found.collect()] == [("an", "pest")] and readers.expanded(found).count() == 7
    built = []
    build = lambda: built.append(1) or found
    path = str(tmp_path / "cached")
    assert readers.cached(spark, path, build).count() == readers.cached(spark, path, build).count() == 1 and built == [1]
    assert readers.union_files(spark, path, str(tmp_path / "none")).count() == 1
    assert readers.pair_columns(spark.createDataFrame([("a", "b", "t")], "text_clean string, generated_text string, hate_type string")).columns == ["original", "output", "hate_type"]
    sinks.csv(found.withColumn("l", F.array(F.lit(1))), str(tmp_path / "out.csv"))
    sinks.one_csv(found, str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    sinks.by_class(found, str(tmp_path / "parts"), "category")
    assert (tmp_path / "parts" / "category=an").exists()
    sinks.metrics(found, str(tmp_path / "m.json"))
    sinks.report("Title", {"lexicon": found}, str(tmp_path / "r.md"))
    assert json.loads((tmp_path / "m.json").read_text())["term"] == "pest" and "| an | pest |" in (tmp_path / "r.md").read_text()


def test_stream_resumes(spark, tmp_path):
    items, log, point = (str(tmp_path / x) for x in ("items", "log", "point"))
    rows = spark.createDataFrame([(1, 0.5), (2, 1.0)], "layer int, alpha double")
    for extra in (rows, rows.withColumn("layer", F.col("layer") + 1)):
        extra.write.mode("append").parquet(items)
        run_items(spark, items, "layer int, alpha double", log, point, lambda df: df.withColumn("score", F.col("alpha") * 2), ["layer", "alpha"]).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == got.select("layer", "alpha").distinct().count() == 4
    events = spark.createDataFrame([("2024-01-01 10:10:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:00:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_counts(events, "ts", "k").collect()) == [1, 2]


def test_guards(spark):
    df = spark.createDataFrame([(1, "asian people"), (2, "xyz"), (3, None)], "id int, g string")
    kept, left = guards.mapped_groups(df, "g")
    assert [r["id"] for r in kept.collect()] == [1] and [r["g"] for r in left.collect()] == [None, "xyz"]
    assert guards.only_known(df.where("id = 2"), "g", ["xyz"]).count() == 1
    with pytest.raises(Exception, match="unexpected g: null"):
        guards.only_known(df, "g", ["xyz", "asian people"]).collect()
    texts = spark.createDataFrame([("we met John Smith today",), ("The End",), (None,)], "t string")
    assert [r[0] for r in texts.select(guards.names_person(F.col("t"))).collect()] == [True, False, False]
    assert [r[0] for r in texts.select(guards.names_person(F.col("t"), lambda x: "End" in x)).collect()] == [False, True, False]
    table = spark.createDataFrame([("cats", "cat"), ("saw", "see"), ("saw", "saw")], "word string, lemma string")
    rows = spark.createDataFrame([(1, ["cats", "saw"]), (2, [])], "id int, t array<string>")
    assert {r["id"]: r["forms"] for r in guards.lemmas(rows, "id", "t", table).collect()} == {1: ["cat", "cats", "saw", "see"], 2: []}
    marks = spark.createDataFrame([("a", [[0, 0, 0, 0], [0, 1, 0, 1]]), ("a", [[0, 0]]), ("a", None)], "k string, r array<array<int>>")
    assert [tuple(r) for r in guards.rationale_medians(marks, "r", "k").collect()] == [("a", 1, 0.5, 3.0)]
    kinds = spark.createDataFrame([("exclusion / x",), ("",), (None,)], "k string")
    assert [r[0] for r in kinds.select(guards.type_rule(F.col("k"), {"EXCLUSION": "rule"}, "default")).collect()] == ["rule", "default", "default"]
    assert guards.by_length(texts, "t").count() == 3


def test_leaked_texts_normalises_whole_only_what_may_be_an_item(spark):
    long = "The  item, of more than its first characters: " + "word " * 100
    texts = [long, long.upper() + "!", long + "more", "other " * 200, "é" * 400 + "ab", "é" * 400 + " abc", "Ab", "", " !", None, " ", "the item of more than its first "]
    items = [(1, "the item of more than its first characters " + "word " * 99 + "word"), (2, "ab"), (3, "abc"), (4, ""), (5, None), (6, "the item of more than its first"), (7, "none such"), (8, "word")]
    train, evaluation = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(items, "item_id int, key string")
    want = [(k,) for k in (1, 2, 3, 4, 6)]
    for most in (1_000_000, 3):  # beginnings are broadcast, or too many for it
        assert sorted(map(tuple, select.leaked_texts(train, evaluation, "text", "key", parse.leakage_key, most=most).select("item_id").collect())) == want
    plain = select.leaked(train.select(parse.leakage_key(F.col("text")).alias("key")), evaluation, "key")
    assert sorted(map(tuple, plain.select("item_id").collect())) == want
    whole = spark.sparkContext.accumulator(0)

    def lower(x):
        whole.add(len(x) > 300)
        return x.strip().lower()

    rows = spark.createDataFrame([("other " * 100 + str(i),) for i in range(50)] + [("item " * 100,)], "text string")
    found = select.leaked_texts(rows, spark.createDataFrame([(1, ("item " * 100).strip())], "item_id int, key string"), "text", "key", F.udf(lower))
    assert found.count() == 1 and whole.value < 10
