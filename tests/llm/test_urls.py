import pytest

from corpuslab.llm.urls import ROUNDS, filter_urls, host_links, op5_url_filter, spread


def test_rules_and_parts(spark):
    rows = [
        (1, "http://a.example.COM/en/7x?q#f", ""), (2, "x://com/en/", None), (3, "http://example.com", ""), (4, None, "<p>"), (5, "no scheme", ""), (6, "http://Example.net/de/8", ""),
        (7, "http://notcom/en/", ""), (8, "http://a.net/de/?x://y/", ""), (9, "http://b.org/es/z#x", ""), (9, "http://b.org/es/z#x", ""), (10, "", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("com", "/en/", "com/en/", "block"), 3: ("example.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.net", "/de/8", "example.net/de/8", "block"), 7: ("notcom", "/en/", None, "allow"), 8: ("a.net", "/de/", "net/de/", "allow"), 9: ("b.org", "/es/z", "org/es/", "block"), 10: ("", "", None, "allow"),
    }
    assert filter_urls(df).count() == len(rows) and filter_urls(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("html", "HTML").selectExpr("*", "1 AS trust", "'x' AS verdict")
    assert filter_urls(clash, html="HTML").columns == ["page_id", "url", "HTML", "host", "path", "rule", "verdict", "trust", "distrust"]


def test_spread_against_loops(spark):
    edges = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 2, ("c", "a"): 5, ("d", "x"): 1, ("e", "d"): 4}
    pages = [("h://" + s, "".join(f'<a class=k HREF="https://{d.upper()}/p">x</a><a href="/own">' for _ in range(n))) for (s, d), n in edges.items()]
    df = spark.createDataFrame([(u[4:], h) for u, h in pages], "host string, html string")
    assert {(r["src"], r["dst"]): r["n"] for r in host_links(df).collect()} == edges
    seeds = {("trust", "a"): 1.0, ("distrust", "x"): 0.75, ("distrust", "c"): 0.25}
    score = dict(seeds)
    for _ in range(ROUNDS):
        new = {k: 0.15 * v for k, v in seeds.items()}
        for (s, d), n in edges.items():
            for kind, one, two in (("trust", s, d), ("distrust", d, s)):
                total = sum(m for (p, q), m in edges.items() if (p if kind == "trust" else q) == one)
                new[kind, two] = new.get((kind, two), 0) + 0.85 * score.get((kind, one), 0) * n / total
        score = new
    links = spark.createDataFrame([(s, d, n) for (s, d), n in edges.items()], "src string, dst string, n long")
    got = spread(links, spark.createDataFrame([(k, h, v) for (k, h), v in seeds.items()], "kind string, host string, seed double"))
    assert {(r["kind"], r["host"]): r["score"] for r in got.collect() if r["score"]} == pytest.approx({k: v for k, v in score.items() if v})


def test_distrust_reaches_who_links_to_blocked(spark):
    rows = [(1, "http://bad.org/es/1", ""), (2, "http://ally.test/1", '<a href="//bad.org/x">'), (3, "http://good.net/de/1", '<a href="http://friend.test/">'), (4, "http://friend.test/2", None), (5, "http://alone.test/", "")]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_query(spark, sf_dir):
    assert op5_url_filter(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
