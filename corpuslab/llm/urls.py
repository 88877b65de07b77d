"""URL filters in DataFrame functions only: rules by host and path, and trust and distrust spread over host links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# The rules, (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a host's score that goes on along its links, and the rounds.
DAMPING, ROUNDS = 0.85, 8
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fitting(rules: Sequence[tuple[str, str]], host: Column, path: Column, what: int) -> Column:
    """The longest fitting rule (``what`` 0) or its verdict (1); of rules as long, the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule[what])).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts, with the number of each: (src, dst, n). One row for each pair of hosts."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    found = links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst"))
    return found.where((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score): personalised PageRank of ``seeds`` (kind, host, seed).

    Kind ``trust`` follows the links, ``distrust`` goes against them: who links to a blocked host is distrusted.
    A host without links in that direction keeps nothing of what it would pass on. Both kinds go in one join and one
    sum a round; a host with very many links is one key of an ordinary join, which is split where it is skewed.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("weight")), "url-edges")
    seeds = written(seeds.groupBy("kind", "host").agg(F.sum("seed").alias("seed")), "url-seeds")
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    for k in range(1, rounds + 1):
        passed = edges.join(score, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        score = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 0:
            score = written(score, "url-scores")
    return score


def filter_urls(df: DataFrame, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``df`` with host, path, rule, verdict (allow or block), trust and distrust.

    The longest rule that fits decides. Else the method does: pages that rules allow or block make their hosts seeds,
    by the number of such pages over all of their kind; trust spreads along links between hosts, distrust against
    them, and a host is blocked when its distrust is over its trust. Null urls, or urls without ``://``, have an empty
    host and path; no rule fits them and they are allowed, as are hosts that nothing reaches. Null pages have no
    links. Repeated rows count each. No rows give no rows. Input columns of these names are replaced.
    """
    made = ["host", "path", "rule", "verdict", "trust", "distrust"]
    own = [c for c in df.columns if c not in made]
    pages = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    pages = pages.withColumn("rule", _fitting(rules, F.col("host"), F.col("path"), 0)).withColumn("ruled", _fitting(rules, F.col("host"), F.col("path"), 1))
    counted = pages.where(F.col("rule").isNotNull()).groupBy("ruled", "host").agg(F.count("*").alias("n"))
    sums = counted.groupBy("ruled").agg(F.sum("n").alias("all"))
    seeds = counted.join(F.broadcast(sums), "ruled").select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("n") / F.col("all")).alias("seed"))
    score = spread(host_links(pages), seeds)
    sides = score.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    joined = pages.drop("html").join(sides, "host", "left")
    trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > trust, "block").otherwise("allow"))
    return joined.select("__row.*", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    cases = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", rule, verdict))
    which = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    ruled = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    rounds = [f"s{k} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, {1 - DAMPING!r} * seed AS score FROM v UNION ALL SELECT e.kind, e.dst, {DAMPING!r} * score * weight FROM e JOIN s{k - 1} s ON e.kind = s.kind AND e.src = s.host) GROUP BY 1, 2)" for k in range(1, ROUNDS + 1)]
    return f"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, CASE {which} END AS rule, CASE {ruled} END AS ruled FROM u),
l AS (SELECT host AS src, translate(dst, '{UPPER}', '{LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS dst FROM p)),
n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' GROUP BY 1, 2),
e AS (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM n
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM n),
v AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS seed FROM p WHERE rule IS NOT NULL GROUP BY ruled, host),
s0 AS (SELECT kind, host, seed AS score FROM v),
{", ".join(rounds)},
t AS (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS distrust FROM s{ROUNDS} GROUP BY 1)
SELECT page_id, p.host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN t USING (host)
"""


ORACLE = _oracle()
