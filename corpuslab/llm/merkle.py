"""Merkle manifest of a dataset: a hash tree per group and one over the groups, with a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Consecutive nodes that become one.
RUN = 3


def encoded(*fields: Column) -> Column:
    """Fields one after the other, so that no two rows have the same text: "-" for null, else bytes, ":" and the value."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, gapless from 0 in each group ``by`` in ascending ``order``, and ``nodes``, the group's rows.

    Rows are dealt by ranges of (by, order), so that a group of a third of all rows, or of rows that are all alike, is
    spread over tasks; what meets per group is one count for each task. Nulls come first and are a group. ``rows`` is
    read twice (ranges are sampled): give a written table.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [*by, *order, "tie"]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    held = written(ranged.withColumn("part", F.shiftright("at", 33)), "placed")
    parts = held.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    start = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("part").alias("of_part"), (start - F.col("first")).alias("start"), F.sum("n").over(whole).alias("nodes"))
    same = F.col("part") == F.col("of_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return held.join(parts, same).withColumn("place", F.col("at") + F.col("start")).select(*rows.columns, "place", "nodes")


def levels(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the trees over nodes (tree, place, nodes, digest, ...), and for each height the roots of that height.

    A level has all nodes that have siblings or a parent: with ``up``, their parent's place, and ``step``, what stands
    before and after them in their run. One window gives both the parent's digest and the siblings; the first of a run
    stands for its parent, so parents come once each without a shuffle. Each level is written, and a third of the last.
    """
    found, roots = [], []
    run = Window.partitionBy("tree", "up").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.pmod("place", F.lit(RUN)).cast("int")
    left = nodes.agg(F.coalesce(F.max("nodes"), F.lit(0))).first()[0]
    while True:
        roots.append(nodes.where(F.col("nodes") == 1).select("tree", F.col("digest").alias("subroot")))
        if left <= 1:
            return found, roots
        level = nodes.where(F.col("nodes") > 1).withColumn("up", F.floor(F.col("place") / RUN))
        level = level.withColumn("run", F.collect_list("digest").over(run))
        step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(RUN)), "").alias("after"))
        level = level.withColumn("step", step).withColumn("parent", digest(F.array_join("run", ""))).drop("run")
        level = written(level, "level")
        found.append(level)
        nodes = level.where(at == 0).select("tree", F.col("up").alias("place"), F.ceil(F.col("nodes") / RUN).alias("nodes"), F.col("parent").alias("digest"))
        left = -(-left // RUN)


def paths(found: list[DataFrame], roots: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes of the lowest level (its columns ``keep``) with ``subroot``, ``root`` and ``path``, their steps up to the root.

    ``above`` has for each ``tree`` its root and the path from its subroot. Paths go down from the roots, so that a
    level's rows are joined once, with a third as many parents.
    """
    top = lambda k: roots[k].join(above, "tree")
    path = top(len(found)).select("tree", F.lit(0).cast("long").alias("place"), "subroot", "root", "path")
    for k in range(len(found) - 1, -1, -1):
        own = ["tree", "place"] if k else ["tree", "place", *keep]
        parents = path.withColumnRenamed("place", "up")
        path = found[k].join(parents, ["tree", "up"]).select(*own, "subroot", "root", F.concat(F.array("step"), "path").alias("path"))
        if k:
            path = path.unionByName(top(k).select("tree", F.lit(0).cast("long").alias("place"), "subroot", "root", "path"))
    return path


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """``rows`` with ``subroot`` (of the group's tree), ``root`` (over all subroots) and ``path`` (array of before, after).

    Leaves of a group ascend by ``order``, then ``leaf``; three consecutive nodes at a time (the last run: fewer, even
    one) become the hash of their digests, until one node is left. Groups ascend bytewise, null first, and form one
    tree over their subroots in the same way. ``fold(leaf, path)`` gives the root, for a row that is unchanged.

    Nulls in ``group`` are a group; null ``order`` comes first. Repeated rows are leaves of their own, next to each
    other. No rows give no rows. ``rows`` has one column ``leaf`` of hex digests; give a written, thin table. Columns
    with this operator's names (tree, place, nodes, digest, up, step, parent, path) are not allowed in it.
    """
    keep = rows.columns
    leaves = placed(rows.withColumn("group_key", F.col(group)), ["group_key"], [*order, leaf])
    leaves = written(leaves, "leaves")
    groups = written(leaves.where(F.col("place") == 0).select("group_key", F.col("nodes").alias("of")), "groups")
    trees = written(placed(groups, [], ["group_key"]).select("group_key", "of", F.col("place").alias("tree")), "trees")
    total = trees.count()
    # A group's number goes to its leaves by (group, range of places), so that a large group is no single key.
    span = 10_000
    bits = trees.select("tree", F.col("group_key").alias("of_group"), F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / span))).alias("span"))
    mine = leaves.withColumn("at_span", F.floor(F.col("place") / span))
    nodes = mine.join(bits, F.col("group_key").eqNullSafe(F.col("of_group")) & (F.col("at_span") == F.col("span")))
    nodes = nodes.select("tree", "place", "nodes", F.col(leaf).alias("digest"), F.struct(*keep).alias("row"))
    nodes = written(nodes, "nodes")
    found, roots = levels(nodes)
    # Trees of one leaf have no level: their leaf is their subroot.
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = written(subroots, "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(total).cast("long").alias("nodes"), F.col("subroot").alias("digest"))
    above, ends = levels(tops)
    none = F.array().cast("array<struct<before:string,after:string>>")
    ended = ends[-1].select("tree", F.col("subroot").alias("root"), none.alias("path"))
    if above:
        high = paths(above, [e.where(F.lit(False)) for e in ends[:-1]] + [ends[-1]], ended, ["digest"])
        high = high.select(F.col("place").alias("tree"), "root", "path")
    else:
        high = ended
    high = written(high, "tops")
    single = nodes.where(F.col("nodes") == 1).join(high, "tree").select("row.*", F.col("digest").alias("subroot"), "root", "path")
    if not found:
        return single
    return paths(found, [r if k else r.where(F.lit(False)) for k, r in enumerate(roots)], high, ["row"]).select("row.*", "subroot", "root", "path").unionByName(single)


def proof(path: Column) -> Column:
    """Digests of all siblings from a leaf's up to the root, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda found, s: digest(F.concat(s["before"], found, s["after"])))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; line breaks are deleted from half of them, which must show.

    A null id comes first and is not tampered with; repeated rows are leaves of their own; nulls are "-" in a leaf.
    """
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: digest(encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    bent = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(F.translate("text", "\n", "")))
    thin = written(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), bent.alias("bent")), "thin-leaves")
    found = manifest(thin, "source", ["doc_id"])
    folded = found.withColumn("folded_root", fold(F.coalesce("bent", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
#: crc32 by bits: after each byte (from 0) stand eight shifts (-1).
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
ORACLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, sha256({_FIELDS.format(text="text")}) AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN sha256({_FIELDS.format(text="replace(text, chr(10), '')")}) END AS bent FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT 0 AS level, source, place, leaf AS digest, n FROM p
  UNION ALL SELECT level + 1, source, place // {RUN}, sha256(string_agg(digest, '' ORDER BY place)), max((n + {RUN - 1}) // {RUN}) FROM t WHERE n > 1 GROUP BY level, source, place // {RUN}),
s AS (SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, subroot AS digest, n FROM s
  UNION ALL SELECT level + 1, place // {RUN}, sha256(string_agg(digest, '' ORDER BY place)), max((n + {RUN - 1}) // {RUN}) FROM u WHERE n > 1 GROUP BY level, place // {RUN}),
x AS (SELECT p.*, s.subroot, s.height, s.place AS at, (SELECT digest FROM u WHERE n = 1) AS root, (SELECT max(level) FROM u) AS over FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
b AS (SELECT x.doc_id, x.leaf, x.place, x.source, t.level, t.place AS other, t.digest, t.place < x.place // CAST({RUN} ** t.level AS BIGINT) AS first
    FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.place // {RUN} = x.place // CAST({RUN} ** (t.level + 1) AS BIGINT) AND t.place <> x.place // CAST({RUN} ** t.level AS BIGINT)
  UNION ALL SELECT x.doc_id, x.leaf, x.place, x.source, x.height + u.level, u.place, u.digest, u.place < x.at // CAST({RUN} ** u.level AS BIGINT)
    FROM x JOIN u ON u.n > 1 AND u.place // {RUN} = x.at // CAST({RUN} ** (u.level + 1) AS BIGINT) AND u.place <> x.at // CAST({RUN} ** u.level AS BIGINT)),
r AS (SELECT source, place, level, coalesce(string_agg(digest, '' ORDER BY other) FILTER (first), '') AS before, coalesce(string_agg(digest, '' ORDER BY other) FILTER (NOT first), '') AS after FROM b GROUP BY ALL),
q AS (SELECT source, place, string_agg(digest, '' ORDER BY level, other) AS proof FROM b GROUP BY ALL),
f AS (SELECT source, place, 0 AS level, coalesce(bent, leaf) AS acc, height + over AS steps FROM x
  UNION ALL SELECT f.source, f.place, f.level + 1, sha256(coalesce(r.before, '') || f.acc || coalesce(r.after, '')), f.steps
    FROM f LEFT JOIN r ON f.source IS NOT DISTINCT FROM r.source AND f.place = r.place AND f.level = r.level WHERE f.level < f.steps)
SELECT x.doc_id, x.leaf, x.subroot, x.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.acc AS folded_root, f.acc = x.root AS verified
FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND x.place = f.place AND f.level = f.steps LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source AND x.place = q.place
"""
