import hashlib
import random
import zlib

import pytest

from corpuslab.llm import merkle
from corpuslab.llm.merkle import fold, manifest, op11_merkle_manifest, proof
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """The root, and for each leaf its list of (before, after)."""
    steps = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        ups, leaves = [], []
        for at in range(0, len(digests), 3):
            run = digests[at : at + 3]
            for k in range(len(run)):
                for leaf in under[at + k]:
                    steps[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(h(*run))
            leaves.append(sum(under[at : at + 3], []))
        digests, under = ups, leaves
    return digests[0], steps


def brute(rows):
    leaves = [(r, h(*map(field, r))) for r in rows]
    groups = {}
    for r, leaf in leaves:
        groups.setdefault(r[1], []).append((r, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[s] = tree([leaf for _, leaf in groups[s]])
    root, above = tree([built[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (r, leaf), steps in zip(groups[s], built[s][1], strict=True):
            path = steps + above[k]
            bent = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                bent = h(*map(field, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))
            for b, a in path:
                bent = h(b, bent, a)
            out.append((r[0], leaf, built[s][0], root, h(*[b + a for b, a in path]), bent, bent == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [10, 1, 27, 28, 3], [200, 5, 9, 81, 82]])
def test_query(spark, tmp_path, sizes):
    rng = random.Random(str(sizes))
    names = [None, "", "a", "B", "é", "ab", "￿x", "\U0001f600"]
    rng.shuffle(names)
    rows = [(k * 7 + n, names[k], rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", f"t{n}\nx\n", f"naïve {n}"])) for k, size in enumerate(sizes) for n in range(size)]
    rows += [(None, names[0], None, None, "x\ny")] * 2 + [rows[0]] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("leaf", F.lit("clash")).withColumn("path", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    got = sorted((tuple(r) for r in op11_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")}
    assert changed == {r[0] for r in got if not r[-1]} and 0 < len(changed) < len(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert manifest(empty, "source", ["doc_id"]).count() == 0


def test_equal_rows_are_spread(spark):
    """A third of all rows is one row repeated: places stay gapless, and each copy has a proof of its own place."""
    rows = [(1, "s", h("x"))] * 400 + [(k, f"s{k % 5}", h(str(k))) for k in range(2, 800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(8)
    placed = merkle.placed(df, ["source"], ["doc_id", "leaf"])
    at = {}
    for r in placed.collect():
        at.setdefault(r["source"], []).append(r["place"])
        assert r["nodes"] == sum(1 for x in rows if x[1] == r["source"])
    assert all(sorted(x) == list(range(len(x))) for x in at.values())
    found = manifest(df, "source", ["doc_id"]).withColumn("again", fold(F.col("leaf"), F.col("path"))).withColumn("proof", proof(F.col("path")))
    assert found.where("again = root").count() == len(rows)
    assert found.where("doc_id = 1").select("proof").distinct().count() > 2
