"""Helpers that keep hot keys apart, against plain joins."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.jaccard import components


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(str(k % 7) if k % 11 else None, k) for k in range(400)] + [("9", k) for k in range(3)], "key string, n long").repartition(5)


@pytest.fixture
def one(spark):
    return spark.createDataFrame([(str(k), f"v{k}") for k in (0, 1, 2, 3, 9, 20)], "key string, v string")


@pytest.mark.parametrize("hub", [5, 40, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_one(monkeypatch, rows, one, hub, how):
    monkeypatch.setattr(common, "HUB", hub)
    assert sorted(map(str, common.join_one(rows, one, "key", how).select("key", "n", "v").collect())) == sorted(map(str, rows.join(one, "key", how).select("key", "n", "v").collect()))


def test_once_each(monkeypatch, rows, one):
    for hub in (5, 10_000):
        monkeypatch.setattr(common, "HUB", hub)
        found = [r["key"] for r in common.once_each(rows, one, "key").collect()]
        assert sorted(found) == ["0", "1", "2", "3", "9"]


def test_few_copies(monkeypatch, rows):
    monkeypatch.setattr(common, "HUB", 20)
    found = common.few_copies(rows, "key", [F.col("n")]).collect()
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    assert all(sum(r["key"] == k for r in found) == (n if k is None or n <= 20 else 1) for k, n in counts.items())
    assert all(r["again"] == (r["key"] is not None and counts[r["key"]] > 20) for r in found)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 10)
    edges = [(0, k) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(59, 200), (200, 130), (300, 301), (301, 302)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 300 if k >= 300 else 0 for e in edges for k in e}


def test_a_cluster_needs_shared_folders():
    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://there:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(cluster)
    with pytest.raises(RuntimeError, match=r"spark\.sql\.warehouse\.dir"):
        common.bucketed(SimpleNamespace(sparkSession=cluster), "key", 2)


def test_forget(spark, one):
    found = common.written(one, "some")
    assert found.count() == 6
    common.forget(found, one, None)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        spark.read.parquet(found._corpuslab_path).count()
