"""Helpers that the operators share: the shared folder, written tables, batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Rows of a key from which a join does not deal them to one task, and the most keys that can be so.
HUB, HUBS = 1_000, 50_000
#: Texts that a task remembers, by their md5, to hand on copies once.
REMEMBERED = 100_000


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors see.

    Where it is unset, a temporary folder serves a local master (tests); on a cluster, where executors would write to
    their own disks, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="corpuslab-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL["dir"] = f"file://{folder}"
        found = _LOCAL["dir"]
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, fixes random columns, survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._corpuslab_path = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_corpuslab_path", None):
            _remove(df.sparkSession, path)


def join_one(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has each ``key`` once, so that a key of very many rows is no single task's.

    Keys of more than HUB rows, and of so many that HUBS of them would hold all rows, are joined where their rows
    are: what ``one`` has of them is broadcast, at most HUBS of its rows. All others are dealt by key. Null keys are in
    no hub; an inner join drops them, a left join spreads them. ``rows`` is read three times: give a written table.
    """
    total = rows.count()
    hubs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > max(HUB, total // HUBS)).select(key)
    few = F.broadcast(hubs)
    many = rows.join(few, key, "left_semi").join(F.broadcast(one.join(few, key, "left_semi")), key, how)
    rest = rows.where(F.col(key).isNotNull()).join(few, key, "left_anti").join(one.hint("merge"), key, how)
    found = many.unionByName(rest)
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema if f.name != key]
        found = found.unionByName(rows.where(F.col(key).isNull()).select(key, *[c for c in rows.columns if c != key], *empty))
    return found


def few_copies(rows: DataFrame, key: str, other: list[Column]) -> DataFrame:
    """``rows`` (a ``key`` for each text), with ``again``: 1 where copies elsewhere are left out in favour of the row.

    Of a text that more than HUB rows have (and so many that at most HUBS texts can) one row stays, by the least hash
    of ``other`` columns; rows that are alike in them too stay. So no text moves by millions to meet its copies.
    """
    own = F.xxhash64(*other) if other else F.lit(0).cast("long")
    hashed = rows.withColumn("own", own)
    total = rows.count()
    hot = written(hashed.groupBy(key).agg(F.count("*").alias("rows"), F.min("own").alias("least")).where(F.col("rows") > max(HUB, total // HUBS)).select(key, "least"), "hot-keys")
    if hot.limit(1).count() == 0:
        return rows.withColumn("again", F.lit(0))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").withColumn("again", F.lit(0))
    return rest.unionByName(hashed.join(F.broadcast(hot), key).where(F.col("own") == F.col("least")).drop("own", "least").withColumn("again", F.lit(1)))


def once_each(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row for each ``key`` that ``wanted`` (each key once) has, of rows that are alike where their keys are.

    Keys of very many rows are looked up and reduced where their rows are; the others are dealt by key once.
    ``rows`` is read three times: give a written table.
    """
    total = rows.count()
    hubs = rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > max(HUB, total // HUBS)).select(key)
    few = F.broadcast(hubs)
    many = rows.join(F.broadcast(wanted.join(few, key, "left_semi").select(key)), key, "left_semi").dropDuplicates([key])
    rest = rows.join(few, key, "left_anti").join(wanted.select(key).hint("merge"), key, "left_semi").dropDuplicates([key])
    return many.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand freed memory back to the system: workers live on, and what one stage freed is missing for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that ``column`` takes about ``most`` bytes a batch (one row may be longer)."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, batch.num_rows * most // max(size, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bucketed(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``df`` as a table in the warehouse, dealt by ``key``: it is shuffled once, however often it is joined on ``key``.

    The table is dropped when the driver ends.
    """
    spark = df.sparkSession
    if not _is_local(spark) and not spark.sparkContext.getConf().get("spark.sql.warehouse.dir"):
        raise RuntimeError("set spark.sql.warehouse.dir to a folder that the driver and all executors share")
    name = f"corpuslab_{uuid.uuid4().hex}"
    df.repartition(partitions, key).write.bucketBy(partitions, key).sortBy(key).saveAsTable(name)

    def drop() -> None:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)
    return spark.table(name)
