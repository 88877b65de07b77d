"""Tables and files that a plan writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one serves a local
    master (tests); on a cluster, where executors would write to their own disks, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            local = tempfile.mkdtemp(prefix="corpuslab-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            _LOCAL.append(f"file://{local}")
        found = _LOCAL[0]
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in ``folder``: a plan's stages are then fixed and recoverable. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        with contextlib.suppress(Exception):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
