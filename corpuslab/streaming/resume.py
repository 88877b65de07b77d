"""A resumable log of work items as a stream: new items in, one row per finished item out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import exists


def run_items(spark: SparkSession, items: str, schema: str, log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> StreamingQuery:
    """Process what arrives in the folder ``items`` and is not yet in ``log``; a batch that ran again adds nothing.

    The batch's number is kept with its rows: a batch is written under a folder of its own, which a repeated run
    replaces, so that results are there exactly once even if the driver is lost between writing and committing.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(list(keys))
        if exists(spark, log):
            done = spark.read.parquet(log)
            new = new.join(done.where(F.col("batch") != number).select(*keys), list(keys), "left_anti")
        work(new).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return spark.readStream.schema(schema).parquet(items).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, key, n) of a stream or a table; a stream waits ``late`` for stragglers."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    counted = events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
