"""Writers. Results that people read are small and go through the driver; everything else is written by the tasks."""

from __future__ import annotations

import io
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    return df.select(*[F.to_json(f"`{n}`").alias(n) if t.startswith(("array", "map", "struct")) else F.col(f"`{n}`") for n, t in df.dtypes])


def csv(df: DataFrame, path: str, quote_all: bool = False, sep: str = ",", header: bool = True) -> None:
    flat(df).write.mode("overwrite").option("header", header).option("quoteAll", quote_all).option("escape", '"').option("sep", sep).csv(path)


def put(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file at a path of any store that Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def one_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one file with a byte-order mark; more than ``most`` rows are an error, not a cut."""
    rows = flat(df).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with csv()")
    put(df.sparkSession, path, rows.to_csv(index=False, lineterminator="\n").encode("utf-8-sig"))


def append(df: DataFrame, path: str) -> None:
    """A batch at the end of a log table."""
    df.write.mode("append").parquet(path)


def by_class(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metrics(df: DataFrame, path: str) -> None:
    """One row of figures as an indented JSON file."""
    Path(path).write_text(json.dumps(json.loads(df.limit(1).toJSON().first()), indent=2, ensure_ascii=False), encoding="utf-8")


def arrays(df: DataFrame, path: str, values: str, *order: str, most: int = 100_000) -> None:
    """A small table's vectors as one array file (.npy), in the order of ``order``; more than ``most`` rows are an error."""
    import numpy as np

    rows = df.orderBy(*order).select(values).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as Parquet")
    body = io.BytesIO()
    np.save(body, np.array([r[0] for r in rows], dtype=np.float64))
    put(df.sparkSession, path, body.getvalue())


def model(fitted, path: str) -> None:  # noqa: ANN001
    """A fitted transformer, or several in a row, as a pipeline that ``readers.model`` reads."""
    from pyspark.ml import PipelineModel

    PipelineModel(list(fitted) if isinstance(fitted, (list, tuple)) else [fitted]).write().overwrite().save(path)


def plot_table(df: DataFrame, kind: str, x: str, y: str, series: str | None = None) -> DataFrame:
    """(kind, series, x, y) for a plotting tool: bar, line, pie and heatmap take the rows as they are; box takes
    (least, quartiles, most) of ``y`` per ``x`` in ``y_low`` to ``y_high``. Null series are empty."""
    name = F.coalesce(F.col(series).cast("string"), F.lit("")) if series else F.lit("")
    rows = df.select(F.lit(kind).alias("kind"), name.alias("series"), F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y"))
    if kind != "box":
        return rows
    from ..operators.order import quantiles

    return quantiles(rows, "y", {"y_low": 0.0, "y_q1": 0.25, "y_mid": 0.5, "y_q3": 0.75, "y_high": 1.0}, "kind", "series", "x").drop("total")


def move(spark: SparkSession, paths: Sequence[str], folder: str) -> list[str]:
    """Files or folders moved into ``folder``, which is made; those that are not there are left out. Names that are
    there already are an error: nothing is overwritten. Returns the new paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(conf)
    system.mkdirs(target)
    found = []
    for path in paths:
        old = jvm.org.apache.hadoop.fs.Path(path)
        if not old.getFileSystem(conf).exists(old):
            continue
        new = jvm.org.apache.hadoop.fs.Path(target, old.getName())
        if system.exists(new) or not system.rename(old, new):
            raise FileExistsError(str(new))
        found.append(new.toString())
    return found


def report(title: str, tables: dict[str, DataFrame], path: str, most: int = 50) -> None:
    """A Markdown page of small summaries."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        parts += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]
    Path(path).write_text("\n".join(parts) + "\n", encoding="utf-8")
