"""Logistic probes for all layers and folds at once, by Newton steps over sums of one scan a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import confusion, macro_f1
from .vectors import dot

#: Features that a probe may have: a task sums their products for every layer and fold.
WIDEST = 512
#: The fold of a probe that is fitted on all rows.
WHOLE = -1


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _summed(df: DataFrame, per_batch) -> DataFrame:  # noqa: ANN001
    """(layer, fold, place, value): what ``per_batch(layer, h, y, own)`` yields as (fold, numbers), summed over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            layers, h = batch.column("layer").to_numpy(), _vectors(batch.column("h"))
            y, own = batch.column("y").to_numpy().astype(np.float64), batch.column("fold").to_numpy()
            for layer in np.unique(layers).tolist():
                at = layers == layer
                for fold, numbers in per_batch(layer, h[at], y[at], own[at]):
                    key = layer, fold
                    sums[key] = sums[key] + numbers if key in sums else numbers
        for (layer, fold), numbers in sums.items():
            n = len(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, layer), pa.int32()), pa.array(np.full(n, fold), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(numbers, pa.float64())], names=["layer", "fold", "place", "value"])

    rows = df.select(F.col("layer").cast("int").alias("layer"), F.col("h").cast("array<double>").alias("h"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    return rows.mapInArrow(work, "layer int, fold int, place int, value double").groupBy("layer", "fold", "place").agg(F.sum("value").alias("value"))


def _solver(at: dict[tuple[int, int], np.ndarray], c: float):  # noqa: ANN202
    """A probe's loss and Newton step from its summed parts."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        layer, fold = int(pdf["layer"].iloc[0]), int(pdf["fold"].iloc[0])
        v, theta = pdf.sort_values("place")["value"].to_numpy() * c, at[layer, fold]
        d = len(theta) - 1
        free = np.append(np.ones(d), 0.0)
        full = np.zeros((d + 1, d + 1))
        full[np.triu_indices(d + 1)] = v[d + 2 :]
        full = full + np.triu(full, 1).T + np.diag(free + (1 - free) * 1e-12)
        step = -np.linalg.solve(full, v[1 : d + 2] + free * theta)
        return pd.DataFrame({"layer": [layer], "fold": [fold], "loss": [v[0] + 0.5 * (free * theta * theta).sum()], "step": [step.tolist()]})

    return solve


def fit_probes(df: DataFrame, folds: int = 0, c: float = 1.0, scaled: bool = True, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(layer, fold, w, bias, n): an L2 logistic probe for each layer, fitted on all rows (fold -1) and without each fold.

    ``df`` has layer, h (vector), y (0 or 1) and, with ``folds``, fold from 0. The loss is c times the sum of log losses
    plus half the squared weights, the bias free; features are scaled by the mean and deviation of the rows that a probe
    is fitted on, and w and bias are those of the features as they are. Each round is one scan: tasks add up every
    probe's loss, gradient and packed Hessian, the sums are solved in one task for each probe, and only steps come to
    the driver (layers * folds * features numbers). A step that makes the loss larger is halved.

    Rows with nulls are left out. A layer or fold whose rows have one label gets the probe that the penalty leaves: w 0
    or small. Vectors of unlike sizes are an error, and so are more than WIDEST features. No rows give no probes.
    """
    df = (df if folds else df.withColumn("fold", F.lit(0))).select("layer", "h", "y", "fold").dropna()
    sizes = df.agg(F.min(F.size("h")).alias("least"), F.max(F.size("h")).alias("most")).first()
    schema = "layer int, fold int, w array<double>, bias double, n long"
    if sizes["most"] is None:
        return df.sparkSession.createDataFrame([], schema)
    d = sizes["most"]
    if d != sizes["least"] or d > WIDEST:
        raise ValueError(f"vectors of {sizes['least']} to {d} features: probes take one size of at most {WIDEST}")
    which = [WHOLE, *range(folds)]

    def moments(layer: int, h: np.ndarray, y: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for fold in which:
            x = h[own != fold]
            if len(x):
                yield fold, np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    scale: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
    for (layer, fold), g in _summed(df, moments).toPandas().sort_values("place").groupby(["layer", "fold"]):
        v = g["value"].to_numpy()
        mean = v[1 : d + 1] / v[0]
        spread = np.sqrt(np.maximum(v[d + 1 :] / v[0] - mean * mean, 0))
        flat = spread <= 1e-12 * np.maximum(np.abs(mean), 1e-12)
        scale[layer, fold] = (mean if scaled else np.zeros(d), np.where(flat, 1.0, spread) if scaled else np.ones(d), round(v[0]))
    upper = np.triu_indices(d + 1)
    now = {key: np.zeros(d + 1) for key in scale}
    before: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]] = {}
    open_ = set(scale)
    for _ in range(rounds):
        at = {key: now[key] for key in open_}

        def parts(layer: int, h: np.ndarray, y: np.ndarray, own: np.ndarray, at: dict = at) -> Iterator[tuple[int, np.ndarray]]:
            for fold in which:
                if (layer, fold) not in at:
                    continue
                mean, spread, _ = scale[layer, fold]
                used = own != fold
                x = np.column_stack([(h[used] - mean) / spread, np.ones(used.sum())])
                z = x @ at[layer, fold]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = (np.logaddexp(0, z) - y[used] * z).sum()
                hessian = (x * (p * (1 - p))[:, None]).T @ x
                yield fold, np.concatenate([[loss], x.T @ (p - y[used]), hessian[upper]])

        for r in _summed(df, parts).groupBy("layer", "fold").applyInPandas(_solver(at, c), "layer int, fold int, loss double, step array<double>").collect():
            key, step = (r["layer"], r["fold"]), np.array(r["step"])
            if key in before and r["loss"] > before[key][2] * (1 + 1e-12) + 1e-12:
                theta, step, loss = before[key]
                before[key] = theta, step / 2, loss
            else:
                before[key] = now[key], step, r["loss"]
            theta, step, _ = before[key]
            now[key] = theta + step
            if np.abs(step).max() < tolerance:
                open_.discard(key)
        if not open_:
            break
    rows = []
    for (layer, fold), theta in sorted(now.items()):
        mean, spread, n = scale[layer, fold]
        w = theta[:d] / spread
        rows.append((int(layer), int(fold), w.tolist(), float(theta[d] - w @ mean), n))
    return df.sparkSession.createDataFrame(rows, schema)


def probe_curve(df: DataFrame, probes: DataFrame) -> DataFrame:
    """(layer, fitted, held_out): macro F1 of each layer's probe on the rows it was fitted on, and over the folds' probes on
    the rows that each did not see. One scan scores all; probes are broadcast, as they are layers * folds rows."""
    both = df.join(F.broadcast(probes.select(F.col("layer").alias("of_layer"), F.col("fold").alias("of_fold"), "w", "bias")), (F.col("layer") == F.col("of_layer")) & ((F.col("of_fold") == WHOLE) | (F.col("of_fold") == F.col("fold"))))
    scored = both.withColumn("p", (F.round(dot(F.col("h"), F.col("w")) + F.col("bias"), 9) > 0).cast("int")).withColumn("seen", F.col("of_fold") == WHOLE)
    table = confusion(scored, F.col("y"), F.col("p"), "layer", "seen").select("layer", "seen", macro_f1().alias("f"))
    return table.groupBy("layer").agg(F.round(F.max(F.when(F.col("seen"), F.col("f"))), 6).alias("fitted"), F.round(F.max(F.when(~F.col("seen"), F.col("f"))), 6).alias("held_out"))
