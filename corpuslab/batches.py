"""Arrow batches of token lists: cut to bounded size, and counted by word with Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items of lists, or bytes of texts, that a task turns into Python objects at a time.
ITEMS = 100_000


def cut(batches: Iterator[pa.RecordBatch], column: str, most: int = ITEMS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` items (a list column's) or bytes (a text column's) each; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes + 1) // most
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, z - a)


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of a list column: the row of each item, and the items; null lists have none, null items are left out."""
    rows = pc.list_parent_indices(column).to_numpy()
    items = pc.list_flatten(column)
    if items.null_count:
        rows, items = rows[items.is_valid().to_numpy(zero_copy_only=False)], items.drop_null()
    return rows, items


def lists(rows: np.ndarray, n: int, *values: pa.Array) -> list[pa.ListArray]:
    """List columns of ``n`` rows from values and their rows, which ascend."""
    offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, word, n) of a list column's distinct words by row, and the words that the numbers stand for."""
    rows, items = flat(column)
    coded = items.dictionary_encode()
    known = coded.dictionary
    size = max(len(known), 1)
    keys, n = np.unique(rows.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
    return keys // size, keys % size, n, known
