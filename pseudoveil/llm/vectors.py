"""Vector columns as numpy matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 4096           # vectors handled at once inside a task


def vector_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id: long, vector: array<double>), resolved by position so that extra columns cannot clash."""
    return table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("vector"))


def matrix(column: pa.Array, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors of a list column that have exactly
    ``components`` entries, none of them null or non-finite."""
    if not components or not len(column):
        return np.empty(0, np.int64), np.empty((0, components))
    size = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == components)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def fixed_point(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as int64; values beyond 2**62 have no such integer here."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    if x.size and np.abs(x).max() >= 2.0 ** 62:
        raise ValueError("a vector component is too large for 64-bit fixed point")
    return x.astype(np.int64)


def batches_of(batches, size: int = BATCH):
    """Zero-copy slices of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
