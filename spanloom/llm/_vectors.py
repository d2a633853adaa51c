"""Vectors of a table's list column as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vector: str) -> int:
    """The length of most vectors, the larger one if two are as frequent; 1 if there is none."""
    top = df.select(F.size(vector).alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 1


def usable(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of length d whose entries are all finite, and those vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == d)
    if not len(at):
        return at, np.zeros((0, d))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # null entries are NaN
    finite = np.isfinite(x).all(1)
    return at[finite], x[finite]


def as_lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose vectors all have length d and no null, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
