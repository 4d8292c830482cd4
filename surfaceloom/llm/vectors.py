"""Vectors out of Arrow lists, with what is no proper vector told apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proper(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` finite components, and those vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
    rows = np.flatnonzero(size == width)
    x = flat[start[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    good = np.isfinite(x).all(1)  # a null component is NaN here
    return rows[good], x[good]


def width(df: DataFrame, column: str = "embedding") -> int:
    """The commonest number of components (the smaller of two as common); 0 without vectors."""
    got = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got.n if got else 0
