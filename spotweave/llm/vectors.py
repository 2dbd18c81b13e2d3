"""Embedding rows as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part.

    Left out are vectors that are null, zero, hold null or non-finite components, or have no id, and those of
    another length than most. An id that repeats takes part once, with the least of its vectors.
    """
    values = F.col(embedding).cast("array<double>")
    good = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), values.alias("embedding")
    )
    good = good.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    good = good.where(F.exists("embedding", lambda x: x != 0))
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if lengths:
        good = good.where(F.size("embedding") == lengths[0]["d"])
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as Arrow lists."""
    offsets = (np.arange(len(rows) + 1) * (rows.shape[1] if rows.ndim == 2 else 0)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))
