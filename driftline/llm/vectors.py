"""Vectors of a table as matrices of whole numbers inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 25  # of a scaled entry; squares of differences and their sums over 64 entries then fit in a long


def sound(vector: Column) -> Column:
    """Whether a vector is there and none of its entries is null or not finite."""
    unsound = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(unsound, F.lit(False))


def sound_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(_id, _v)`` with ``_v`` in doubles, of the rows with a sound vector."""
    doubles = F.col(vector_column).cast("array<double>")
    return table.select(F.col(id_column).alias("_id"), doubles.alias("_v")).filter(sound(F.col("_v")))


def floors(lists: pa.ListArray, scale: int, dims: int) -> np.ndarray:
    """``floor(scale * x)`` of vectors with ``dims`` entries each, as a matrix of int64."""
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"an entry exceeds {LARGEST / scale}, so squared distances may not fit in a long")
    return scaled.astype(np.int64)


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as one list per row."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))
