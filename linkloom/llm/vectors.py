"""What the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite and not null, and not all of them 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def row_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed in the same way for every row."""
    return (left * right).sum(axis=1)


def doubles(vector: str) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))
