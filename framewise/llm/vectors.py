"""Vector columns as both vector operators take them."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold finite numbers only."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample(df: DataFrame, id_col: str, vector_col: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, chosen by a hash of their id, in a fixed order."""
    found = (
        df.select(F.col(vector_col).alias("v"), F.xxhash64(id_col).alias("h"))
        .orderBy("h").limit(rows).toArrow()
    )
    return matrix(found["v"]) if found.num_rows else np.zeros((0, 0))


def one_width(df: DataFrame, vector_col: str) -> Any:
    """Length of the vectors; vectors of several lengths are an error."""
    row = df.agg(F.min(F.size(vector_col)).alias("a"), F.max(F.size(vector_col)).alias("b")).first()
    if row.a != row.b:
        raise ValueError(f"vectors of {row.a} to {row.b} numbers in one table")
    return row.a
