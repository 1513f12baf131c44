"""Vector columns as numpy matrices, and which vectors take part in a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector has components, all of them finite numbers, and not all zero."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~odd & F.exists(column, lambda x: x != 0)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """(id, vector as doubles, others): usable vectors; of rows with one id the smallest counts, a null id never."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    row = F.struct(F.col(vector_col).cast("array<double>").alias("vector"), *others)
    out = rows.where(usable(vector_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(row).alias("row"))
    return out.select("id", "row.*")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
