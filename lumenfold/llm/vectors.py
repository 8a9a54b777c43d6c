"""Vector tables: validity, classes of equal vectors, conversion to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the rows that take part, as doubles. Null ids and dimensions other than the commonest take none."""
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))
