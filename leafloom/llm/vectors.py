"""Which vectors take part, and arrays of them for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): repeated rows of an id are one vector; of differing ones the first in array order stands. Ids that are null are left out."""
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, without nulls, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def same_length(column: pa.Array) -> list[tuple[int, int]]:
    """[from, to) of runs of rows with vectors of one length."""
    n = np.asarray(column.value_lengths())
    if not len(n):
        return []
    edge = np.concatenate(([0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))
