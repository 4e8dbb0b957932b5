"""What the operators on vectors share: rows that count, and their entries as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest vectors that the operators take: a square of this side, in doubles, is 128 MB.
MOST_DIMENSIONS = 4096


def countable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector isn't null or empty and holds finite numbers only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(F.forall(column, fine))


def dimension(rows: DataFrame, column: str) -> int:
    """The commonest length of vectors, the greater of equally common ones; 0 without rows. One row reaches the driver."""
    top = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top and top.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {top.d} entries; {MOST_DIMENSIONS} at most")
    return top.d if top else 0


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` numbers as rows of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), d)
