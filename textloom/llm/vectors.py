"""What the operators on vectors share: which vectors take part, and how Arrow lists become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(column: str) -> Column:
    return F.col(column).cast("array<double>")


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_width(column: pa.Array):
    """(width, row numbers, matrix) for each width of the lists."""
    widths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        yield int(w), rows, matrix(column.take(pa.array(rows)))
