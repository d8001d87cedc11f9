"""Vectors as Spark columns and as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    d = v.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(d, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """[row, component] in double precision, of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
