"""Vectors as whole numbers: floor(256 * component)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vec: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    return F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vec: Column) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE))


def longest(rows: DataFrame) -> int:
    """Components of the longest x of ``rows``."""
    return rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of longs as rows of ``dim`` columns; shorter ones end in zeros."""
    out = np.zeros((len(column), dim), np.int64)
    sizes = np.diff(np.asarray(column.offsets))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out
