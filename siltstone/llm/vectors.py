"""Embeddings as matrices of integers, for operators whose results must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, sums of products are exact in floating point.
FLOAT_EXACT = 2.0**53


def finite(c: str) -> Column:
    """Neither the vector nor a component is null, infinite or not a number."""
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as integers; an error beyond `limit`, where results would not fit a long."""
    out = np.floor(scale * x.astype(np.float64))
    if out.size and np.abs(out).max() > limit:
        raise OverflowError(f"components of over {limit / scale:g} give results that do not fit a long")
    return out.astype(np.int64)


def components(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start, end) of a list column; rows that are null or hold a null or
    non-finite component have end -1."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    start, end = offsets[:-1], offsets[1:].copy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    wrong = bad[end] > bad[start]
    if column.null_count:
        wrong |= ~column.is_valid().to_numpy(zero_copy_only=False)
    end[wrong] = -1
    return values, start, end


def rows_of(column: pa.ListArray, dims: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows with exactly `dims` good components, their integers as a matrix)."""
    values, start, end = components(column)
    rows = np.flatnonzero(end - start == dims)
    at = start[rows][:, None] + np.arange(dims)
    return rows, whole(values[at], scale, limit)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where that is exact, else by integers."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < FLOAT_EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2.0**63 - 1:
        raise OverflowError("inner products do not fit a long")
    return a @ b.T
