"""Arrow columns of vectors as matrices, for what runs in numpy within tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists of doubles."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, known): the vectors of a column, of one length; ``known`` tells which aren't null. A null component is NaN, a null vector all zeros.

    Vectors of several lengths are an error, as no distance between them is meant.
    """
    known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)[known]
    values = column.flatten()
    values = values.to_numpy(zero_copy_only=False) if not values.null_count else values.cast(pa.float64()).fill_null(float("nan")).to_numpy()
    width = int(sizes[0]) if len(sizes) else 0
    if (sizes != width).any():
        raise ValueError("vectors differ in length")
    if known.all():
        return values.reshape(len(column), width), known
    out = np.zeros((len(column), width), values.dtype)
    out[known] = values.reshape(int(known.sum()), width)
    return out, known


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, their places): the vectors of a column that are neither null nor hold a null, a NaN or an infinity."""
    x, known = matrix(column)
    fine = known & np.isfinite(x).all(axis=1)
    return (x, np.arange(len(x))) if fine.all() else (x[fine], np.flatnonzero(fine))
