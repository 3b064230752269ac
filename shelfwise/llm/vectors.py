"""What the vector operators share: which vectors count, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


MOST = 2**56  # of an inner product: a hundred times that fits a long


def usable(c: str) -> Column:
    """Not null, and no component that is null or not finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~F.coalesce(bad, F.lit(False))


def padded(rows: list, dtype) -> np.ndarray:
    """A matrix of the rows; a shorter one counts as having zeros at its end."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def floored(column: pa.Array, scale: float, width: int, most: float = 2.0**53) -> np.ndarray:
    """floor(scale * x) of a column of vectors, as whole numbers, filled up with zeros to ``width``.

    Components beyond ``most`` are cut back to it.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        x = flat.reshape(len(column), width)
    else:
        x = np.zeros((len(column), width))
        for i, r in enumerate(column.to_pylist()):
            x[i, : len(r)] = r
    return np.clip(np.floor(scale * x), -most, most).astype(np.int64)


def compact(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest integers that hold them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, by floats where their sums stay exact.

    A product beyond ``MOST`` is cut back to it.
    """
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if reach < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)
