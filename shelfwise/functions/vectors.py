"""Dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(a)
    return F.transform(
        _doubles(a), lambda x: F.when(length == 0.0, x).otherwise(x / length)
    )


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two columns of one row; 0 when either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def truncate(a: Column | str, dims: int) -> Column:
    return F.slice(a, 1, dims)


def to_wide(a: str, dims: int, prefix: str = "embed_") -> list[Column]:
    """One column per dimension, for an export."""
    return [F.col(a)[i].alias(f"{prefix}{i}") for i in range(dims)]


def from_wide(dims: int, prefix: str = "embed_") -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(dims)])


def to_text(a: Column | str) -> Column:
    return F.to_json(a)


def from_text(c: Column | str) -> Column:
    return F.from_json(c, "array<double>")
