"""Vector expressions (JVM side): products are summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(left: Column | str, right: Column | str) -> Column:
    """Sum of products of two arrays of equal length."""
    products = F.zip_with(
        _col(left), _col(right), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2norm(vector: Column | str) -> Column:
    squares = F.transform(_col(vector), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def normalize(vector: Column | str) -> Column:
    """Unit vector in single precision; a zero vector is returned as it is."""
    column = _col(vector)
    norm = l2norm(column)
    return F.when(norm <= 0, column.cast("array<float>")).otherwise(
        F.transform(column, lambda x: (x.cast("double") / norm).cast("float"))
    )


def cosine(left: Column | str, right: Column | str, mode: str = "raw") -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors.

    ``mode``: ``raw`` as computed, ``unit`` clamped to [0, 1], ``signed``
    clamped to [-1, 1], ``dot`` the plain product (inputs already unit).
    """
    a, b = _col(left), _col(right)
    comparable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    if mode == "dot":
        return F.when(comparable, dot(a, b)).otherwise(F.lit(0.0))
    norms = l2norm(a) * l2norm(b)
    value = F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
    if mode == "unit":
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    elif mode == "signed":
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    elif mode != "raw":
        raise ValueError(f"unknown cosine mode {mode!r}")
    return F.when(comparable, value).otherwise(F.lit(0.0))
