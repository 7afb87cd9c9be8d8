"""Bounding-box expressions over ``struct<x1, y1, x2, y2>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    parts = [c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))]
    return F.struct(*parts)


def width(b: Column | str) -> Column:
    b = _box(b)
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column | str) -> Column:
    b = _box(b)
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column | str) -> Column:
    return width(b) * height(b)


def center_x(b: Column | str) -> Column:
    return _box(b)["x1"] + width(b) / 2


def center_y(b: Column | str) -> Column:
    return _box(b)["y1"] + height(b) / 2


def iou(left: Column | str, right: Column | str) -> Column:
    a, b = _box(left), _box(right)
    overlap_w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    overlap_h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    overlap = overlap_w * overlap_h
    union = area(a) + area(b) - overlap
    return F.when((overlap <= 0) | (union <= 0), F.lit(0.0)).otherwise(overlap / union)


def scaled_area(b: Column | str) -> Column:
    """Area on one scale: fractions of a frame become parts of 100 x 100."""
    value = area(b)
    return F.when(value <= 1.0, value * 10000.0).otherwise(value)


def is_normalized(b: Column | str) -> Column:
    """Corners are fractions of the frame."""
    b = _box(b)
    slack = F.lit(1.000001)
    return (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= slack) & (b["y2"] <= slack)


def repair(b: Column | str) -> Column:
    """Where the far corner is not beyond the near one, take it as a size."""
    b = _box(b)
    zero = F.lit(0.0)

    def far(near: Column, value: Column) -> Column:
        return F.when(value > near, value).otherwise(near + F.greatest(value, zero))

    return box(b["x1"], b["y1"], far(b["x1"], b["x2"]), far(b["y1"], b["y2"]))


def plausible_aspect(b: Column | str) -> Column:
    """Width to height between 0.45 and 1.8, corners in any order."""
    b = _box(b)
    w, h = F.abs(b["x2"] - b["x1"]), F.abs(b["y2"] - b["y1"])
    ratio = F.when((w > 0) & (h > 0), w / h)
    return F.coalesce(ratio.between(0.45, 1.8), F.lit(False))
