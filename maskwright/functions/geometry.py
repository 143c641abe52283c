"""Box arithmetic on (x, y, w, h) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")  # type: ignore[return-value]


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return _share(both, a[2] * a[3] + b[2] * b[3] - both)


def containment(inner: Box, outer: Box) -> Column:
    """Share of `inner` that lies in `outer`."""
    return _share(intersection(inner, outer), inner[2] * inner[3])


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def rescale(x: Column, frame: Column, css: Column) -> Column:
    return x.cast("double") * css / frame
