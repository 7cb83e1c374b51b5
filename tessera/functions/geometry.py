"""Rectangle arithmetic on columns x1, y1, x2, y2 of aliased rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def area(a: str = "") -> Column:
    """Area, 0 for inverted rectangles."""
    return F.greatest(F.lit(0.0), col(a, "x2") - col(a, "x1")) * F.greatest(F.lit(0.0), col(a, "y2") - col(a, "y1"))


def centre(a: str = "") -> tuple[Column, Column]:
    return (col(a, "x1") + col(a, "x2")) / 2, (col(a, "y1") + col(a, "y2")) / 2


def intersection(a: str, b: str) -> Column:
    """Area in common."""
    w = F.least(col(a, "x2"), col(b, "x2")) - F.greatest(col(a, "x1"), col(b, "x1"))
    h = F.least(col(a, "y2"), col(b, "y2")) - F.greatest(col(a, "y1"), col(b, "y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str) -> Column:
    """Intersection over union."""
    common = intersection(a, b)
    return F.when(common > 1e-9, common / F.greatest(area(a) + area(b) - common, F.lit(1e-9))).otherwise(0.0)


def ioa(a: str, b: str) -> Column:
    """Share of the first rectangle that lies in the second."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def containment(a: str, b: str) -> Column:
    """Share of the smaller rectangle that lies in the other."""
    common = intersection(a, b)
    return F.when(common > 1e-9, common / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))).otherwise(0.0)


def holds_centre(cell: str, box: str) -> Column:
    """The cell, edges included, holds the centre of the box."""
    x, y = centre(box)
    return x.between(col(cell, "x1"), col(cell, "x2")) & y.between(col(cell, "y1"), col(cell, "y2"))


def distance2(cell: str, box: str) -> Column:
    """Squared distance of the box's centre to the cell, 0 inside."""
    x, y = centre(box)
    dx = F.greatest(F.lit(0.0), col(cell, "x1") - x, x - col(cell, "x2"))
    dy = F.greatest(F.lit(0.0), col(cell, "y1") - y, y - col(cell, "y2"))
    return dx * dx + dy * dy
