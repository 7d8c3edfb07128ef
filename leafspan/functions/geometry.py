"""Geometry of boxes as Column expressions. A box is four columns with a common prefix: {p}x0, {p}y0, {p}x1, {p}y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(p: str, side: str) -> Column:
    return F.col(f"{p}{side}")


def width(p: str = "") -> Column:
    return _c(p, "x1") - _c(p, "x0")


def height(p: str = "") -> Column:
    return _c(p, "y1") - _c(p, "y0")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def center_x(p: str = "") -> Column:
    return (_c(p, "x0") + _c(p, "x1")) / 2


def center_y(p: str = "") -> Column:
    return (_c(p, "y0") + _c(p, "y1")) / 2


def contains(p: str, x: Column, y: Column) -> Column:
    """Whether a point lies in the closed box."""
    return x.between(_c(p, "x0"), _c(p, "x1")) & y.between(_c(p, "y0"), _c(p, "y1"))


def _overlap(a: str, b: str, axis: str) -> Column:
    return F.least(_c(a, f"{axis}1"), _c(b, f"{axis}1")) - F.greatest(_c(a, f"{axis}0"), _c(b, f"{axis}0"))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where boxes touch at most, or the union is empty."""
    w, h = _overlap(a, b, "x"), _overlap(a, b, "y")
    union = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)


def gap(a: str, b: str, axis: str) -> Column:
    """Distance of two boxes on an axis, 0 where they overlap."""
    return F.greatest(-_overlap(a, b, axis), F.lit(0.0))


def overlap_ratio(a: str, b: str, axis: str) -> Column:
    """Overlap on an axis as a share of the smaller extent; 0 if that is not positive."""
    smaller = F.least(_c(a, f"{axis}1") - _c(a, f"{axis}0"), _c(b, f"{axis}1") - _c(b, f"{axis}0"))
    return F.when(smaller > 0, F.greatest(_overlap(a, b, axis), F.lit(0.0)) / smaller).otherwise(0.0)


def center_distance(a: str, b: str) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def same_line(a: str, b: str, most: float = 20.0) -> Column:
    """Whether boxes overlap vertically or their centers stand less than ``most`` apart."""
    return (_overlap(a, b, "y") > 0) | (F.abs(center_y(a) - center_y(b)) < most)


def scaled(p: str, sx, sy) -> list[Column]:
    """The box times a factor per axis (pixels to points, shares to points, canvas to page)."""
    return [(_c(p, f"{axis}{i}") * s).alias(f"{axis}{i}") for i in (0, 1) for axis, s in (("x", sx), ("y", sy))]


def rotated_back(angle: Column, page_width: Column, page_height: Column, p: str = "") -> list[Column]:
    """The box in the page's own space after the page was turned by ``angle`` (0, 90, 180 or 270 degrees); other angles raise.

    ``page_width`` and ``page_height`` are those of the unturned page.
    """
    x0, y0, x1, y1 = (_c(p, s) for s in ("x0", "y0", "x1", "y1"))
    by = {0: (x0, y0, x1, y1), 90: (page_width - y1, x0, page_width - y0, x1), 180: (page_width - x1, page_height - y1, page_width - x0, page_height - y0), 270: (y0, page_height - x1, y1, page_height - x0)}
    bad = F.raise_error(F.concat(F.lit("rotation must be 0, 90, 180 or 270, not "), angle.cast("string"))).cast("double")
    out = []
    for i, name in enumerate(("x0", "y0", "x1", "y1")):
        e = F.when(angle == 0, by[0][i])
        for a in (90, 180, 270):
            e = e.when(angle == a, by[a][i])
        out.append(e.otherwise(bad).alias(name))
    return out


def adjusted_confidence(confidence: Column, adjustment: Column) -> Column:
    """Confidence moved by an engine's adjustment, held within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence + adjustment))
