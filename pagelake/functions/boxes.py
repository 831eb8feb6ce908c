"""Box predicates and measures as column expressions; a box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in the columns prefix + x1 + suffix and so on."""
    return Box(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    return overlap_1d(a.x1, a.x2, b.x1, b.x2) * overlap_1d(a.y1, a.y2, b.y1, b.y2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is 0."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlaps(a: Box, b: Box, least: float = 0.2) -> Column:
    return iou(a, b) >= least


def fits(outer: Box, inner: Box) -> Column:
    """Full containment, whatever the order of corners."""
    low = lambda p, q: F.least(p, q)
    high = lambda p, q: F.greatest(p, q)
    return (
        (low(outer.x1, outer.x2) <= low(inner.x1, inner.x2))
        & (low(outer.y1, outer.y2) <= low(inner.y1, inner.y2))
        & (high(outer.x1, outer.x2) >= high(inner.x1, inner.x2))
        & (high(outer.y1, outer.y2) >= high(inner.y1, inner.y2))
    )


def mostly_in(outer: Box, inner: Box, least: float) -> Column:
    """The share of inner that lies in outer; false if outer is the smaller one or inner is empty."""
    big = (inner.area > 0) & (outer.area >= inner.area)
    return F.when(big, intersection(outer, inner) / inner.area >= least).otherwise(False)


def contained_side(a: Box, b: Box, least: float = 0.85) -> Column:
    """'a' or 'b', the smaller box, if at least that share of it lies in the other; else null."""
    small = F.least(a.area, b.area)
    inside = (small > 0) & (intersection(a, b) / F.nullif(small, F.lit(0)) >= least)
    return F.when(inside, F.when(a.area <= b.area, "a").otherwise("b"))


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def trunc(c: Column) -> Column:
    return c.cast("long")


def expand(b: Box, width_percent: float, height_percent: float, page_width: Column, page_height: Column) -> Box:
    """Half of the percentage on each side, whole pixels, clamped to the page; negative contracts."""
    dx, dy = trunc(b.width * width_percent / 200), trunc(b.height * height_percent / 200)
    zero = F.lit(0)
    return Box(F.greatest(b.x1 - dx, zero), F.greatest(b.y1 - dy, zero), F.least(b.x2 + dx, page_width), F.least(b.y2 + dy, page_height))


def shrink(b: Box, percent: float) -> Box:
    """About the centre, truncated; the box itself if nothing would be left."""
    keep = (1 - percent / 100) / 2
    new = Box(trunc(b.cx - b.width * keep), trunc(b.cy - b.height * keep), trunc(b.cx + b.width * keep), trunc(b.cy + b.height * keep))
    ok = (new.x2 > new.x1) & (new.y2 > new.y1)
    return Box(*(F.when(ok, n).otherwise(o) for n, o in zip((new.x1, new.y1, new.x2, new.y2), (b.x1, b.y1, b.x2, b.y2), strict=True)))


def near(a: Box, b: Box, pixels: float = 5) -> Column:
    """All four corners within so many pixels."""
    return (F.abs(a.x1 - b.x1) <= pixels) & (F.abs(a.y1 - b.y1) <= pixels) & (F.abs(a.x2 - b.x2) <= pixels) & (F.abs(a.y2 - b.y2) <= pixels)


def columns(b: Box, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in ((b.x1, "x1"), (b.y1, "y1"), (b.x2, "x2"), (b.y2, "y2"))]
