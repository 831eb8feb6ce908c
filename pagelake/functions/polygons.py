"""Polygons: arrays of points (x, y), clockwise from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box


def axis_box(poly: Column) -> Box:
    low = lambda k: F.array_min(F.transform(poly, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(poly, lambda p: p[k]))
    return Box(low("x"), low("y"), high("x"), high("y"))


def poly_angle(poly: Column) -> Column:
    """Of the mean of top and bottom edge, in degrees from 0 to 360."""
    dx = (poly[1]["x"] - poly[0]["x"] + poly[2]["x"] - poly[3]["x"]) / 2
    dy = (poly[1]["y"] - poly[0]["y"] + poly[2]["y"] - poly[3]["y"]) / 2
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 360, F.lit(360.0))
