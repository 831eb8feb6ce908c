"""Filters, projections and clusters over tables of boxes, keyed by page."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def clean_boxes(df: DataFrame, width: int, height: int, tol: int = 5) -> DataFrame:
    """Clamp to the page; drop boxes at most tol wide or high."""
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), F.lit(top)))
    b = df.withColumns({"x1": clamp("x1", width), "x2": clamp("x2", width), "y1": clamp("y1", height), "y2": clamp("y2", height)})
    return b.filter((F.col("x2") - F.col("x1") > tol) & (F.col("y2") - F.col("y1") > tol))


def split_detections(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Keep sure detections, whole pixels; kind is bubble or text by label."""
    kind = F.when(F.col("label") == 0, "bubble").when(F.col("label").isin(1, 2), "text")
    return df.filter(F.col("score") >= threshold).withColumns({c: F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")}).withColumn("kind", kind).filter("kind is not null")


def with_geometry(df: DataFrame) -> DataFrame:
    """Width, height, centre, area of at least 1, and the direction that the shape suggests."""
    b = B.box()
    return df.withColumns({"w": b.width, "h": b.height, "cx": b.cx, "cy": b.cy, "area": F.greatest(b.area, F.lit(1)), "direction": F.when(b.height > b.width, "ver_rtl").otherwise("hor_ltr")})


def usable_lines(lines: DataFrame, page_area: float) -> DataFrame:
    b = B.box()
    return lines.filter((b.width > 3) & (b.height > 3) & (b.area < 0.75 * page_area))


def drop_noise_lines(lines: DataFrame, vertical: Column) -> DataFrame:
    """Too thin across the reading direction, or thin and short."""
    b = B.box()
    across, along = F.when(vertical, b.width).otherwise(b.height), F.when(vertical, b.height).otherwise(b.width)
    return lines.filter(~((across < 3) | ((across < 5) & (along < 36))))


def pad_boxes(df: DataFrame, width: int, height: int, pad: int = 32) -> DataFrame:
    b = B.box()
    padded = B.Box(F.greatest(b.x1 - pad, F.lit(0)), F.greatest(b.y1 - pad, F.lit(0)), F.least(b.x2 + pad, F.lit(width)), F.least(b.y2 + pad, F.lit(height)))
    return df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), (padded.x1, padded.y1, padded.x2, padded.y2), strict=True)))


def resize_blocks(df: DataFrame, diff: int) -> DataFrame:
    return df.withColumns({"x1": F.col("x1") - diff, "y1": F.col("y1") - diff, "x2": F.col("x2") + diff, "y2": F.col("y2") + diff})


def request_regions(df: DataFrame, width: int, height: int) -> DataFrame:
    """The bubble if there is one, else the box 5 % larger; clamped, valid, numbered in block order."""
    own = B.expand(B.box(), 5, 5, F.lit(width), F.lit(height))
    pick = lambda c, o: F.coalesce(F.col(f"bubble_{c}"), o)
    r = df.select("page_id", "det_idx", pick("x1", own.x1).alias("x1"), pick("y1", own.y1).alias("y1"), pick("x2", own.x2).alias("x2"), pick("y2", own.y2).alias("y2"))
    r = clean_boxes(r, width, height, tol=0)
    return r.withColumn("request_no", F.row_number().over(Window.partitionBy("page_id").orderBy("det_idx")))


def gaps_and_islands(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Number the islands of rows in order: starts is true where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("island", F.sum("__new").over(w) - 1).drop("__new")


def group_lines(df: DataFrame, band: float = 0.5) -> DataFrame:
    """Reading lines of a page: boxes whose centres chain within band times the median height share a line."""
    w = Window.partitionBy("page_id").orderBy("cy", "det_idx")
    d = df.withColumn("cy", B.box().cy)
    d = d.withColumn("median_h", F.percentile(F.col("y2") - F.col("y1"), 0.5).over(Window.partitionBy("page_id")))
    d = d.withColumn("gap", F.col("cy") - F.lag("cy").over(w))
    d = gaps_and_islands(d, ["page_id"], ["cy", "det_idx"], F.col("gap") > F.col("median_h") * band)
    return d.withColumnRenamed("island", "line").drop("gap")


def line_hulls(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page_id", "line").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def rect_order(df: DataFrame) -> DataFrame:
    """Reading order: by line, then left to right."""
    lines = group_lines(df)
    return lines.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("line", "x1", "det_idx")))


def sort_lines(lines: DataFrame, vertical: Column) -> DataFrame:
    """Lines of a block: horizontal by (y, x), vertical by (-x, y)."""
    first, second = F.when(vertical, -F.col("x1")).otherwise(F.col("y1")), F.when(vertical, F.col("y1")).otherwise(F.col("x1"))
    w = Window.partitionBy("page_id", "block_idx").orderBy(first, second, "line_idx")
    return lines.withColumn("rank", F.row_number().over(w))


def segments_by_x(rows: DataFrame) -> DataFrame:
    """Cut rows (page_id, line) where the blank after the running right edge is over max(12, 0.85 median height)."""
    w = Window.partitionBy("page_id", "line").orderBy("x1", "det_idx")
    d = rows.withColumn("right", F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("limit", F.greatest(F.lit(12.0), 0.85 * F.percentile(F.col("y2") - F.col("y1"), 0.5).over(Window.partitionBy("page_id", "line"))))
    d = gaps_and_islands(d, ["page_id", "line"], ["x1", "det_idx"], F.col("x1") - F.col("right") - 1 > F.col("limit"))
    return d.withColumnRenamed("island", "segment").drop("right", "limit")


def drop_nested(df: DataFrame, wider: float = 1.0, higher: float = 1.0, across: float = 0.85, down: float = 0.85) -> DataFrame:
    """Drop boxes covered by those shares, in pixels, by another box at least so many times as wide and high.

    The defaults are for columns in columns; (1.75, 1.1, 0.7, 0.85) for narrow
    lines beside a wide one. Numbers are compared as written, in decimals: as
    doubles 1.1 times 50 pixels is more than 55.
    """
    from .joins import meeting

    wider, higher, across, down = (F.lit(Decimal(str(v))) for v in (wider, higher, across, down))

    pixels = lambda b: (F.greatest(b.width + 1, F.lit(1)), F.greatest(b.height + 1, F.lit(1)))
    a, b = B.box(), B.box("o_")
    (aw, ah), (bw, bh) = pixels(a), pixels(b)
    shared = lambda p1, p2, q1, q2: F.least(p2, q2) - F.greatest(p1, q1) + 1
    covered = (shared(a.x1, a.x2, b.x1, b.x2) >= across * aw) & (shared(a.y1, a.y2, b.y1, b.y2) >= down * ah)
    own = df.select("page_id", "det_idx", "x1", "y1", "x2", "y2")
    other = df.select("page_id", F.col("det_idx").alias("o_idx"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    nested = meeting(own, other, ["page_id"], "y1", "y2", "o_").filter((F.col("det_idx") != F.col("o_idx")) & (bw >= wider * aw) & (bh >= higher * ah) & covered)
    return df.join(nested.select("page_id", "det_idx").distinct(), ["page_id", "det_idx"], "left_anti")


def direction_from_lines(lines: DataFrame, blocks: DataFrame, lang: Column | None = None) -> DataFrame:
    """vertical or horizontal, by the shapes of a block's lines: one side must outweigh the other by 1.15 and 0.2.

    Else by the block: vertical if over 1.25 times as high as wide. With lang
    by the hull of the lines (the block without any): 1.15 times, or for a
    nearly square one in Japanese or Chinese from 0.9 on; Korean is horizontal.
    """
    b = B.box()
    w, h = F.greatest(b.width, F.lit(1)).cast("double"), F.greatest(b.height, F.lit(1)).cast("double")
    hull = [f(c).alias(f"l{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]
    sums = lines.groupBy("page_id", "block_idx").agg(F.sum(F.greatest(w / h - 1, F.lit(0.0))).alias("wide"), F.sum(F.greatest(h / w - 1, F.lit(0.0))).alias("tall"), *hull)
    d = blocks.join(sums, ["page_id", "block_idx"], "left")
    vertical = h > 1.25 * w
    if lang is not None:
        at = B.Box(*(F.coalesce(f"l{c}", c) for c in ("x1", "y1", "x2", "y2")))
        w, h = F.greatest(at.width, F.lit(1)).cast("double"), F.greatest(at.height, F.lit(1)).cast("double")
        name = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
        square = (name.isin("ja", "japanese", "zh", "ch") | name.startswith("zh-") | name.contains("chinese")) & (h / w).between(0.85, 1.15)
        vertical = F.when(name.isin("ko", "korean"), F.lit(False)).when(square, h >= 0.9 * w).otherwise(h > 1.15 * w)
    by_lines = F.when(F.col("tall") > 1.15 * F.col("wide") + 0.2, "vertical").when(F.col("wide") > 1.15 * F.col("tall") + 0.2, "horizontal")
    return d.withColumn("direction", F.coalesce(by_lines, F.when(vertical, "vertical").otherwise("horizontal"))).select("page_id", "block_idx", "direction")
