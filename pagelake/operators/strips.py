"""Tall strips: pages stacked into one scene, slices of tall pages, seams between slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J
from . import paged


def strip_layout(pages: DataFrame, start: int = 100, gap: int = 0) -> DataFrame:
    """top, bottom and total height of the strip: pages follow each other from start."""
    by = Window.partitionBy("chapter_id")
    before = F.coalesce(F.sum(F.col("height") + gap).over(by.orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = pages.withColumn("top", (before + start).cast("long")).withColumn("bottom", F.col("top") + F.col("height"))
    return d.withColumn("total", F.max("bottom").over(by))


def relayout(layout: DataFrame, sizes: DataFrame) -> DataFrame:
    """Real heights arrive: pages after them move by the differences so far."""
    d = layout.join(sizes.select("page_id", "real_height"), "page_id", "left")
    delta = F.coalesce("real_height", "height") - F.col("height")
    w = Window.partitionBy("chapter_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("shift", F.coalesce(F.sum(delta).over(w), F.lit(0)))
    return d.select("chapter_id", "page_id", "page_no", (F.col("top") + F.col("shift")).alias("top"), F.coalesce("real_height", "height").alias("height"))


def estimate_layout(pages: DataFrame, first: int = 3) -> DataFrame:
    few = pages.filter(F.col("page_no") < first)
    return few.groupBy("chapter_id").agg(F.floor(F.avg("width")).alias("width"), F.floor(F.avg("height")).alias("height"))


def virtual_pages(pages: DataFrame, low: int = 2000, high: int = 3500, target: int = 2400) -> DataFrame:
    """Tall pages in near equal slices.

    Of the numbers of slices whose height stays in bounds the one nearest to
    the target is taken, the smaller on ties; if none does, the one that leaves
    the bounds least. The first rest of the division are a pixel higher.
    """
    h = F.col("height")

    def rate(k: Column) -> Column:
        each = h / k
        outside = F.greatest(F.lit(0.0), low - each, each - high)
        return F.struct(outside.alias("outside"), F.abs(each - target).alias("off"), k.alias("k"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(h / low), F.lit(1)).cast("int")), rate))["k"]
    d = pages.withColumn("k", F.when(h <= high, F.lit(1)).otherwise(best).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    base, rest = F.floor(h / F.col("k")), h % F.col("k")
    top = F.col("i") * base + F.least("i", rest)
    return d.select("chapter_id", "page_id", "page_no", F.col("i").alias("virtual_index"), top.alias("crop_top"), (top + base + (F.col("i") < rest).cast("long")).alias("crop_bottom"))


def _cut(ratio: float, share: float) -> tuple[Column, Column, Column, Column]:
    """Whether a page is cut, a slice's height, the step from one to the next, and the number of the last one."""
    w, h = F.col("width"), F.col("height")
    tall, size = h / w > ratio, 3 * F.col("width")
    step = F.floor(size * (1 - share)).cast("long")
    return tall, size, step, F.when(tall, F.ceil(F.greatest(h - size, F.lit(0)) / step)).otherwise(0).cast("long")


def overlap_slices(pages: DataFrame, ratio: float = 3.5, share: float = 0.2, *keep: str) -> DataFrame:
    """Pages over the ratio in slices three widths high that overlap by a fifth; the last goes to the end. keep: columns of pages."""
    tall, size, step, n = _cut(ratio, share)
    d = pages.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("last", n)
    start = F.col("slice") * step
    return d.select("page_id", *keep, "slice", start.alias("start_y"), F.when(~tall | (F.col("slice") == F.col("last")), F.col("height")).otherwise(start + size).alias("end_y"))


def whole_pages(boxes: DataFrame, pages: DataFrame, ratio: float = 3.5, share: float = 0.2) -> DataFrame:
    """Boxes of overlap_slices in their pages, with page_height; a slice's place follows from its number and the page's size."""
    _, _, step, n = _cut(ratio, share)
    start = F.col("slice") * step
    d = boxes.join(pages.select("page_id", "width", "height"), "page_id").filter(F.col("slice").between(0, n))
    return d.withColumns({"y1": F.col("y1") + start, "y2": F.col("y2") + start}).drop("width").withColumnRenamed("height", "page_height")


def unslice(boxes: DataFrame, slices: DataFrame) -> DataFrame:
    return boxes.join(slices.select("page_id", "slice", "start_y"), ["page_id", "slice"]).withColumns({"y1": F.col("y1") + F.col("start_y"), "y2": F.col("y2") + F.col("start_y")}).drop("start_y")


def seam_pairs(vpages: DataFrame, pages: DataFrame) -> DataFrame:
    """Each slice with the next of its page, or the first of the next page; none of a skipped page."""
    v = vpages.join(pages.select("page_id", "skip"), "page_id")
    w = Window.partitionBy("chapter_id").orderBy("page_no", "virtual_index")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("page_id", "virtual_index", "skip", "page_no")}
    d = v.withColumns(nxt).filter("next_page_id is not null and not skip and not next_skip and next_page_no - page_no <= 1")
    return d.select("chapter_id", "page_id", "virtual_index", "next_page_id", "next_virtual_index")


def to_scene(df: DataFrame, layout: DataFrame, strip_width: int) -> DataFrame:
    """Page to strip coordinates: centred across, moved down by the page's offset."""
    d = df.join(layout.select("page_id", "width", "top"), "page_id")
    dx = F.floor((strip_width - F.col("width")) / 2)
    return d.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + F.col("top"), "y2": F.col("y2") + F.col("top")}).drop("width", "top")


def to_local(df: DataFrame, layout: DataFrame, strip_width: int) -> DataFrame:
    d = df.join(layout.select("page_id", "width", "top"), "page_id")
    dx = F.floor((strip_width - F.col("width")) / 2)
    return d.withColumns({"x1": F.col("x1") - dx, "x2": F.col("x2") - dx, "y1": F.col("y1") - F.col("top"), "y2": F.col("y2") - F.col("top")}).drop("width", "top")


def to_physical(df: DataFrame, vpages: DataFrame) -> DataFrame:
    d = df.join(vpages.select("page_id", "virtual_index", "crop_top"), ["page_id", "virtual_index"])
    return d.withColumns({"y1": F.col("y1") + F.col("crop_top"), "y2": F.col("y2") + F.col("crop_top")}).drop("crop_top")


def _view_keys(df: DataFrame) -> list[str]:
    return ["chapter_id", *(["view_id"] if "view_id" in df.columns else [])]


def view_mappings(layout: DataFrame, views: DataFrame, buffer: int = 0) -> DataFrame:
    """Pages in a view, with the cut of each and its place in the combined image.

    views: chapter_id, view_top, view_bottom and, if a chapter has several,
    view_id, which goes on into the mappings. Pages meet views by bands of
    height.
    """
    low, high = F.col("view_top") - buffer, F.col("view_bottom") + buffer
    keys = _view_keys(views)
    v = views.select(*keys, low.alias("v_top"), high.alias("v_bottom"))
    met = J.meeting(layout.withColumn("bottom", F.col("top") + F.col("height")), v, ["chapter_id"], "top", "bottom", "v_", size=4096)
    d = met.filter((F.col("top") < F.col("v_bottom")) & (F.col("bottom") > F.col("v_top")))
    d = d.withColumns({"crop_top": F.greatest("v_top", "top") - F.col("top"), "crop_bottom": F.least("v_bottom", "bottom") - F.col("top")})
    size = F.col("crop_bottom") - F.col("crop_top")
    w = Window.partitionBy(*keys, "v_top", "v_bottom").orderBy("page_no")
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select(*keys, "page_id", "page_no", "top", "crop_top", "crop_bottom", start.alias("combined_start"), (start + size).alias("combined_end"))


def visible_blocks(blocks: DataFrame, mappings: DataFrame) -> DataFrame:
    """Blocks in view, by the first mapping of a view that they meet, in combined-image coordinates."""
    keys = _view_keys(mappings)
    m = mappings.select(*keys, "page_no", (F.col("top") + F.col("crop_top")).alias("m_y1"), (F.col("top") + F.col("crop_bottom")).alias("m_y2"), "combined_start")
    hit = J.meeting(blocks, m, ["chapter_id"], "y1", "y2", "m_", size=4096).filter((F.col("y1") < F.col("m_y2")) & (F.col("y2") > F.col("m_y1")))
    first = hit.groupBy(*keys, "block_idx").agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "m_y1", "combined_start", "page_no"), "page_no").alias("s"))
    shift = F.col("s.combined_start") - F.col("s.m_y1")
    return first.select(*keys, "block_idx", F.col("s.page_no").alias("page_no"), F.col("s.x1").alias("x1"), (F.col("s.y1") + shift).alias("y1"), F.col("s.x2").alias("x2"), (F.col("s.y2") + shift).alias("y2"))


def combined_to_scene(boxes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Combined-image boxes back to the strip, by the mapping that holds their top edge; with view_id in the mappings the boxes have it too."""
    keys = _view_keys(mappings)
    m = mappings.select(*keys, F.col("combined_start").alias("m_y1"), F.col("combined_end").alias("m_y2"), (F.col("top") + F.col("crop_top") - F.col("combined_start")).alias("shift"))
    d = J.meeting(boxes, m, keys, "y1", "y2", "m_", size=4096).filter((F.col("y1") >= F.col("m_y1")) & (F.col("y1") < F.col("m_y2")))
    return d.withColumns({"y1": F.col("y1") + F.col("shift"), "y2": F.col("y2") + F.col("shift")}).drop("m_y1", "m_y2", "shift")


def first_visible(visible: DataFrame) -> DataFrame:
    return visible.groupBy(*_view_keys(visible)).agg(F.min_by("block_idx", F.struct("y1", "block_idx")).alias("block_idx"))


def seam_score(top: list[Column], bottom: list[Column], height: Column, edge: float) -> Column:
    """How well a block at the lower edge of a slice goes on in one at the upper edge of the next; null if not at all.

    Corners x1, y1, x2, y2 in each slice. Both within the edge; widths within
    2.2; overlap across of 0.35 of the narrower or centres within 0.35 of the
    wider; and a positive score of overlap, centres, widths and distances.
    """
    edge = float(max(10, edge))
    tx1, ty1, tx2, ty2 = (c.cast("double") for c in top)
    bx1, by1, bx2, by2 = (c.cast("double") for c in bottom)
    one = F.lit(1.0)
    w1, w2 = F.greatest(tx2 - tx1, one), F.greatest(bx2 - bx1, one)
    narrow, wide = F.least(w1, w2), F.greatest(w1, w2)
    ratio = wide / narrow
    far_top, far_bottom = F.abs(height - ty2), F.abs(by1)
    overlap = F.greatest(F.least(tx2, bx2) - F.greatest(tx1, bx1), F.lit(0.0)) / narrow
    centre = F.abs((tx1 + tx2) / 2 - (bx1 + bx2) / 2) / wide
    score = 2.6 * overlap - 0.75 * centre - 0.35 * F.abs(ratio - 1) - (far_top + far_bottom) / (3 * edge)
    at_edge = (ty2 >= height - edge) & (ty1 < height) & (by1 <= edge) & (by2 > 0) & (far_top <= 1.6 * edge) & (far_bottom <= 1.6 * edge)
    return F.when(at_edge & (ratio <= 2.2) & ((overlap >= 0.35) | (centre <= 0.35)) & (score > 0), score)


def seam_candidates(tops: DataFrame, bottoms: DataFrame, edge: float = 60) -> DataFrame:
    """Pairs of blocks that a border between slices may have cut, with their score.

    tops: seam, slice_height and box; bottoms: seam and box.
    """
    b = bottoms.filter(F.col("y1") <= max(10, edge)).select("seam", F.col("block_idx").alias("next_idx"), *(F.col(c).alias(f"n_{c}") for c in J.CORNERS))
    d = tops.filter(F.col("y2") >= F.col("slice_height") - max(10, edge)).join(b, "seam")
    score = seam_score([F.col(c) for c in J.CORNERS], [F.col(f"n_{c}") for c in J.CORNERS], F.col("slice_height"), edge)
    return d.withColumn("score", score).filter("score is not null").select("seam", "block_idx", "next_idx", "score")


def seam_match(candidates: DataFrame) -> DataFrame:
    """Greedy pairs of a seam, best score first (ties by block, then next block), each block once."""

    def fold(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        take, last = [], -1
        seams = paged.pages_of(starts, rows.num_rows).tolist()
        for i, (seam, a, b) in enumerate(zip(seams, rows["block_idx"].to_pylist(), rows["next_idx"].to_pylist(), strict=True)):
            if seam != last:
                last, upper, lower = seam, set(), set()
            if a not in upper and b not in lower:
                upper.add(a)
                lower.add(b)
                take.append(i)
        return rows.take(pa.array(take, pa.int64()))

    d = candidates.select("seam", "block_idx", "next_idx", "score")
    return paged.by_page(d, ["seam"], [F.col("score").desc(), "block_idx", "next_idx"], fold, ", ".join(f"{c} {t}" for c, t in d.dtypes))


def seam_merge(blocks: DataFrame, heights: DataFrame | int, matches: DataFrame) -> DataFrame:
    """Blocks of consecutive slices after their seams are merged: the upper block owns both, the lower one goes.

    blocks: chapter_id, slice_no, block_idx, corners and bubble corners
    (bubble_x1 ..., null without one); heights: chapter_id, slice_no, height,
    or one height for all; matches: chapter_id, slice_no (of the upper slice), block_idx, next_idx,
    where a block has at most one match above and one below. A block that the
    seam above has consumed owns nothing; what it was matched with stays. So a
    chapter's matches (not its blocks) pass by in the order of slices, and of
    each slice only what it has consumed is remembered.
    """
    number = lambda c: F.col(c).cast("long").alias(c)

    def fold(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        take, last = [], (-1, 0)
        chapters = paged.pages_of(starts, rows.num_rows).tolist()
        for i, (chapter, slice_no, a, b) in enumerate(zip(chapters, *(rows[c].to_pylist() for c in ("slice_no", "block_idx", "next_idx")), strict=True)):
            if (chapter, slice_no) != last:
                before = gone if last == (chapter, slice_no - 1) else set()  # noqa: F821
                last, gone = (chapter, slice_no), set()
            if a not in before:
                gone.add(b)
                take.append(i)
        return rows.take(pa.array(take, pa.int64()))

    high = matches.withColumn("height", F.lit(heights)) if isinstance(heights, int) else matches.join(heights, ["chapter_id", "slice_no"])
    links = high.select("chapter_id", number("slice_no"), number("block_idx"), number("next_idx"), "height")
    kept = paged.by_page(links, ["chapter_id"], ["slice_no", "block_idx", "next_idx"], fold, ", ".join(f"{c} {t}" for c, t in links.dtypes))
    place, sides = ["chapter_id", "slice_no", "block_idx"], [f"{p}{c}" for p in ("", "bubble_") for c in J.CORNERS]
    gone = kept.select("chapter_id", (F.col("slice_no") + 1).alias("slice_no"), F.col("next_idx").alias("block_idx"), F.col("block_idx").alias("owner"), "height")
    moved = [(F.col(c) + (F.col("height") if c[-2] == "y" else 0)).alias(f"n_{c}") for c in sides]
    taken = blocks.join(gone, place).select("chapter_id", (F.col("slice_no") - 1).alias("slice_no"), F.col("owner").alias("block_idx"), F.lit(False).alias("gone"), *moved)
    told = taken.unionByName(gone.select(*place, F.lit(True).alias("gone")), allowMissingColumns=True)
    d = blocks.join(told, place, "left").filter("gone is null or not gone")
    joined = {c: (F.least if c[-1] == "1" else F.greatest)(F.col(c), F.col(f"n_{c}")) for c in sides}  # both pass over nulls
    return d.select(*place, *(v.alias(k) for k, v in joined.items()))


def spill_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts of the page above that end below its lower edge, and of the page below that start above its top, moved onto this page."""
    w = Window.partitionBy("chapter_id").orderBy("page_no")
    p = pages.select("chapter_id", "page_id", "page_no", "height", F.lag("height").over(w).alias("above"))
    it = items.join(pages.select("page_id", "chapter_id", "page_no", F.col("height").alias("own")), "page_id")
    down = it.filter("y2 > own").withColumn("page_no", F.col("page_no") + 1).withColumns({"y1": F.col("y1") - F.col("own"), "y2": F.col("y2") - F.col("own")})
    up = it.filter("y1 < 0").withColumn("page_no", F.col("page_no") - 1)
    take = ["chapter_id", "page_no", "item_idx", "y1", "y2"]
    here = p.select("chapter_id", "page_no", F.col("page_id").alias("onto"), "height")
    a = down.select(take).join(here, ["chapter_id", "page_no"]).select("onto", "item_idx", "y1", "y2")
    b = up.select(take).join(here, ["chapter_id", "page_no"]).select("onto", "item_idx", (F.col("y1") + F.col("height")).alias("y1"), (F.col("y2") + F.col("height")).alias("y2"))
    return a.unionByName(b)


def page_progress(vpages: DataFrame, blocks: DataFrame) -> DataFrame:
    v = vpages.groupBy("page_id").agg(F.count("*").alias("slices"))
    b = blocks.groupBy("page_id").agg(F.count("*").alias("blocks"))
    return v.join(b, "page_id", "left").na.fill(0, ["blocks"])


def clip_text_items(items: DataFrame, layout: DataFrame, strip_width: int) -> DataFrame:
    """The part of each placed text on each page it meets, in page coordinates, with the lines of its text that fall there.

    items: chapter_id, item_idx, x, y, w, h (strip coordinates) and text. Of n
    lines those from int(top * n) to int(bottom * n) by the shares cut off; if
    that is none, one line where over a tenth of the height shows, else ''.
    """
    boxes = items.select("chapter_id", F.col("item_idx").alias("block_idx"), "text", "w", "h", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    d = J.pages_of_span(boxes, layout).withColumn("dx", (strip_width - F.col("width")) / 2)
    d = d.withColumns({"l": F.greatest("x1", "dx"), "r": F.least(F.col("x2"), F.col("dx") + F.col("width")), "t": F.greatest("y1", "top"), "b": F.least("y2", "bottom")}).filter("l < r and t < b")
    top, bottom = F.greatest(F.lit(0.0), (F.col("t") - F.col("y1")) / F.col("h")), F.least(F.lit(1.0), (F.col("b") - F.col("y1")) / F.col("h"))
    d = d.withColumns({"ts": top, "bs": bottom, "lines": F.split("text", "\n", -1)}).withColumn("n", F.size("lines"))
    start = F.least((F.col("ts") * F.col("n")).cast("int"), F.col("n") - 1)
    d = d.withColumn("i", start).withColumn("j", F.greatest(F.col("i"), F.least((F.col("bs") * F.col("n")).cast("int"), F.col("n"))))
    shows, early = F.col("bs") - F.col("ts") > 0.1, F.col("ts") < 0.5
    none = F.col("i") >= F.col("j")
    i = F.when(none & shows & ~early, F.greatest(F.lit(0), F.col("j") - 1)).otherwise(F.col("i"))
    j = F.when(none & shows & early, F.greatest(F.lit(1), F.col("i") + 1)).when(none & ~shows, F.col("i")).otherwise(F.col("j"))
    text = F.array_join(F.slice("lines", i + 1, j - i), "\n")
    return d.select("chapter_id", F.col("block_idx").alias("item_idx"), "page_no", (F.col("l") - F.col("dx")).alias("x"), (F.col("t") - F.col("top")).alias("y"), (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"), text.alias("text"))
