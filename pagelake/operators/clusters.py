"""Merges and orders of a page's boxes in which the order of boxes matters.

A page is one array of boxes, in order, and each operator a fold over it in
the JVM. A page holds tens of boxes, so its array is small; pages are spread
over the cluster by the one shuffle that gathers them. Where a fold compares a
box with all boxes so far, pages of more than `crowd` boxes are folded by cells
instead (crowded.py), with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from . import crowded, paged

CORNERS = ("x1", "y1", "x2", "y2")
_IDX = "idx:bigint,"
_BOX = "x1:bigint,y1:bigint,x2:bigint,y2:bigint"


def as_box(s: Column) -> B.Box:
    return B.Box(*(s[c] for c in CORNERS))


def pixels(b: B.Box) -> tuple[Column, Column]:
    """Width and height in pixels, where both corners are inside; at least 1."""
    return F.greatest(b.width + 1, F.lit(1)), F.greatest(b.height + 1, F.lit(1))


def struct(b: B.Box, **more: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in more.items()), *(c.cast("long").alias(n) for c, n in zip((b.x1, b.y1, b.x2, b.y2), CORNERS, strict=True)))


def hull(a: Column, b: Column) -> B.Box:
    return B.union_box(as_box(a), as_box(b))


def empty(fields: str) -> Column:
    return F.array().cast(f"array<struct<{fields}>>")


def first_index(items: Column, hit: Callable[[Column], Column]) -> Column:
    """Place of the first item that hits, from 0; null without one."""
    return F.array_min(F.transform(items, lambda k, i: F.when(hit(k), i)))


def put(items: Column, at: Column, item: Callable[[Column], Column]) -> Column:
    """items with the one at a place replaced."""
    return F.transform(items, lambda k, i: F.when(i == at, item(k)).otherwise(k))


def gathered(df: DataFrame, keys: list[str], order: list[Column], fields: dict[str, Column], **stats: Column) -> DataFrame:
    """keys, the statistics, and items: structs of the fields in order."""
    ranked = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    one = F.struct(*ranked, *(v.alias(k) for k, v in fields.items()))
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("__r"), *(v.alias(k) for k, v in stats.items()))
    return rows.select(*keys, *stats, F.transform("__r", lambda r: F.struct(*(r[n].alias(n) for n in fields))).alias("items"))


def longs(*names: str) -> dict[str, Column]:
    return {c: F.col(c).cast("long") for c in names}


def boxes_of(df: DataFrame, order: list[Column], keys: tuple[str, ...] = ("page_id",), **stats: Column) -> DataFrame:
    return gathered(df, list(keys), order, {"idx": F.col("det_idx").cast("long")} | longs(*CORNERS), **stats)


def listed(df: DataFrame, items: Column, *keys: str) -> DataFrame:
    return df.select(*(keys or ("page_id",)), F.inline(items))


def merge_contained(df: DataFrame, least: float = 0.3, same: float = 0.5, crowd: int = crowded.CROWD) -> DataFrame:
    """Boxes in order, grown over all original boxes in a containment of at least that share; then of near-equal results the first."""
    page = boxes_of(df, [F.col("det_idx")])

    def grow(own: Column) -> Column:
        def step(acc: Column, other: Column) -> Column:
            a, o = as_box(acc), as_box(other)
            hit = B.mostly_in(a, o, least) | B.mostly_in(o, a, least)
            return F.when(hit, struct(B.union_box(a, o))).otherwise(acc)

        return F.aggregate("items", struct(as_box(own)), step)

    def keep(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda k: (k == s) | (B.iou(as_box(k), as_box(s)) >= same))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(s)))

    def usual(pages: DataFrame) -> DataFrame:
        grown = pages.withColumn("grown", F.transform("items", grow))
        return grown.select("page_id", F.posexplode(F.aggregate("grown", empty(_BOX), keep)).alias("idx", "b")).select("page_id", "idx", "b.*")

    return crowded.by_crowd(page, usual, lambda rows: crowded.merge_contained(rows, least, same), crowd)


def merge_slices(df: DataFrame, page_height: int | str, inside: float = 0.85, same: float = 0.5, shared: float = 0.2, gap: float = 0.1, crowd: int | None = None) -> DataFrame:
    """Boxes of a page and label from overlapping slices, in order, in one pass.

    Of two boxes, one inside the other (or nearly equal) by the shares given,
    the larger stays; of equal areas the second if one is inside, else the
    first. page_height: a number or a column. Stacked parts of one object become their hull: the gap
    is under that share of the page height and a tenth of the taller one, they
    overlap across, their areas differ by less than 0.3, both edges by less
    than half the wider one, and the hull is no larger than three times the
    larger one. The box at hand goes on with what it has become. Many pages
    are gone through at a time, and only those folded of which two boxes come
    near. With `crowd`, up to so many boxes are folded as an array, others in Python.
    """
    if crowd is None:
        high = F.col(page_height) if isinstance(page_height, str) else F.lit(page_height)
        rows = df.select("page_id", "label", "det_idx", *(F.col(c).cast("long") for c in CORNERS), high.cast("double").alias("ph"))
        kinds = dict(rows.dtypes)
        fold = lambda rows, starts: crowded.merge_slices_of(rows, starts, inside, same, shared, gap)
        return paged.by_page(rows, ["page_id", "label"], ["det_idx", *CORNERS], fold, f"page_id {kinds['page_id']}, label {kinds['label']}, {_BOX}")
    page = boxes_of(df, [F.col("det_idx")], ("page_id", "label"), ph=F.max(page_height if isinstance(page_height, str) else F.lit(page_height)))
    area = lambda b: b.area.cast("double")

    def joined(one: Column, two: Column) -> Column:
        """What the two become, or null."""
        a, b = as_box(one), as_box(two)
        small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
        both = B.intersection(a, b)
        contained = (small > 0) & (both / F.nullif(small, F.lit(0.0)) >= inside)
        apart = F.least(F.abs(a.y1 - b.y2), F.abs(a.y2 - b.y1))
        narrow, wide = F.least(a.width, b.width), F.greatest(a.width, b.width)
        across = B.overlap_1d(a.x1, a.x2, b.x1, b.x2)
        whole = hull(one, two)
        stacked = (
            (apart < F.least(gap * F.col("ph"), 0.1 * F.greatest(a.height, b.height)))
            & (narrow > 0)
            & (across / F.nullif(narrow, F.lit(0)) > shared)
            & (small / F.nullif(large, F.lit(0.0)) > 0.3)
            & (F.abs(a.x1 - b.x1) < 0.5 * wide)
            & (F.abs(a.x2 - b.x2) < 0.5 * wide)
            & (area(whole) <= 3 * large)
        )
        within = F.when(area(a) > area(b), one).otherwise(two)
        alike = F.when(area(b) > area(a), two).otherwise(one)
        return F.when(contained, within).when(B.iou(a, b) >= same, alike).when(stacked, struct(whole, idx=one["idx"]))

    def onto(acc: Column, other: Column) -> Column:
        new = F.transform(F.array(joined(acc["own"], other)), lambda x: x)[0]
        return F.struct(F.coalesce(new, acc["own"]).alias("own"), F.when(new.isNull(), F.concat(acc["rest"], F.array(other))).otherwise(acc["rest"]).alias("rest"))

    def outer(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        start = F.struct(rest[0].alias("own"), empty(_IDX + _BOX).alias("rest"))
        done = F.aggregate(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), start, onto)
        step = F.struct(F.concat(acc["out"], F.array(done["own"])).alias("out"), done["rest"].alias("rest"))
        return F.when(F.size(rest) == 0, acc).otherwise(step)

    zero = F.struct(empty(_IDX + _BOX).alias("out"), F.col("items").alias("rest"))
    usual = lambda pages: listed(pages, F.aggregate("items", zero, outer, lambda a: a["out"]), "page_id", "label").drop("idx")
    return crowded.by_crowd(page, usual, lambda rows: crowded.merge_slices(rows, inside, same, shared, gap), crowd, ("page_id", "label"))


def merge_touching(df: DataFrame, width: int, height: int, pad: int = 32, crowd: int = crowded.CROWD) -> DataFrame:
    """Padded boxes that touch (edges included) are merged until none do; the hulls don't depend on the order."""
    from .boxes import pad_boxes

    padded = pad_boxes(df.select("page_id", *CORNERS), width, height, pad)
    page = gathered(padded, ["page_id"], [F.col(c) for c in CORNERS], longs(*CORNERS))
    touch = lambda a, b: (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])

    def into(acc: Column, b: Column) -> Column:
        at = first_index(acc, lambda k: touch(k, b))
        return F.when(at.isNull(), F.concat(acc, F.array(struct(as_box(b))))).otherwise(put(acc, at, lambda k: struct(hull(k, b))))

    def again(acc: Column, _: Column) -> Column:
        merged = F.aggregate(acc["b"], empty(_BOX), into)
        return F.when(acc["done"], acc).otherwise(F.transform(F.array(merged), lambda m: F.struct(m.alias("b"), (F.size(m) == F.size(acc["b"])).alias("done")))[0])

    start = F.struct(F.transform("items", lambda k: struct(as_box(k))).alias("b"), F.lit(False).alias("done"))
    return crowded.by_crowd(page, lambda pages: listed(pages, F.aggregate("items", start, again, lambda a: a["b"])), crowded.merge_touching, crowd)


def _merge_into_first(page: DataFrame, fits: Callable[[Column, Column], Column]) -> Column:
    """Boxes, in order, each merged into the first group that it fits, or a group of its own."""

    def step(acc: Column, b: Column) -> Column:
        at = first_index(acc, lambda k: fits(k, b))
        return F.when(at.isNull(), F.concat(acc, F.array(b))).otherwise(put(acc, at, lambda k: struct(hull(k, b), idx=k["idx"])))

    return F.aggregate("items", empty(_IDX + _BOX), step)


def merge_line_boxes(df: DataFrame, width: int, height: int, crowd: int = crowded.CROWD) -> DataFrame:
    """Line fragments in (y, x) order merged into the first group that they continue, along or down; clamped, over 3 pixels."""

    def fits(k: Column, b: Column) -> Column:
        a, c = as_box(k), as_box(b)
        tall = lambda x: x.height > 1.25 * x.width
        flat = lambda x: x.width > 1.25 * x.height

        def along(low: str, high: str, size_a: Column, size_b: Column, across: tuple[str, str], reach: Callable[[Column], Column]) -> Column:
            least = F.greatest(F.least(size_a, size_b), F.lit(1))
            shared = B.overlap_1d(k[low], k[high], b[low], b[high])
            centres = F.abs((k[low] + k[high]) - (b[low] + b[high])) / 2
            gap = F.greatest(F.greatest(k[across[0]], b[across[0]]) - F.least(k[across[1]], b[across[1]]), F.lit(0))
            return ((shared / least >= 0.55) | (centres <= 0.35 * least)) & (gap <= reach(least))

        level = along("y1", "y2", a.height, c.height, ("x1", "x2"), lambda s: F.greatest(F.lit(0.08 * width), 2.0 * s))
        upright = along("x1", "x2", a.width, c.width, ("y1", "y2"), lambda s: F.greatest(2 * s, F.lit(8)))
        return F.when(~tall(a) & ~tall(c) & (flat(a) | flat(c) | level), level).when(~flat(a) & ~flat(c), upright).otherwise(False)

    page = boxes_of(df, [F.col("y1"), F.col("x1"), F.col("det_idx")])
    out = crowded.by_crowd(page, lambda pages: listed(pages, _merge_into_first(pages, fits)), lambda rows: crowded.merge_line_boxes(rows, width), crowd)
    from .boxes import clean_boxes

    return clean_boxes(out, width, height, tol=3)


def _median_pixels(low: str, high: str) -> Column:
    return F.percentile(F.greatest(F.col(high) - F.col(low) + 1, F.lit(1)).cast("double"), 0.5)


def merge_aligned(df: DataFrame) -> DataFrame:
    """Fragments in rows (overlap of 0.45, or centres near), merged along a row: gap up to max(14, 1.55 median heights), overlap of 0.35, heights within 1.8."""
    page = boxes_of(df, [F.col("y1") + F.col("y2"), F.col("x1"), F.col("det_idx")], mh=_median_pixels("y1", "y2"))
    row = f"{_BOX},members:array<struct<x:bigint,k:bigint,{_IDX}{_BOX}>>"

    def into(acc: Column, b: Column) -> Column:
        size = F.aggregate(acc, F.lit(0), lambda n, r: n + F.size(r["members"]))
        member = F.array(F.struct(b["x1"].alias("x"), size.cast("long").alias("k"), *(b[c].alias(c) for c in ("idx", *CORNERS))))

        def fits(r: Column) -> Column:
            shared = F.least(r["y2"], b["y2"]) - F.greatest(r["y1"], b["y1"]) + 1
            least = F.least(r["y2"] - r["y1"], b["y2"] - b["y1"]) + 1
            centres = F.abs((r["y1"] + r["y2"]) - (b["y1"] + b["y2"])) / 2
            return (shared >= 0.45 * least) | (centres <= F.greatest(F.lit(5.0), 0.45 * F.col("mh")))

        make = lambda box, members: F.struct(*(c.cast("long").alias(n) for c, n in zip((box.x1, box.y1, box.x2, box.y2), CORNERS, strict=True)), members.alias("members"))
        at = first_index(acc, fits)
        return F.when(at.isNull(), F.concat(acc, F.array(make(as_box(b), member)))).otherwise(put(acc, at, lambda r: make(hull(r, b), F.concat(r["members"], member))))

    def along(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        h1, h2 = last["y2"] - last["y1"] + 1, b["y2"] - b["y1"] + 1
        least = F.least(h1, h2)
        shared = F.least(last["y2"], b["y2"]) - F.greatest(last["y1"], b["y1"]) + 1
        ok = (b["x1"] - last["x2"] - 1 <= F.greatest(F.lit(14.0), 1.55 * F.col("mh"))) & (shared >= 0.35 * least) & (F.greatest(h1, h2) <= 1.8 * F.greatest(least, F.lit(1)))
        one = struct(as_box(b), idx=b["idx"])
        return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(struct(hull(last, b), idx=last["idx"])))).otherwise(F.concat(acc, F.array(one)))

    rows = page.select("page_id", "mh", F.explode(F.aggregate("items", empty(row), into)).alias("r"))
    return listed(rows, F.aggregate(F.sort_array("r.members"), empty(_IDX + _BOX), along))


def absorb_fragments(df: DataFrame, crowd: int = crowded.CROWD) -> DataFrame:
    """Small fragments, in order, each taken by the much larger box of least vertical gap that it overlaps or nearly touches; that box grows.

    Small: height up to max(8, 0.45 medians) and width up to max(36, 0.35
    medians). A box that has been taken takes nothing itself.
    """
    page = boxes_of(df, [F.col("det_idx")], mw=_median_pixels("x1", "x2"), mh=_median_pixels("y1", "y2"))
    mw, mh = F.col("mw"), F.col("mh")

    def step(acc: Column, i: Column) -> Column:
        own = F.get(acc, i)
        w, h = pixels(as_box(own))
        centre = (own["x1"] + own["x2"]) / 2

        def gap_to(t: Column, j: Column) -> Column:
            tw, th = pixels(as_box(t))
            shared = F.least(own["y2"], t["y2"]) - F.greatest(own["y1"], t["y1"]) + 1
            gap = F.greatest(F.greatest(own["y1"], t["y1"]) - F.least(own["y2"], t["y2"]) - 1, F.lit(0))
            near = (shared >= 0.2 * F.least(h, th)) | ((gap <= F.greatest(F.lit(8.0), 0.45 * mh)) & (h < 0.6 * th))
            under = (centre >= t["x1"] - mh) & (centre <= t["x2"] + mh)
            across = F.least(own["x2"], t["x2"]) - F.greatest(own["x1"], t["x1"]) + 1 >= F.least(0.35 * w, F.lit(8.0))
            ok = (j != i) & ~t["gone"] & ((tw >= 2 * w) | (th >= 2 * h)) & near & (under | across)
            return F.when(ok, F.struct(gap.alias("gap"), j.alias("at")))

        small = ~own["gone"] & (h <= F.greatest(F.lit(8.0), 0.45 * mh)) & (w <= F.greatest(F.lit(36.0), 0.35 * mw))
        best = F.array_min(F.transform(acc, gap_to))["at"]
        taken = F.transform(F.array(best), lambda at: F.transform(acc, lambda t, j: F.when(j == at, struct(hull(t, own), gone=t["gone"], idx=t["idx"])).when((j == i) & at.isNotNull(), struct(as_box(t), gone=F.lit(True), idx=t["idx"])).otherwise(t)))[0]
        return F.when(small, taken).otherwise(acc)

    start = F.transform("items", lambda k: struct(as_box(k), gone=F.lit(False), idx=k["idx"]))
    folded = F.aggregate(F.sequence(F.lit(0), F.size("items") - 1), start, step, lambda a: F.filter(a, lambda k: ~k["gone"]))
    return crowded.by_crowd(page, lambda pages: listed(pages, folded).drop("gone"), crowded.absorb_fragments, crowd)


def rows_by_y(df: DataFrame) -> DataFrame:
    """Boxes by centre height; one more than max(8, 0.75 median heights) below its row's mean centre starts a new row."""
    fields = {"idx": F.col("det_idx").cast("long"), "cy": B.box().cy.cast("double")}
    page = gathered(df, ["page_id"], [B.box().cy, F.col("det_idx")], fields, mh=_median_pixels("y1", "y2"))

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(b["cy"] - last["s"] / last["n"] <= F.greatest(F.lit(8.0), 0.75 * F.col("mh")), F.lit(False))
        member = F.array(b["idx"])
        grown = F.struct((last["n"] + 1).alias("n"), (last["s"] + b["cy"]).alias("s"), F.concat(last["members"], member).alias("members"))
        fresh = F.struct(F.lit(1).alias("n"), b["cy"].alias("s"), member.alias("members"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    rows = page.select("page_id", F.posexplode(F.aggregate("items", empty("n:int,s:double,members:array<bigint>"), step)).alias("row", "r"))
    return rows.select("page_id", "row", F.explode("r.members").alias("det_idx"))


def merge_columns(df: DataFrame) -> DataFrame:
    """Narrow columns from left to right, each merged into the one before if near and at one height; limits from the page's medians."""
    page = boxes_of(df, [F.col("x1"), F.col("det_idx")], mw=_median_pixels("x1", "x2"), mh=_median_pixels("y1", "y2"))
    mw, mh = F.col("mw"), F.col("mh")
    gap_limit, narrow = F.greatest(F.lit(5.0), F.least(F.lit(14.0), 0.85 * mw, 0.55 * mh)), F.greatest(F.lit(8.0), 1.35 * mw)

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        least = F.least(last["y2"] - last["y1"], b["y2"] - b["y1"]) + 1
        shared = F.least(last["y2"], b["y2"]) - F.greatest(last["y1"], b["y1"]) + 1
        thin = (pixels(as_box(last))[0] <= narrow) & (pixels(as_box(b))[0] <= narrow)
        ok = (b["x1"] - last["x2"] - 1 <= gap_limit) & (least > 0) & (shared >= 0.35 * least) & thin
        return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(struct(hull(last, b), idx=last["idx"])))).otherwise(F.concat(acc, F.array(b)))

    return listed(page, F.aggregate("items", empty(_IDX + _BOX), step))


def reading_order(df: DataFrame, rtl: bool = False, vertical: Column | None = None) -> DataFrame:
    """Blocks by centre height, one inserted after another.

    A placed block that ends above is passed by; one that lies below takes the
    new block behind it; with one at its height the new block goes in front if
    its centre lies to the left (to the right, where rtl is asked and one of
    the two is vertical). vertical: by default a block taller than wide.
    """
    b = B.box()
    tall = b.height > b.width if vertical is None else vertical
    fields = {"idx": F.col("det_idx").cast("long"), "y1": F.col("y1").cast("double"), "y2": F.col("y2").cast("double"), "cx": b.cx.cast("double"), "cy": b.cy.cast("double"), "tall": tall}
    page = gathered(df, ["page_id"], [b.cy, F.col("det_idx")], fields)

    def step(acc: Column, n: Column) -> Column:
        def place(k: Column, i: Column) -> Column:
            turned = (n["tall"] | k["tall"]) & F.lit(rtl)
            before = F.when(turned, n["cx"] > k["cx"]).otherwise(n["cx"] < k["cx"])
            to = F.when(n["cy"] > k["y2"], F.lit(None)).when(n["cy"] < k["y1"], i + 1).when(before, i)
            return F.when(to.isNotNull(), F.struct(i.alias("i"), to.alias("to")))

        at = F.coalesce(F.array_min(F.transform(acc, place))["to"], F.size(acc))
        return F.transform(F.array(at), lambda a: F.concat(F.slice(acc, F.lit(1), a), F.array(n), F.slice(acc, a + 1, F.size(acc) - a)))[0]

    placed = F.aggregate("items", empty("idx:bigint,y1:double,y2:double,cx:double,cy:double,tall:boolean"), step)
    return page.select("page_id", F.posexplode(placed).alias("rank", "b")).select("page_id", F.col("b.idx").alias("det_idx"), "rank")


def dedup_blocks(df: DataFrame, tolerance: float = 5, degrees: float = 0.1, crowd: int = crowded.CROWD) -> DataFrame:
    """Blocks in order: one near a kept one (less than so many pixels and degrees) with equal text takes its place if larger, else goes."""
    fields = {"idx": F.col("det_idx").cast("long")} | longs(*CORNERS) | {"angle": F.col("angle").cast("double"), "text": F.col("text")}
    page = gathered(df, ["page_id"], [F.col("det_idx")], fields)

    def near(a: Column, b: Column) -> Column:
        close = (a["text"] == b["text"]) & (F.abs(a["angle"] - b["angle"]) < degrees)
        for c in CORNERS:
            close = close & (F.abs(a[c] - b[c]) < tolerance)
        return close

    def step(acc: Column, new: Column) -> Column:
        at = first_index(acc, lambda k: near(k, new))
        larger = put(acc, at, lambda k: F.when(as_box(new).area > as_box(k).area, new).otherwise(k))
        return F.when(at.isNull(), F.concat(acc, F.array(new))).otherwise(larger)

    folded = F.aggregate("items", empty(f"{_IDX}{_BOX},angle:double,text:string"), step)
    return crowded.by_crowd(page, lambda pages: listed(pages, folded).drop("angle", "text"), lambda rows: crowded.dedup_blocks(rows, tolerance, degrees), crowd)


#: What each kind of item compares, by numbers within the tolerance, and whether angle and plain text count.
KINDS = {"blocks": (CORNERS, True, False), "rectangles": (("x", "y", "w", "h"), True, False), "texts": (("x", "y"), True, True), "strokes": (("x", "y", "w", "h"), False, False)}


def insert_new(new: DataFrame, existing: DataFrame, kind: str = "blocks", tolerance: float = 5, degrees: float = 1.0) -> DataFrame:
    """New items of a page that no existing one and no earlier new one, in the order of idx, equals within the tolerance, edges included."""
    numbers, _, worded = KINDS[kind]
    return insert_kinds(new, existing, (kind,), tolerance, degrees, (*numbers, *(["plain"] if worded else []))).drop("kind")


def insert_kinds(new: DataFrame, existing: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), tolerance: float = 5, degrees: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """kind, page_id and idx of what insert_new gives for each kind, and the columns to keep; a page's items are sorted once for all kinds."""
    used = list(dict.fromkeys(c for k in kinds for c in (*KINDS[k][0], *(["angle"] if KINDS[k][1] else []), *(["plain"] if KINDS[k][2] else []))))
    as_type = {"plain": "string", "angle": "double"}
    side = lambda d, known: d.select("page_id", F.col("idx").cast("long").alias("idx"), *(F.col(c).cast(as_type[c]) if c in as_type else F.col(c) for c in used), F.lit(known).alias("known"))
    both = side(new, False).unionByName(side(existing, True))
    shape = f"kind string, page_id {dict(new.dtypes)['page_id']}, idx long" + "".join(f", {c} {as_type.get(c, 'long')}" for c in keep)
    fold = lambda rows, starts: crowded.insert_kinds(rows, starts, {k: KINDS[k] for k in kinds}, tolerance, degrees, keep)
    return paged.by_page(both, ["page_id"], ["idx", *used], fold, shape)
