"""Blocks, rectangles, placed texts and strokes that page borders have cut, joined again.

items: chapter_id, page_no, idx (the order within the page), corners in strip
coordinates, style (what must be equal) and text. A pair can only stand on one
page or on neighbours, and within a few pixels, so pairs come from a join on
band of height. Groups then form around seeds in the order of items. What a
seed can take stands no further than a page away, so a chapter's pairs stream
by in that order and only what was taken of three pages is remembered.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import joins as J

BAND = 256


def _pairs(items: DataFrame, at_a: list[Column], at_b: list[Column], reach: float, hit: Callable) -> DataFrame:
    """Every item a with every partner b: one of the heights at_a within reach of the one at its place in at_b, on one page or neighbours.

    Heights are those of the strip, so their bands tell pages apart, mostly. A
    pair that meets at several places is kept at the first.
    """
    place = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    low, high = ([F.floor((c + d) / BAND) for c in at_a] for d in (-reach, reach))
    own = [F.floor(c / BAND) for c in at_b]
    asked = F.array_distinct(F.array(*[place(k, band) for k, ends in enumerate(zip(low, high, strict=True)) for band in ends]))
    bands = lambda p, columns: [c.alias(f"{p}{k}") for k, c in enumerate(columns[:-1])]
    a = items.select(*(F.col(c).alias(f"a_{c}") for c in items.columns if c != "chapter_id"), "chapter_id", *bands("__l", low), *bands("__h", high), F.inline(asked))
    b = items.select(*(F.col(c).alias(f"b_{c}") for c in items.columns if c != "chapter_id"), "chapter_id", *bands("__b", own), F.inline(F.array(*map(place, range(len(own)), own))))
    met = a.join(b, ["chapter_id", "k", "v"]).filter(F.abs(F.col("a_page_no") - F.col("b_page_no")) <= 1)
    met = met.filter((F.col("a_idx") != F.col("b_idx")) | (F.col("a_page_no") != F.col("b_page_no")))
    for k in range(len(own) - 1):
        met = met.filter((F.col("k") <= k) | ~F.col(f"__b{k}").isin(F.col(f"__l{k}"), F.col(f"__h{k}")))
    side = lambda p: lambda c: F.col(f"{p}_{c}")
    return met.filter((F.col("a_style") == F.col("b_style")) & hit(side("a"), side("b")))


def _stacked(gap: float, left: float, width: float) -> Callable:
    def hit(a: Callable, b: Callable) -> Column:
        close = (F.abs(a("y2") - b("y1")) < gap) | (F.abs(b("y2") - a("y1")) < gap)
        return close & (F.abs(a("x1") - b("x1")) <= left) & (F.abs((a("x2") - a("x1")) - (b("x2") - b("x1"))) <= width)

    return hit


def rejoin_pairs(items: DataFrame, gap: float = 15, left: float = 10, width: float = 20, turn: float | None = None) -> DataFrame:
    """Pairs of stacked, aligned items of equal style and near equal width on one page or neighbouring ones, both ways round; with turn also of angles (a column) no further apart."""
    ends = [F.col("y2"), F.col("y1")]
    stacked = _stacked(gap, left, width)
    hit = stacked if turn is None else lambda a, b: stacked(a, b) & (F.abs(a("angle") - b("angle")) <= turn)
    return _pairs(items, ends, ends[::-1], gap, hit)


def stroke_pairs(items: DataFrame, down: float = 20, across: float = 50) -> DataFrame:
    """Pairs of strokes of equal style whose centres are near."""
    cy = lambda s: (s("y1") + s("y2")) / 2
    cx = lambda s: (s("x1") + s("x2")) / 2
    middle = [(F.col("y1") + F.col("y2")) / 2]
    return _pairs(items, middle, middle, down, lambda a, b: (F.abs(cy(a) - cy(b)) <= down) & (F.abs(cx(a) - cx(b)) <= across))


def groups(pairs: DataFrame) -> DataFrame:
    """(chapter_id, group, place, page_no, idx): each item in order, unless taken, takes all its partners that are not."""
    return _grown(pairs, lambda seed, partners, used: [b for b in partners if b[:2] not in used])


def _grown(pairs: DataFrame, choose: Callable[[tuple, list[tuple], set], list[tuple]]) -> DataFrame:
    """(chapter_id, group, place, page_no, idx): seeds in order take what choose gives of their partners, which stand on their page or next to it. Groups are numbered within a chapter in the order of their seeds.

    Items are (page_no, idx, y1, y2); choose gets the seed, its partners in order and what is taken.
    """
    key = ["page_no", "idx"]
    rows = pairs.select("chapter_id", *(F.col(f"a_{c}").cast("long").alias(f"a_{c}") for c in key), *(F.col(f"b_{c}").cast("long").alias(f"b_{c}") for c in key), *(F.col(f"{p}_{c}").cast("double").alias(f"{p}_{c}") for p in "ab" for c in ("y1", "y2")))
    rows = rows.repartition("chapter_id").sortWithinPartitions("chapter_id", "a_page_no", "a_idx", "b_page_no", "b_idx")
    kind = rows.schema["chapter_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        chapter, number, used = object(), 0, set()
        for (own, *seed), some in groupby(lines, lambda r: (r[0], r[1], r[2], r[5], r[6])):
            page, idx = seed[:2]
            if own != chapter:
                chapter, number, used, now = own, 0, set(), None
            if page != now:
                now, used = page, {k for k in used if k[0] >= page - 1}
            if (page, idx) in used:
                continue
            took = choose(tuple(seed), [(r[3], r[4], r[7], r[8]) for r in some], used)
            used.update([(page, idx), *(b[:2] for b in took)])
            if took:
                out += [(own, number, i, *m[:2]) for i, m in enumerate([seed, *took])]
                number += 1
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    arrow = to_arrow_type(kind)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (arrow, pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chapter_id", "group", "place", "page_no", "idx"])

    return rows.mapInArrow(run, f"chapter_id {kind.simpleString()}, group long, place int, page_no long, idx long")


def text_groups(items: DataFrame, gap: float = 50, left: float = 15) -> DataFrame:
    """Groups of placed texts: of the items on the pages next to the seed's, at its left edge and in its style, in order, each that comes near its neighbour by height in the group so far."""
    aligned = lambda a, b: F.abs(a("x1") - b("x1")) <= left
    # A chain may lead further away from the seed than one gap, so all of the neighbouring pages are met.
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("page_no", "idx", "x1", "y1", "y2", "style")]
    a = items.select(*side("a"), F.col("chapter_id"), F.explode(F.array(F.col("page_no") - 1, F.col("page_no") + 1)).alias("page_no"))
    b = items.select(*side("b"), "chapter_id", "page_no")
    near = lambda c: F.floor(F.col(c) / (left + 1))
    a = a.withColumn("v", F.explode(F.array(near("a_x1") - 1, near("a_x1"), near("a_x1") + 1)))
    met = a.join(b.withColumn("v", near("b_x1")), ["chapter_id", "page_no", "v"]).filter((F.col("a_style") == F.col("b_style")) & aligned(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))

    def choose(seed: tuple, partners: list[tuple], used: set) -> list[tuple]:
        """Members stand in the group by upper edge, then by when they came; the lower edges of the last above and the upper one of the first below count."""
        members = [(seed[2], 0, seed[3])]
        took = []
        for b in partners:
            at = bisect_right(members, (b[2], inf, inf))
            close = (at > 0 and abs(members[at - 1][2] - b[2]) < gap) or (at < len(members) and abs(b[3] - members[at][0]) < gap)
            if close and b[:2] not in used:
                took.append(b)
                members.insert(at, (b[2], len(took), b[3]))
        return took

    return _grown(met, choose)


def merge_groups(items: DataFrame, found: DataFrame, layout: DataFrame, glue: str = " ", differ: bool = False) -> DataFrame:
    """One row for each group: its hull, the texts of its members from top to bottom, and the page of its middle.

    differ: groups whose members say the same, or nothing, are left alone.
    """
    d = found.join(items, ["chapter_id", "page_no", "idx"]).withColumn("text", F.coalesce("text", F.lit("")))
    said = F.collect_set(F.nullif(F.trim("text"), F.lit("")))
    hull = [f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]
    g = d.groupBy("chapter_id", "group").agg(F.count("*").alias("parts"), *hull, F.sort_array(F.collect_list(F.struct("y1", "place", "text"))).alias("t"), F.size(said).alias("said"))
    g = g.filter("said > 1") if differ else g
    texts = F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != "")
    g = g.select("chapter_id", F.col("group").alias("block_idx"), "parts", "x1", "y1", "x2", "y2", F.array_join(texts, glue).alias("text"))
    page = J.page_of_center(g, layout).select("chapter_id", "block_idx", F.col("page_no").alias("to_page"))
    return g.join(page, ["chapter_id", "block_idx"], "left").withColumnRenamed("block_idx", "group")


def rejoin_blocks(items: DataFrame, layout: DataFrame) -> DataFrame:
    """Text blocks: style is their class and languages, which must be equal; angles may differ by one degree."""
    return merge_groups(items, groups(rejoin_pairs(items, turn=1.0)), layout, differ=True)


def rejoin_rects(items: DataFrame, layout: DataFrame) -> DataFrame:
    return merge_groups(items, groups(rejoin_pairs(items, gap=10, left=5, width=10)), layout)


def rejoin_texts(items: DataFrame, layout: DataFrame) -> DataFrame:
    return merge_groups(items, text_groups(items), layout, glue="\n")


def rejoin_strokes(items: DataFrame, layout: DataFrame) -> DataFrame:
    return merge_groups(items, groups(stroke_pairs(items)), layout)
