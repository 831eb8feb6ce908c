"""Spatial, interval and tolerant joins.

Where the join key is coarse (a whole strip), intervals are cut into buckets
and joined on equal buckets; a bucket is as high as a typical page, so both
sides put only neighbours together, and pairs that share several buckets are
kept once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import texts as T

CORNERS = ("x1", "y1", "x2", "y2")


def meeting(a: DataFrame, b: DataFrame, keys: list[str], low: str, high: str, prefix: str, size: int = 256) -> DataFrame:
    """Rows of a with the rows of b (columns named prefix + low and so on) of equal keys whose extents low .. high meet, edges included.

    Both are dealt to the bands of height that they touch; a pair is kept in
    the band where it first meets. So a crowded page isn't all pairs.
    """
    bands = lambda x, y: F.sequence(F.floor(F.least(x, y) / size), F.floor(F.greatest(x, y) / size))
    left = a.withColumn("__band", F.explode(bands(F.col(low), F.col(high))))
    right = b.withColumn("__band", F.explode(bands(F.col(f"{prefix}{low}"), F.col(f"{prefix}{high}"))))
    first = F.floor(F.greatest(F.least(low, high), F.least(f"{prefix}{low}", f"{prefix}{high}")) / size)
    return left.join(right, [*keys, "__band"]).filter(F.col("__band") == first).drop("__band")


def assign_bubbles(texts: DataFrame, bubbles: DataFrame, least: float = 0.2) -> DataFrame:
    """Texts with the first bubble, in order, that contains them or overlaps enough; text_free without one."""
    b = bubbles.select("page_id", F.col("det_idx").alias("bubble_idx"), *(F.col(c).alias(f"bubble_{c}") for c in CORNERS))
    inside = B.fits(B.box("bubble_"), B.box()) | B.overlaps(B.box("bubble_"), B.box(), least)
    found = meeting(texts, b, ["page_id"], "y1", "y2", "bubble_").filter(inside).groupBy("page_id", "det_idx").agg(F.min_by(F.struct("bubble_idx", *(f"bubble_{c}" for c in CORNERS)), "bubble_idx").alias("b")).select("page_id", "det_idx", "b.*")
    out = texts.join(found, ["page_id", "det_idx"], "left")
    return out.withColumn("text_class", F.when(F.col("bubble_idx").isNull(), "text_free").otherwise("text_bubble"))


def page_summary(texts: DataFrame, bubbles: DataFrame) -> DataFrame:
    d = assign_bubbles(texts, bubbles)
    return d.groupBy("page_id").agg(
        F.sum((F.col("text_class") == "text_bubble").cast("long")).alias("in_bubble"), F.sum((F.col("text_class") == "text_free").cast("long")).alias("free"), F.sum(B.box().area).alias("area")
    )


def assign_lines(lines: DataFrame, blocks: DataFrame, width: int, height: int, least: float = 0.35) -> DataFrame:
    """Lines to the block, grown by 8 %, that covers most of them (0.15 more if it holds the centre); the earliest on ties."""
    grown = B.expand(B.box(), 8, 8, F.lit(width), F.lit(height))
    b = blocks.select("page_id", F.col("det_idx").alias("to_block"), *B.columns(grown, "b_"))
    line, block = B.box(), B.box("b_")
    centre = (line.cx >= block.x1) & (line.cx <= block.x2) & (line.cy >= block.y1) & (line.cy <= block.y2)
    score = B.intersection(block, line) / F.greatest(line.area, F.lit(1)) + F.when(centre, 0.15).otherwise(0.0)
    found = meeting(lines, b, ["page_id"], "y1", "y2", "b_").withColumn("match", score).filter(F.col("match") >= least)
    best = found.groupBy("page_id", "block_idx", "line_idx").agg(F.max(F.struct("match", (-F.col("to_block")).alias("neg"))).alias("m"))
    return best.select("page_id", "block_idx", "line_idx", (-F.col("m.neg")).alias("to_block"), F.col("m.match").alias("match"))


def lines_in_blocks(lines: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines with every block that contains them or holds at least that share of them."""
    b = blocks.select("page_id", F.col("det_idx").alias("in_block"), *(F.col(c).alias(f"b_{c}") for c in CORNERS))
    line, block = B.box(), B.box("b_")
    hit = B.fits(block, line) | (B.intersection(block, line) >= least * line.area)
    return meeting(lines, b, ["page_id"], "y1", "y2", "b_").filter(hit).select("page_id", "block_idx", "line_idx", "in_block")


def polys_in_blocks(polys: DataFrame, blocks: DataFrame, least: float = 0.7) -> DataFrame:
    """Polygons (by their axis box) with every block when that share of either lies in the other."""
    b = blocks.select("page_id", F.col("det_idx").alias("in_block"), *(F.col(c).alias(f"b_{c}") for c in CORNERS))
    p, block = B.box(), B.box("b_")
    both = B.intersection(block, p)
    return meeting(polys, b, ["page_id"], "y1", "y2", "b_").filter((both >= least * p.area) | (both >= least * block.area)).select("page_id", "block_idx", "line_idx", "in_block")


def banded(probes: DataFrame, found: DataFrame, keys: list[str], ident: list[str], order: str, pixels: int = 5, degrees: float = 1, band: int = 64) -> DataFrame:
    """Probes with the first of found, in order, within so many pixels on each side and degrees; an exact match goes first.

    The join key holds the band of x1 and y1, so a crowded page doesn't become all pairs; a probe asks the bands its tolerance touches.
    """
    cell = lambda c, d=0: F.floor((F.col(c) + d) / band)
    reach = F.array_distinct(F.array(*[F.struct(cell("x1", i).alias("bx"), cell("y1", j).alias("by")) for i in (-pixels, pixels) for j in (-pixels, pixels)]))
    p = probes.withColumn("__b", F.explode(reach)).withColumns({"__bx": F.col("__b.bx"), "__by": F.col("__b.by")}).drop("__b")
    rest = [c for c in found.columns if c not in (*keys, *CORNERS, "angle", order)]
    f = found.select(*keys, *(F.col(c).alias(f"__{c}") for c in (*CORNERS, "angle", order)), *rest, cell("x1").alias("__bx"), cell("y1").alias("__by"))
    a, b = B.box(), B.box("__")
    whole = lambda c: F.col(c).cast("long")
    exact = (F.col("x1").cast("long") == whole("__x1")) & (F.col("y1").cast("long") == whole("__y1")) & (F.col("x2").cast("long") == whole("__x2")) & (F.col("y2").cast("long") == whole("__y2")) & (whole("angle") == whole("__angle"))
    hit = B.near(a, b, pixels) & (F.abs(F.col("angle") - F.col("__angle")) <= degrees)
    pairs = p.join(f, [*keys, "__bx", "__by"]).filter(hit)
    best = pairs.groupBy(*keys, *ident).agg(F.min_by(F.struct(F.col(f"__{order}").alias(order), *rest), F.struct(~exact, F.col(f"__{order}"))).alias("__m"))
    return probes.join(best.select(*keys, *ident, "__m.*"), [*keys, *ident], "left")


def lookup_ocr(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks with the cached value; null is a miss, '' a hit."""
    return banded(blocks, cache.drop("source_text"), ["page_id"], ["block_idx"], "cached_idx")


def lookup_translation(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """As lookup_ocr, a hit only if the cached source text is the block's."""
    d = banded(blocks, cache, ["page_id"], ["block_idx"], "cached_idx")
    return d.withColumn("value", F.when(F.col("source_text") == F.col("text"), F.col("value"))).drop("source_text")


def pages_servable(hits: DataFrame, needed: Column) -> DataFrame:
    """Pages all of whose needed blocks are hits."""
    return hits.groupBy("page_id").agg(F.bool_and(F.col("value").isNotNull() | ~needed).alias("servable"))


def apply_cache(hits: DataFrame, translatable: Column) -> DataFrame:
    return hits.withColumn("text_out", F.when(translatable, F.coalesce("value", "translation")).otherwise(""))


def _buckets(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def page_of_center(blocks: DataFrame, layout: DataFrame, size: int = 4096) -> DataFrame:
    """The first page of the strip that holds the block's middle, borders included."""
    pages = layout.select("chapter_id", "page_id", "page_no", "top", (F.col("top") + F.col("height")).alias("bottom")).withColumn("bucket", _buckets(F.col("top"), F.col("bottom"), size))
    b = blocks.withColumn("cy", B.box().cy).withColumn("bucket", F.floor(F.col("cy") / size))
    hit = (F.col("cy") >= F.col("top")) & (F.col("cy") <= F.col("bottom"))
    return b.join(pages, ["chapter_id", "bucket"]).filter(hit).groupBy("chapter_id", "block_idx").agg(F.min_by("page_id", "page_no").alias("page_id"), F.min("page_no").alias("page_no"))


def pages_of_span(blocks: DataFrame, layout: DataFrame, size: int = 4096) -> DataFrame:
    """Blocks with every page that their span crosses, borders excluded; a pair once, by the bucket where it first meets."""
    pages = layout.select("chapter_id", "page_id", "page_no", "width", "top", (F.col("top") + F.col("height")).alias("bottom"))
    pages = pages.withColumn("bucket", _buckets(F.col("top"), F.col("bottom"), size))
    b = blocks.withColumn("bucket", _buckets(F.col("y1"), F.col("y2"), size))
    hit = (F.col("y1") < F.col("bottom")) & (F.col("y2") > F.col("top"))
    once = F.col("bucket") == F.floor(F.greatest("y1", "top") / size)
    return b.join(pages, ["chapter_id", "bucket"]).filter(hit & once).drop("bucket")


def clip_to_pages(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """The part of a block on each page it crosses, in page coordinates."""
    d = pages_of_span(blocks, layout)
    return d.select("chapter_id", "block_idx", "page_no", "x1", (F.greatest("y1", "top") - F.col("top")).alias("y1"), "x2", (F.least("y2", "bottom") - F.col("top")).alias("y2")).filter("y2 > y1")


def sync_items(items: DataFrame, blocks: DataFrame, pixels: int = 5, band: int = 64) -> DataFrame:
    """Placed texts with the first block whose corner is less than pixels away and turned by less than a degree; their text, without tags, replaces the block's."""
    cell = lambda c, d=0: F.floor((F.col(c) + d) / band)
    reach = F.array_distinct(F.array(*[F.struct(cell("px", i).alias("bx"), cell("py", j).alias("by")) for i in (-pixels, pixels) for j in (-pixels, pixels)]))
    p = items.withColumn("__b", F.explode(reach)).select("page_id", "item_idx", "px", "py", "rotation", "plain", F.col("__b.bx").alias("bx"), F.col("__b.by").alias("by"))
    b = blocks.select("page_id", "block_idx", "x1", "y1", "angle", cell("x1").alias("bx"), cell("y1").alias("by"))
    hit = (F.abs(F.col("px") - F.col("x1")) < pixels) & (F.abs(F.col("py") - F.col("y1")) < pixels) & (F.abs(F.col("rotation") - F.col("angle")) < 1)
    return p.join(b, ["page_id", "bx", "by"]).filter(hit).groupBy("page_id", "item_idx").agg(F.min("block_idx").alias("block_idx"), F.first(T.plain_text(F.col("plain"))).alias("plain"))


def edit_blocks(edits: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """Rectangle edits on the first block they overlap enough; other blocks stay."""
    e = edits.select("page_id", "edit_id", *(F.col(c).alias(f"e_{c}") for c in CORNERS), *(F.col(f"new_{c}") for c in CORNERS))
    hit = meeting(blocks, e, ["page_id"], "y1", "y2", "e_").filter(B.iou(B.box(), B.box("e_")) >= least)
    first = hit.groupBy("page_id", "edit_id").agg(F.min_by(F.struct("det_idx", *(f"new_{c}" for c in CORNERS)), "det_idx").alias("m"))
    last = first.groupBy("page_id", F.col("m.det_idx").alias("det_idx")).agg(F.max_by("m", "edit_id").alias("m"))
    d = blocks.join(last, ["page_id", "det_idx"], "left")
    return d.select("page_id", "det_idx", *(F.coalesce(F.col(f"m.new_{c}"), F.col(c)).alias(c) for c in CORNERS))


def replace_range(old: DataFrame, new: DataFrame, ranges: DataFrame, size: int = 4096) -> DataFrame:
    """Drop old blocks wholly inside a re-detected range, add the new ones. A chapter may have any number of ranges; blocks meet them by the band of their upper edge."""
    r = ranges.select("chapter_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("band"))
    o = old.withColumn("__band", F.floor(F.col("y1") / size)).alias("o")
    hit = (F.col("o.chapter_id") == F.col("r.chapter_id")) & (F.col("o.__band") == F.col("r.band")) & (F.col("o.y1") >= F.col("r.lo")) & (F.col("o.y2") <= F.col("r.hi"))
    return o.join(r.filter("lo <= hi").alias("r"), hit, "left_anti").drop("__band").unionByName(new)


def apply_responses(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    return blocks.join(responses, ["page_id", "block_idx"], "left").withColumn("translation", F.coalesce("reply", F.lit(""))).drop("reply")


def apply_positional(blocks: DataFrame, replies: DataFrame, sent: Column) -> DataFrame:
    """The n-th reply of a page goes to its n-th block sent; blocks not sent or not answered keep what they have."""
    n = F.sum(sent.cast("int")).over(Window.partitionBy("page_id").orderBy("block_idx"))
    d = blocks.withColumn("position", F.when(sent, n)).join(replies, ["page_id", "position"], "left")
    return d.withColumn("translation", F.coalesce("reply", "translation")).drop("reply")


def apply_changes(blocks: DataFrame, changes: DataFrame, undo: bool = False) -> DataFrame:
    """Replay a change log forward, or backward with undo."""
    take = F.col("old" if undo else "new").alias("__to")
    return blocks.join(changes.select("page_id", "block_idx", take), ["page_id", "block_idx"], "left").withColumn("text", F.coalesce("__to", "text")).drop("__to")


def resolve_ids(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """Identifiers to pages: the full path, else the base name if only one page has it."""
    by_path = pages.select(F.col("path").alias("ident"), F.col("page_id").alias("by_path")).groupBy("ident").agg(F.min("by_path").alias("by_path"))
    base = pages.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("ident")).agg(F.min("page_id").alias("by_base"), F.count("*").alias("n"))
    d = ids.join(by_path, "ident", "left").join(base.filter("n = 1"), "ident", "left")
    return d.select("ident", F.coalesce("by_path", "by_base").alias("page_id"))


def resolve_reorder(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """project, pos and path of a new order of pages; path is null throughout a project whose tokens are no permutation.

    tokens: project, pos, token; pages: project, page_no, path. A token is an
    exact path that isn't used yet, else the next unused page of that base
    name. Only tokens of one base name compete, so each such group is folded
    by itself.
    """
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    asked = tokens.groupBy("project", base("token").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("asked"))
    there = pages.groupBy("project", base("path").alias("base")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "path"))), lambda p: p["path"]).alias("paths"))
    d = asked.join(there, ["project", "base"], "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))

    def step(acc: Column, t: Column) -> Column:
        free = F.filter("paths", lambda p: ~F.exists(acc, lambda a: a["path"] == p))
        exact = F.filter(free, lambda p: p == t["token"])
        by_name = F.when(t["token"] == F.col("base"), F.get(free, F.lit(0)))
        return F.concat(acc, F.array(F.struct(t["pos"].cast("long").alias("pos"), F.coalesce(F.get(exact, F.lit(0)), by_name).alias("path"))))

    got = d.select("project", F.inline(F.aggregate("asked", F.array().cast("array<struct<pos:bigint,path:string>>"), step)))
    sizes = pages.groupBy("project").agg(F.count("*").alias("n"))
    fine = got.groupBy("project").agg(F.count("*").alias("asked"), F.count("path").alias("found")).join(sizes, "project", "left")
    fine = fine.select("project", F.coalesce((F.col("asked") == F.col("found")) & (F.col("asked") == F.col("n")), F.lit(False)).alias("fine"))
    return got.join(fine, "project").select("project", "pos", F.when(F.col("fine"), F.col("path")).alias("path"))


def remap_paths(entries: DataFrame, renames: DataFrame) -> DataFrame:
    return entries.join(renames.select(F.col("old").alias("path"), "new"), "path", "left").withColumn("path", F.coalesce("new", "path")).drop("new")


def append_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """New pages after the last of their chapter, in order of path, not skipped."""
    last = pages.groupBy("chapter_id").agg(F.max("page_no").alias("last"))
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("path", "page_id"))
    added = new.join(last, "chapter_id", "left").select("chapter_id", "page_id", (F.coalesce("last", F.lit(-1)) + n).alias("page_no"), "path", F.lit(False).alias("skip"))
    return pages.select("chapter_id", "page_id", "page_no", "path", "skip").unionByName(added)


def delete_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Remaining pages, numbered anew."""
    left = pages.join(gone.select("page_id"), "page_id", "left_anti")
    return left.withColumn("page_no", (F.row_number().over(Window.partitionBy("chapter_id").orderBy("page_no")) - 1).cast("long"))


def audit_assets(expected: DataFrame, files: DataFrame) -> DataFrame:
    """state of each asset: missing, verified, differs, or present when the checksum's length is unknown."""
    d = expected.join(files, "file_id", "left")
    n = F.length("expected")
    digest = F.when(n == 64, F.sha2("content", 256)).when(n == 32, F.md5("content"))
    state = F.when(F.col("content").isNull(), "missing").when(digest.isNull(), "present").when(F.lower("expected") == digest, "verified").otherwise("differs")
    return d.select("file_id", state.alias("state"))


def find_items(keys: DataFrame, items: DataFrame) -> DataFrame:
    """Block keys with the first placed text within 5 px and 1 degree, borders included."""
    placed = items.select("page_id", F.col("item_idx").alias("cached_idx"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("px").alias("x2"), F.col("py").alias("y2"), F.col("rotation").alias("angle"))
    corner = keys.withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    return banded(corner, placed, ["page_id"], ["block_idx"], "cached_idx").select("page_id", "block_idx", F.col("cached_idx").alias("item_idx"))


def seam_crop(blocks: DataFrame, width: int, height: int, pad: int = 48) -> DataFrame:
    """Blocks of a seam in the coordinates of the padded hull of all of them, clamped to the image."""
    hull = blocks.groupBy("seam").agg(
        F.greatest(F.min("x1") - pad, F.lit(0)).alias("cx1"), F.greatest(F.min("y1") - pad, F.lit(0)).alias("cy1"), F.least(F.max("x2") + pad, F.lit(width)).alias("cx2"), F.least(F.max("y2") + pad, F.lit(height)).alias("cy2")
    )
    d = blocks.join(hull, "seam")
    return d.withColumns({"x1": F.col("x1") - F.col("cx1"), "x2": F.col("x2") - F.col("cx1"), "y1": F.col("y1") - F.col("cy1"), "y2": F.col("y2") - F.col("cy1")})


def render_area(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Contracted by 5 %, unless the page's first block is Korean or Chinese."""
    first = F.first("source_lang").over(Window.partitionBy("page_id").orderBy("block_idx"))
    small = B.expand(B.box(), -5, -5, F.lit(width), F.lit(height))
    d = blocks.withColumn("__keep", F.coalesce(first.rlike("^(ko|zh)"), F.lit(False)))
    return d.withColumns({c: F.when(F.col("__keep"), F.col(c)).otherwise(n) for c, n in zip(CORNERS, (small.x1, small.y1, small.x2, small.y2), strict=True)}).drop("__keep")


def load_state(pages: DataFrame, refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Image references of pages, of every kind, by id to the stored path, else the original one."""
    d = refs.join(stored.select("image_id", "stored_path"), "image_id", "left").join(pages.select("page_id", "path"), "page_id")
    return d.select("page_id", "kind", "image_id", F.coalesce("stored_path", "path").alias("path"))
