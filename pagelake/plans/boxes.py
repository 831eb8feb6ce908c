"""Queries over boxes: predicates, filters, clusters, orders and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import boxes as O
from .fixtures import Tables
from .registry import query

#: Page size of the detection views.
WIDTH, HEIGHT = 1040, 1090


def sql_overlap(a: str, b: str) -> str:
    ix = f"greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)"
    iy = f"greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0)"
    return f"({ix}*{iy})"


def sql_area(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def sql_iou(a: str, b: str) -> str:
    i = sql_overlap(a, b)
    u = f"({sql_area(a)}+{sql_area(b)}-{i})"
    return f"(CASE WHEN {u} > 0 THEN CAST({i} AS DOUBLE)/{u} ELSE 0.0 END)"


def sql_fits(o: str, i: str) -> str:
    return f"({o}.x1<={i}.x1 AND {o}.y1<={i}.y1 AND {o}.x2>={i}.x2 AND {o}.y2>={i}.y2)"


def sql_mostly(o: str, i: str, t: float) -> str:
    return f"(CASE WHEN {sql_area(i)} > 0 AND {sql_area(o)} >= {sql_area(i)} THEN CAST({sql_overlap(o, i)} AS DOUBLE)/{sql_area(i)} >= {t} ELSE false END)"


def pairs(t: Tables) -> DataFrame:
    """Every text of a page with every bubble of it; pages hold tens of boxes."""
    return t.fx_text.alias("a").join(t.fx_bubble.alias("b"), F.col("a.page_id") == F.col("b.page_id"))


PAIRS = "FROM fx_text a JOIN fx_bubble b ON a.page_id = b.page_id"


@query(f"""SELECT page_id, det_idx, label, least(greatest(x1,0),700) AS x1, least(greatest(y1,0),700) AS y1, least(greatest(x2,0),700) AS x2, least(greatest(y2,0),700) AS y2
FROM fx_det WHERE least(greatest(x2,0),700)-least(greatest(x1,0),700) > 5 AND least(greatest(y2,0),700)-least(greatest(y1,0),700) > 5""")
def p1_clean_boxes(t: Tables) -> DataFrame:
    return O.clean_boxes(t.fx_det, 700, 700).drop("score")


@query("""SELECT page_id, det_idx, x1, y1, x2, y2, CASE WHEN label = 0 THEN 'bubble' ELSE 'text' END AS kind FROM fx_det WHERE score >= 0.3""")
def p2_split_detections(t: Tables) -> DataFrame:
    return O.split_detections(t.fx_det).select("page_id", "det_idx", "x1", "y1", "x2", "y2", "kind")


@query(f"""SELECT page_id, det_idx, greatest(x1 - CAST(floor((x2-x1)*8/200.0) AS BIGINT), 0) AS x1, greatest(y1 - CAST(floor((y2-y1)*8/200.0) AS BIGINT), 0) AS y1,
least(x2 + CAST(floor((x2-x1)*8/200.0) AS BIGINT), {WIDTH}) AS x2, least(y2 + CAST(floor((y2-y1)*8/200.0) AS BIGINT), {HEIGHT}) AS y2 FROM fx_det""")
def p3_expand_box(t: Tables) -> DataFrame:
    return t.fx_det.select("page_id", "det_idx", *B.columns(B.expand(B.box(), 8, 8, F.lit(WIDTH), F.lit(HEIGHT))))


@query("""SELECT page_id, det_idx, CAST(trunc((x1+x2)/2.0 - (x2-x1)*0.35) AS BIGINT) AS x1, CAST(trunc((y1+y2)/2.0 - (y2-y1)*0.35) AS BIGINT) AS y1,
CAST(trunc((x1+x2)/2.0 + (x2-x1)*0.35) AS BIGINT) AS x2, CAST(trunc((y1+y2)/2.0 + (y2-y1)*0.35) AS BIGINT) AS y2 FROM fx_det""")
def p4_shrink_box(t: Tables) -> DataFrame:
    return t.fx_det.select("page_id", "det_idx", *B.columns(B.shrink(B.box(), 30)))


@query("""SELECT page_id, det_idx, x2-x1 AS w, y2-y1 AS h, (x1+x2)/2.0 AS cx, (y1+y2)/2.0 AS cy, greatest((x2-x1)*(y2-y1),1) AS area,
CASE WHEN y2-y1 > x2-x1 THEN 'ver_rtl' ELSE 'hor_ltr' END AS direction FROM fx_det""")
def p6_geometry(t: Tables) -> DataFrame:
    return O.with_geometry(t.fx_det).select("page_id", "det_idx", "w", "h", "cx", "cy", "area", "direction")


@query(f"SELECT a.page_id, a.det_idx AS text_idx, b.det_idx AS bubble_idx, round({sql_iou('a', 'b')}, 9) AS iou, {sql_iou('a', 'b')} >= 0.2 AS overlaps {PAIRS}")
def p7_iou(t: Tables) -> DataFrame:
    a, b = B.box("a."), B.box("b.")
    return pairs(t).select("a.page_id", F.col("a.det_idx").alias("text_idx"), F.col("b.det_idx").alias("bubble_idx"), F.round(B.iou(a, b), 9).alias("iou"), B.overlaps(a, b).alias("overlaps"))


@query(f"SELECT a.page_id, a.det_idx AS text_idx, b.det_idx AS bubble_idx {PAIRS} AND {sql_fits('b', 'a')}")
def p8_fits(t: Tables) -> DataFrame:
    return pairs(t).filter(B.fits(B.box("b."), B.box("a."))).select("a.page_id", F.col("a.det_idx").alias("text_idx"), F.col("b.det_idx").alias("bubble_idx"))


@query(f"SELECT a.page_id, a.det_idx AS text_idx, b.det_idx AS bubble_idx {PAIRS} AND {sql_mostly('b', 'a', 0.25)}")
def p9_mostly_in(t: Tables) -> DataFrame:
    return pairs(t).filter(B.mostly_in(B.box("b."), B.box("a."), 0.25)).select("a.page_id", F.col("a.det_idx").alias("text_idx"), F.col("b.det_idx").alias("bubble_idx"))


@query(f"""SELECT a.page_id, a.det_idx AS text_idx, b.det_idx AS bubble_idx, CASE WHEN {sql_area('a')} <= {sql_area('b')} THEN 'a' ELSE 'b' END AS side {PAIRS}
AND least({sql_area('a')},{sql_area('b')}) > 0 AND CAST({sql_overlap('a', 'b')} AS DOUBLE)/least({sql_area('a')},{sql_area('b')}) >= 0.85""")
def p10_contained_side(t: Tables) -> DataFrame:
    d = pairs(t).withColumn("side", B.contained_side(B.box("a."), B.box("b."))).filter("side is not null")
    return d.select("a.page_id", F.col("a.det_idx").alias("text_idx"), F.col("b.det_idx").alias("bubble_idx"), "side")


@query(f"SELECT a.page_id, a.det_idx AS text_idx, b.det_idx AS bubble_idx, least(a.x1,b.x1) AS x1, least(a.y1,b.y1) AS y1, greatest(a.x2,b.x2) AS x2, greatest(a.y2,b.y2) AS y2 {PAIRS}")
def p11_union_box(t: Tables) -> DataFrame:
    return pairs(t).select("a.page_id", F.col("a.det_idx").alias("text_idx"), F.col("b.det_idx").alias("bubble_idx"), *B.columns(B.union_box(B.box("a."), B.box("b."))))


@query("SELECT page_id, det_idx, x1-5 AS x1, y1+((page_id+det_idx)%7) AS y1, x2+9 AS x2, y2+11 AS y2, x1+4 AS cx2, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS angle FROM (SELECT *, degrees(atan2(CAST((page_id+det_idx)%7-3 AS DOUBLE), CAST(x2-x1 AS DOUBLE))) AS a FROM fx_det) d")
def p12_p13_polygons(t: Tables) -> DataFrame:
    """Axis box and angle of a polygon whose edges lean by a few pixels."""
    from ..functions import polygons as G

    lean = (F.col("page_id") + F.col("det_idx")) % 7 - 3
    corners = [("x1", "y1", 0, 3), ("x2", "y1", 9, 3), ("x2", "y2", 9, 11), ("x1", "y2", -5, 11)]
    shifts = [F.lit(0), lean, lean, F.lit(0)]
    poly = F.array(*[F.struct(F.col(x).cast("double").alias("x"), (F.col(y) + s).cast("double").alias("y")) for (x, y, _, _), s in zip(corners, shifts, strict=True)])
    d = t.fx_det.select("page_id", "det_idx", "x1", "y1", "x2", "y2", (F.col("x1") + 4).alias("cx2"), ((F.col("page_id") + F.col("det_idx")) % 7).alias("m"), poly.alias("poly"))
    return d.select("page_id", "det_idx", (F.col("x1") - 5).alias("x1"), (F.col("y1") + F.col("m")).alias("y1"), (F.col("x2") + 9).alias("x2"), (F.col("y2") + 11).alias("y2"), "cx2", F.round(G.poly_angle(F.col("poly")), 6).alias("angle"))


@query("SELECT page_id, block_idx, line_idx FROM fx_lines WHERE x2-x1 > 3 AND y2-y1 > 3 AND (x2-x1)*(y2-y1) < 0.75*2000")
def p14_usable_lines(t: Tables) -> DataFrame:
    return O.usable_lines(t.fx_lines, 2000).select("page_id", "block_idx", "line_idx")


@query("""SELECT page_id, block_idx, line_idx FROM fx_lines WHERE NOT (CASE WHEN page_id % 2 = 0 THEN x2-x1 ELSE y2-y1 - 12 END < 3
OR (CASE WHEN page_id % 2 = 0 THEN x2-x1 ELSE y2-y1-12 END < 5 AND CASE WHEN page_id % 2 = 0 THEN y2-y1-12 ELSE x2-x1 END < 36))""")
def p15_noise_lines(t: Tables) -> DataFrame:
    thin = t.fx_lines.withColumn("y2", F.col("y2") - 12)
    return O.drop_noise_lines(thin, F.col("page_id") % 2 == 0).select("page_id", "block_idx", "line_idx")


@query(f"""WITH first AS (SELECT a.page_id, a.det_idx, min(b.det_idx) AS bi FROM fx_text a JOIN fx_bubble b ON a.page_id = b.page_id AND ({sql_fits('b', 'a')} OR {sql_iou('b', 'a')} >= 0.2) GROUP BY 1, 2),
j AS (SELECT a.*, f.bi, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM fx_text a LEFT JOIN first f ON a.page_id=f.page_id AND a.det_idx=f.det_idx LEFT JOIN fx_bubble b ON b.page_id=a.page_id AND b.det_idx=f.bi),
r AS (SELECT page_id, det_idx,
 least(greatest(coalesce(bx1, greatest(x1-CAST(floor((x2-x1)*5/200.0) AS BIGINT),0)),0),{WIDTH}) AS x1, least(greatest(coalesce(by1, greatest(y1-CAST(floor((y2-y1)*5/200.0) AS BIGINT),0)),0),{HEIGHT}) AS y1,
 least(greatest(coalesce(bx2, least(x2+CAST(floor((x2-x1)*5/200.0) AS BIGINT),{WIDTH})),0),{WIDTH}) AS x2, least(greatest(coalesce(by2, least(y2+CAST(floor((y2-y1)*5/200.0) AS BIGINT),{HEIGHT})),0),{HEIGHT}) AS y2 FROM j)
SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY det_idx) AS INT) AS request_no FROM r WHERE x2 > x1 AND y2 > y1""")
def p29_request_regions(t: Tables) -> DataFrame:
    from ..operators import joins as J

    return O.request_regions(J.assign_bubbles(t.fx_text, t.fx_bubble), WIDTH, HEIGHT)


@query("SELECT page_id, det_idx, x1-7 AS x1, y1-7 AS y1, x2+7 AS x2, y2+7 AS y2 FROM fx_det")
def p30_resize_blocks(t: Tables) -> DataFrame:
    return O.resize_blocks(t.fx_det, 7).select("page_id", "det_idx", "x1", "y1", "x2", "y2")


@query(f"SELECT page_id, det_idx, greatest(x1-32,0) AS x1, greatest(y1-32,0) AS y1, least(x2+32,{WIDTH}) AS x2, least(y2+32,{HEIGHT}) AS y2 FROM fx_det")
def p32_pad_boxes(t: Tables) -> DataFrame:
    return O.pad_boxes(t.fx_det, WIDTH, HEIGHT).select("page_id", "det_idx", "x1", "y1", "x2", "y2")


LINES = """c AS (SELECT *, (y1+y2)/2.0 AS cy FROM fx_text),
g AS (SELECT c.*, quantile_cont(y2-y1, 0.5) OVER (PARTITION BY page_id) AS median_h, cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, det_idx) AS gap FROM c),
l AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > median_h*0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY cy, det_idx) - 1 AS BIGINT) AS line FROM g)"""


@query(f"WITH {LINES} SELECT page_id, det_idx, line FROM l")
def c5_group_lines(t: Tables) -> DataFrame:
    return O.group_lines(t.fx_text).select("page_id", "det_idx", "line")


@query(f"WITH {LINES} SELECT page_id, line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM l GROUP BY page_id, line")
def c7_line_hulls(t: Tables) -> DataFrame:
    return O.line_hulls(O.group_lines(t.fx_text))


@query(f"""WITH {LINES}, s AS (SELECT *, x1 - max(x2) OVER (PARTITION BY page_id, line ORDER BY x1, det_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS blank,
greatest(12.0, 0.85*quantile_cont(y2-y1, 0.5) OVER (PARTITION BY page_id, line)) AS most FROM l)
SELECT page_id, det_idx, line, CAST(sum(CASE WHEN blank IS NULL OR blank > most THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, line ORDER BY x1, det_idx) - 1 AS BIGINT) AS segment FROM s""")
def c14_segments(t: Tables) -> DataFrame:
    return O.segments_by_x(O.group_lines(t.fx_text)).select("page_id", "det_idx", "line", "segment")


@query(f"WITH {LINES} SELECT page_id, det_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, x1, det_idx) AS INT) AS rank FROM l")
def w2_rect_order(t: Tables) -> DataFrame:
    return O.rect_order(t.fx_text).select("page_id", "det_idx", "rank")


@query("""SELECT page_id, block_idx, line_idx, CAST(row_number() OVER (PARTITION BY page_id, block_idx ORDER BY CASE WHEN page_id%2=0 THEN -x1 ELSE y1 END, CASE WHEN page_id%2=0 THEN y1 ELSE x1 END, line_idx) AS INT) AS rank FROM fx_lines""")
def w3_sort_lines(t: Tables) -> DataFrame:
    return O.sort_lines(t.fx_lines, F.col("page_id") % 2 == 0).select("page_id", "block_idx", "line_idx", "rank")
