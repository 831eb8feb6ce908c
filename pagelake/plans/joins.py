"""Queries over the spatial, interval and tolerant joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from .boxes import HEIGHT, WIDTH, sql_fits, sql_iou, sql_overlap
from .fixtures import Tables
from .registry import query

FIRST_BUBBLE = f"""f AS (SELECT a.page_id, a.det_idx, min(b.det_idx) AS bubble_idx FROM fx_text a JOIN fx_bubble b ON a.page_id = b.page_id AND ({sql_fits('b', 'a')} OR {sql_iou('b', 'a')} >= 0.2) GROUP BY 1, 2)"""


@query(f"""WITH {FIRST_BUBBLE} SELECT a.page_id, CAST(sum(CASE WHEN f.bubble_idx IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_bubble, CAST(sum(CASE WHEN f.bubble_idx IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS free,
CAST(sum((x2-x1)*(y2-y1)) AS BIGINT) AS area FROM fx_text a LEFT JOIN f ON a.page_id=f.page_id AND a.det_idx=f.det_idx GROUP BY a.page_id""")
def j1_page_summary(t: Tables) -> DataFrame:
    return J.page_summary(t.fx_text, t.fx_bubble)


@query(f"""WITH {FIRST_BUBBLE} SELECT a.page_id, a.det_idx, f.bubble_idx, CASE WHEN f.bubble_idx IS NULL THEN 'text_free' ELSE 'text_bubble' END AS text_class FROM fx_text a LEFT JOIN f ON a.page_id=f.page_id AND a.det_idx=f.det_idx""")
def j1_assign_bubbles(t: Tables) -> DataFrame:
    return J.assign_bubbles(t.fx_text, t.fx_bubble).select("page_id", "det_idx", "bubble_idx", "text_class")


@query(f"""WITH b AS (SELECT page_id, det_idx, greatest(x1-CAST(floor((x2-x1)*8/200.0) AS BIGINT),0) AS x1, greatest(y1-CAST(floor((y2-y1)*8/200.0) AS BIGINT),0) AS y1,
 least(x2+CAST(floor((x2-x1)*8/200.0) AS BIGINT),{WIDTH}) AS x2, least(y2+CAST(floor((y2-y1)*8/200.0) AS BIGINT),{HEIGHT}) AS y2 FROM fx_text),
m AS (SELECT l.page_id, l.block_idx, l.line_idx, b.det_idx AS to_block, CAST({sql_overlap('b', 'l')} AS DOUBLE)/greatest((l.x2-l.x1)*(l.y2-l.y1),1)
 + CASE WHEN (l.x1+l.x2)/2.0 BETWEEN b.x1 AND b.x2 AND (l.y1+l.y2)/2.0 BETWEEN b.y1 AND b.y2 THEN 0.15 ELSE 0.0 END AS score FROM fx_lines l JOIN b ON l.page_id=b.page_id)
SELECT page_id, block_idx, line_idx, to_block, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block_idx, line_idx ORDER BY score DESC, to_block) AS rn FROM m WHERE score >= 0.35) x WHERE rn = 1""")
def j2_assign_lines(t: Tables) -> DataFrame:
    return J.assign_lines(t.fx_lines, t.fx_text, WIDTH, HEIGHT).select("page_id", "block_idx", "line_idx", "to_block", F.round("match", 9).alias("score"))


@query(f"""SELECT l.page_id, l.block_idx, l.line_idx, b.det_idx AS in_block FROM fx_lines l JOIN fx_det b ON l.page_id=b.page_id AND ({sql_fits('b', 'l')} OR {sql_overlap('b', 'l')} >= 0.5*(l.x2-l.x1)*(l.y2-l.y1))""")
def j3_lines_in_blocks(t: Tables) -> DataFrame:
    return J.lines_in_blocks(t.fx_lines, t.fx_det)


@query(f"""SELECT l.page_id, l.block_idx, l.line_idx, b.det_idx AS in_block FROM fx_lines l JOIN fx_det b ON l.page_id=b.page_id AND ({sql_overlap('b', 'l')} >= 0.7*(l.x2-l.x1)*(l.y2-l.y1) OR {sql_overlap('b', 'l')} >= 0.7*(b.x2-b.x1)*(b.y2-b.y1))""")
def j4_polys_in_blocks(t: Tables) -> DataFrame:
    return J.polys_in_blocks(t.fx_lines, t.fx_det)


CACHED = """m AS (SELECT b.page_id, b.block_idx, c.cached_idx, c.value, c.source_text,
 row_number() OVER (PARTITION BY b.page_id, b.block_idx ORDER BY CASE WHEN b.x1=c.x1 AND b.y1=c.y1 AND b.x2=c.x2 AND b.y2=c.y2 AND b.angle=c.angle THEN 0 ELSE 1 END, c.cached_idx) AS rn
 FROM fx_blocks b JOIN fx_cache c ON b.page_id=c.page_id AND abs(b.x1-c.x1)<=5 AND abs(b.y1-c.y1)<=5 AND abs(b.x2-c.x2)<=5 AND abs(b.y2-c.y2)<=5 AND abs(b.angle-c.angle)<=1),
h AS (SELECT b.*, m.value, m.source_text FROM fx_blocks b LEFT JOIN m ON b.page_id=m.page_id AND b.block_idx=m.block_idx AND m.rn=1),
tr AS (SELECT h.page_id, h.block_idx, h.text, h.translation, CASE WHEN source_text = text THEN value END AS value FROM h)"""


@query(f"WITH {CACHED} SELECT page_id, block_idx, value FROM h")
def j5_lookup_ocr(t: Tables) -> DataFrame:
    return J.lookup_ocr(t.fx_blocks, t.fx_cache).select("page_id", "block_idx", "value")


@query(f"WITH {CACHED} SELECT page_id, block_idx, value FROM tr")
def j6_lookup_translation(t: Tables) -> DataFrame:
    return J.lookup_translation(t.fx_blocks, t.fx_cache).select("page_id", "block_idx", "value")


HAS = "regexp_matches(text, '[\\p{L}\\p{N}]')"


def _has() -> F.Column:
    from ..functions.texts import has_content

    return has_content(F.col("text"))


@query(f"WITH {CACHED} SELECT page_id, bool_and(value IS NOT NULL OR NOT {HAS}) AS servable FROM tr GROUP BY page_id")
def j7_pages_servable(t: Tables) -> DataFrame:
    return J.pages_servable(J.lookup_translation(t.fx_blocks, t.fx_cache), _has())


@query(f"WITH {CACHED} SELECT page_id, block_idx, CASE WHEN {HAS} THEN coalesce(value, translation) ELSE '' END AS text_out FROM tr")
def j8_apply_cache(t: Tables) -> DataFrame:
    return J.apply_cache(J.lookup_translation(t.fx_blocks, t.fx_cache), _has()).select("page_id", "block_idx", "text_out")


@query("""SELECT chapter_id, block_idx, page_id, page_no FROM (SELECT b.chapter_id, b.block_idx, l.page_id, l.page_no, row_number() OVER (PARTITION BY b.chapter_id, b.block_idx ORDER BY l.page_no) AS rn
FROM fx_strip b JOIN fx_layout l ON b.chapter_id=l.chapter_id AND (b.y1+b.y2)/2.0 >= l.top AND (b.y1+b.y2)/2.0 <= l.top+l.height) x WHERE rn = 1""")
def j9_page_of_center(t: Tables) -> DataFrame:
    return J.page_of_center(t.fx_strip, t.fx_layout)


@query("SELECT b.chapter_id, b.block_idx, l.page_no FROM fx_strip b JOIN fx_layout l ON b.chapter_id=l.chapter_id AND b.y1 < l.top+l.height AND b.y2 > l.top")
def j10_pages_of_span(t: Tables) -> DataFrame:
    return J.pages_of_span(t.fx_strip, t.fx_layout).select("chapter_id", "block_idx", "page_no")


@query("""SELECT b.chapter_id, b.block_idx, l.page_no, b.x1, greatest(b.y1,l.top)-l.top AS y1, b.x2, least(b.y2,l.top+l.height)-l.top AS y2
FROM fx_strip b JOIN fx_layout l ON b.chapter_id=l.chapter_id AND b.y1 < l.top+l.height AND b.y2 > l.top""")
def p21_clip_to_pages(t: Tables) -> DataFrame:
    return J.clip_to_pages(t.fx_strip, t.fx_layout)


@query("""WITH i AS (SELECT page_id, block_idx AS item_idx, x1 + (block_idx*5)%13 - 6 AS px, y1 + (block_idx*3)%7 - 3 AS py, angle AS rotation, concat('t&', CAST(block_idx AS VARCHAR(20)), chr(10), 'x') AS plain FROM fx_blocks)
SELECT i.page_id, i.item_idx, min(b.block_idx) AS block_idx, min(i.plain) AS plain FROM i JOIN fx_blocks b ON i.page_id=b.page_id AND abs(i.px-b.x1)<5 AND abs(i.py-b.y1)<5 AND abs(i.rotation-b.angle)<1 GROUP BY 1,2""")
def j16_sync_items(t: Tables) -> DataFrame:
    b = F.col("block_idx")
    items = t.fx_blocks.select("page_id", b.alias("item_idx"), (F.col("x1") + (b * 5) % 13 - 6).alias("px"), (F.col("y1") + (b * 3) % 7 - 3).alias("py"), F.col("angle").alias("rotation"), F.concat(F.lit("<p style='a'>t&amp;<b>"), b.cast("string"), F.lit("</b><br/>x</p>")).alias("plain"))
    return J.sync_items(items, t.fx_blocks)


@query(f"""WITH e AS (SELECT page_id, det_idx AS edit_id, x1+4 AS x1, y1+4 AS y1, x2+4 AS x2, y2+4 AS y2, x1+9 AS nx1, y1+9 AS ny1, x2+9 AS nx2, y2+9 AS ny2 FROM fx_det WHERE det_idx % 2 = 0),
f AS (SELECT e.page_id, e.edit_id, min(b.det_idx) AS det_idx FROM e JOIN fx_det b ON e.page_id=b.page_id AND {sql_iou('b', 'e')} >= 0.5 GROUP BY 1,2),
l AS (SELECT page_id, det_idx, max(edit_id) AS edit_id FROM f GROUP BY 1,2)
SELECT b.page_id, b.det_idx, coalesce(nx1,b.x1) AS x1, coalesce(ny1,b.y1) AS y1, coalesce(nx2,b.x2) AS x2, coalesce(ny2,b.y2) AS y2 FROM fx_det b LEFT JOIN l ON b.page_id=l.page_id AND b.det_idx=l.det_idx LEFT JOIN e ON e.page_id=l.page_id AND e.edit_id=l.edit_id""")
def j18_edit_blocks(t: Tables) -> DataFrame:
    edits = t.fx_det.filter("det_idx % 2 = 0").select("page_id", F.col("det_idx").alias("edit_id"), *((F.col(c) + 4).alias(c) for c in J.CORNERS), *((F.col(c) + 9).alias(f"new_{c}") for c in J.CORNERS))
    return J.edit_blocks(edits, t.fx_det)


@query("""SELECT b.page_id, b.block_idx, CASE WHEN b.block_idx % 3 = 0 THEN '' ELSE concat('r', CAST(b.block_idx AS VARCHAR(20))) END AS translation FROM fx_blocks b""")
def j19_apply_responses(t: Tables) -> DataFrame:
    r = t.fx_blocks.filter("block_idx % 3 <> 0").select("page_id", "block_idx", F.concat(F.lit("r"), F.col("block_idx").cast("string")).alias("reply"))
    return J.apply_responses(t.fx_blocks, r).select("page_id", "block_idx", "translation")


@query("""WITH s AS (SELECT *, CASE WHEN trim(text) <> '' THEN sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY block_idx) END AS position FROM fx_blocks)
SELECT page_id, block_idx, CASE WHEN position <= 2 THEN concat('p', CAST(CAST(position AS BIGINT) AS VARCHAR(20))) ELSE translation END AS translation FROM s""")
def j20_apply_positional(t: Tables) -> DataFrame:
    two = t.spark.range(1, 3).select(F.col("id").alias("position"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("reply"))
    replies = t.fx_blocks.select("page_id").distinct().join(F.broadcast(two))  # two rows
    return J.apply_positional(t.fx_blocks, replies, F.trim("text") != "").select("page_id", "block_idx", "translation")


@query("""WITH r AS (SELECT chapter_id, min(top) + v*9000 AS lo, min(top) + v*9000 + 3000 AS hi FROM fx_layout, range(2) t(v) GROUP BY chapter_id, v)
SELECT b.chapter_id, b.block_idx, b.y1, b.y2 FROM fx_strip b WHERE NOT EXISTS (SELECT 1 FROM r WHERE b.chapter_id=r.chapter_id AND b.y1>=r.lo AND b.y2<=r.hi) UNION ALL SELECT chapter_id, -1, lo, lo+10 FROM r""")
def j30_replace_range(t: Tables) -> DataFrame:
    """Two ranges of each chapter."""
    first = t.fx_layout.groupBy("chapter_id").agg(F.min("top").alias("top"))
    r = first.select("chapter_id", F.explode(F.array(F.col("top"), F.col("top") + 9000)).alias("lo")).withColumn("hi", F.col("lo") + 3000)
    new = r.select("chapter_id", F.lit(-1).cast("long").alias("block_idx"), F.col("lo").alias("y1"), (F.col("lo") + 10).alias("y2"))
    return J.replace_range(t.fx_strip.select("chapter_id", "block_idx", "y1", "y2"), new, r)


@query("SELECT page_id, block_idx, CASE WHEN block_idx % 4 = 1 THEN concat(text, '!') ELSE text END AS text FROM fx_blocks")
def j31_apply_changes(t: Tables) -> DataFrame:
    ch = t.fx_blocks.filter("block_idx % 4 = 1").select("page_id", "block_idx", F.col("text").alias("old"), F.concat("text", F.lit("!")).alias("new"))
    there = J.apply_changes(t.fx_blocks, ch)
    return J.apply_changes(J.apply_changes(there, ch, undo=True), ch).select("page_id", "block_idx", "text")


@query("""WITH i AS (SELECT DISTINCT path AS ident FROM fx_pages WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) FROM fx_pages),
p AS (SELECT path AS ident, min(page_id) AS by_path FROM fx_pages GROUP BY 1), b AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS ident, min(page_id) AS by_base FROM fx_pages GROUP BY 1 HAVING count(*) = 1)
SELECT i.ident, coalesce(by_path, by_base) AS page_id FROM i LEFT JOIN p ON i.ident=p.ident LEFT JOIN b ON i.ident=b.ident""")
def j23_resolve_ids(t: Tables) -> DataFrame:
    pages = t.fx_pages
    ids = pages.filter("page_id % 3 = 0").select(F.col("path").alias("ident")).union(pages.select(F.regexp_extract("path", "([^/]*)$", 1))).distinct()
    return J.resolve_ids(ids, pages)


@query("SELECT event_id, CASE WHEN path LIKE 'p1%' THEN concat('new/', path) ELSE path END AS path FROM fx_runs WHERE kind = 'skip'")
def j21_remap_paths(t: Tables) -> DataFrame:
    entries = t.fx_runs.filter("kind = 'skip'").select("event_id", "path")
    renames = entries.filter("path like 'p1%'").select(F.col("path").alias("old"), F.concat(F.lit("new/"), "path").alias("new")).distinct()
    return J.remap_paths(entries, renames)


@query("""WITH o AS (SELECT * FROM fx_pages WHERE page_id % 5 <> 0), n AS (SELECT * FROM fx_pages WHERE page_id % 5 = 0), l AS (SELECT chapter_id, max(page_no) AS last FROM o GROUP BY 1)
SELECT chapter_id, page_id, page_no, path, skip FROM o UNION ALL
SELECT n.chapter_id, n.page_id, coalesce(l.last,-1) + row_number() OVER (PARTITION BY n.chapter_id ORDER BY n.path, n.page_id), n.path, false FROM n LEFT JOIN l ON n.chapter_id=l.chapter_id""")
def j25_append_pages(t: Tables) -> DataFrame:
    p = t.fx_pages
    return J.append_pages(p.filter("page_id % 5 <> 0"), p.filter("page_id % 5 = 0"))


@query("SELECT chapter_id, page_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY page_no) - 1 AS BIGINT) AS page_no FROM fx_pages WHERE NOT skip")
def j24_delete_pages(t: Tables) -> DataFrame:
    return J.delete_pages(t.fx_pages, t.fx_pages.filter("skip")).select("chapter_id", "page_id", "page_no")


@query("""SELECT a.file_id, CASE WHEN f.content IS NULL THEN 'missing' WHEN length(expected)=64 THEN CASE WHEN expected=sha256(content) THEN 'verified' ELSE 'differs' END
WHEN length(expected)=32 THEN CASE WHEN lower(expected)=md5(content) THEN 'verified' ELSE 'differs' END ELSE 'present' END AS state FROM fx_assets a LEFT JOIN fx_present f ON a.file_id=f.file_id""")
def j29_audit_assets(t: Tables) -> DataFrame:
    return J.audit_assets(t.fx_assets, t.fx_present)


@query("""WITH i AS (SELECT page_id, block_idx AS item_idx, x1 + (block_idx*5)%13 - 6 AS px, y1 + (block_idx*3)%7 - 3 AS py, angle AS rotation FROM fx_blocks),
m AS (SELECT b.page_id, b.block_idx, min(i.item_idx) AS item_idx FROM fx_blocks b JOIN i ON i.page_id=b.page_id AND abs(i.px-b.x1)<=5 AND abs(i.py-b.y1)<=5 AND abs(i.rotation-b.angle)<=1 GROUP BY 1,2)
SELECT b.page_id, b.block_idx, m.item_idx FROM fx_blocks b LEFT JOIN m ON b.page_id=m.page_id AND b.block_idx=m.block_idx""")
def j17_find_items(t: Tables) -> DataFrame:
    b = F.col("block_idx")
    items = t.fx_blocks.select("page_id", b.alias("item_idx"), (F.col("x1") + (b * 5) % 13 - 6).alias("px"), (F.col("y1") + (b * 3) % 7 - 3).alias("py"), F.col("angle").alias("rotation"))
    return J.find_items(t.fx_blocks.select("page_id", "block_idx", "x1", "y1", "angle"), items)


@query(f"""WITH h AS (SELECT page_id, greatest(min(x1)-48,0) AS a, greatest(min(y1)-48,0) AS b, least(max(x2)+48,{WIDTH}) AS c, least(max(y2)+48,{HEIGHT}) AS d FROM fx_text GROUP BY 1)
SELECT t.page_id AS seam, t.det_idx, x1-a AS x1, y1-b AS y1, x2-a AS x2, y2-b AS y2, c-a AS w, d-b AS h FROM fx_text t JOIN h ON t.page_id=h.page_id""")
def p22_seam_crop(t: Tables) -> DataFrame:
    d = J.seam_crop(t.fx_text.withColumnRenamed("page_id", "seam"), WIDTH, HEIGHT)
    return d.select("seam", "det_idx", *J.CORNERS, (F.col("cx2") - F.col("cx1")).alias("w"), (F.col("cy2") - F.col("cy1")).alias("h"))


@query("""WITH f AS (SELECT *, first_value(script) OVER (PARTITION BY page_id ORDER BY block_idx) LIKE 'Hangul%' AS keep FROM fx_blocks)
SELECT page_id, block_idx, CASE WHEN keep THEN x1 ELSE x1+7 END AS x1, CASE WHEN keep THEN y1 ELSE y1+1 END AS y1, CASE WHEN keep THEN x2 ELSE x2-7 END AS x2, CASE WHEN keep THEN y2 ELSE y2-1 END AS y2 FROM f""")
def p5_render_area(t: Tables) -> DataFrame:
    d = t.fx_blocks.withColumn("source_lang", F.when(F.col("script").startswith("Hangul"), "ko").otherwise("en"))
    return J.render_area(d, 100_000, 100_000).select("page_id", "block_idx", *J.CORNERS)


@query("""SELECT page_id, CASE n.i WHEN 0 THEN 'page' WHEN 1 THEN 'clean' WHEN 2 THEN 'patch' ELSE 'thumb' END AS kind, page_id*4 + n.i AS image_id, CASE WHEN (page_id*4 + n.i) % 3 = 0 THEN concat('store/', CAST(page_id*4 + n.i AS VARCHAR(20))) ELSE path END AS path
FROM fx_pages, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n""")
def s8_load_state(t: Tables) -> DataFrame:
    p = t.fx_pages
    refs = p.select("page_id", F.posexplode(F.array(*map(F.lit, ("page", "clean", "patch", "thumb")))).alias("i", "kind")).select("page_id", "kind", (F.col("page_id") * 4 + F.col("i")).alias("image_id"))
    stored = refs.filter("image_id % 3 = 0").select("image_id", F.concat(F.lit("store/"), F.col("image_id").cast("string")).alias("stored_path"))
    return J.load_state(p, refs, stored)


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('v', CAST(page_id % 10 AS VARCHAR)) ELSE '' END AS stem, CASE WHEN page_id % 2 = 0 THEN 'in' ELSE concat('ch', CAST(chapter_id AS VARCHAR)) END AS dir FROM fx_pages""")
def s14_attach_archive(t: Tables) -> DataFrame:
    from ..sources.inputs import attach_archive

    p = t.fx_pages.withColumn("path", F.concat("path", F.lit("#"), F.col("page_id").cast("string")))
    name = F.concat(F.lit("in/v"), (F.col("page_id") % 10).cast("string"), F.lit(".zip"))
    archives = p.filter("page_id % 2 = 0").groupBy(name.alias("archive")).agg(F.collect_list("path").alias("extracted"))
    return attach_archive(p, archives).select("page_id", "stem", "dir")


REORDER = """pg AS (SELECT chapter_id AS project, page_no, concat('ch', CAST(chapter_id AS VARCHAR), '/', CAST(page_id AS VARCHAR), '/p', CAST(page_id % 5 AS VARCHAR), '.png') AS path, page_id FROM fx_pages),
tk AS (SELECT project, -page_no AS pos, CASE WHEN project % 7 = 0 AND page_no = 0 THEN 'gone.png' WHEN page_id % 2 = 0 THEN path ELSE concat('p', CAST(page_id % 5 AS VARCHAR), '.png') END AS token FROM pg)"""


@query(f"""WITH {REORDER}, l AS (SELECT pg.project, any_value(t.l) AS tokens, list({{'p': path, 'b': regexp_extract(path, '([^/]*)$', 1)}} ORDER BY page_no) AS paths FROM pg JOIN (SELECT project, list({{'pos': CAST(pos AS BIGINT), 'token': token, 's': CAST(NULL AS STRUCT(pos BIGINT, path VARCHAR)[])}} ORDER BY pos) AS l FROM tk GROUP BY 1) t ON t.project=pg.project GROUP BY 1),
f AS (SELECT project, len(paths) AS n, list_reduce(tokens, lambda a, x: {{'pos': x.pos, 'token': x.token, 's': list_append(a.s, {{'pos': x.pos, 'path': coalesce(
 list_filter(paths, lambda k: k.p = x.token AND NOT list_contains(list_transform(a.s, lambda u: u.path), k.p))[1].p, list_filter(paths, lambda k: k.b = x.token AND NOT list_contains(list_transform(a.s, lambda u: u.path), k.p))[1].p)}})}},
 {{'pos': CAST(0 AS BIGINT), 'token': '', 's': CAST([] AS STRUCT(pos BIGINT, path VARCHAR)[])}}).s AS s FROM l)
SELECT project, u.pos AS pos, CASE WHEN len(list_filter(s, lambda k: k.path IS NULL)) = 0 AND len(s) = n THEN u.path END AS path FROM (SELECT *, unnest(s) AS u FROM f) q""")
def j22_resolve_reorder(t: Tables) -> DataFrame:
    p = F.col("page_id").cast("string")
    base = F.concat(F.lit("p"), (F.col("page_id") % 5).cast("string"), F.lit(".png"))
    pages = t.fx_pages.select(F.col("chapter_id").alias("project"), "page_no", F.concat(F.lit("ch"), F.col("chapter_id").cast("string"), F.lit("/"), p, F.lit("/"), base).alias("path"), "page_id", base.alias("base"))
    token = F.when((F.col("project") % 7 == 0) & (F.col("page_no") == 0), "gone.png").when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.col("base"))
    return J.resolve_reorder(pages.select("project", (-F.col("page_no")).alias("pos"), token.alias("token")), pages.select("project", "page_no", "path"))


@query("""WITH i AS (SELECT chapter_id, block_idx AS item_idx, x1 - 120 AS x, y1 AS y, x2-x1+500 AS w, y2-y1 AS h, array_to_string(list_transform(range(0, block_idx % 5 + 1), lambda k: concat('l', CAST(k AS VARCHAR))), chr(10)) AS text FROM fx_strip),
c AS (SELECT i.*, l.page_no, l.top, (760-l.width)/2.0 AS dx, greatest(i.x, (760-l.width)/2.0) AS cl, least(i.x+i.w, (760-l.width)/2.0+l.width) AS cr, greatest(i.y, l.top) AS ct, least(i.y+i.h, l.top+l.height) AS cb FROM i JOIN fx_layout l ON l.chapter_id=i.chapter_id AND i.y < l.top+l.height AND i.y+i.h > l.top),
r AS (SELECT *, str_split(text, chr(10)) AS ls, greatest(0.0, CAST(ct-y AS DOUBLE)/h) AS ts, least(1.0, CAST(cb-y AS DOUBLE)/h) AS bs FROM c WHERE cl < cr AND ct < cb),
n AS (SELECT *, len(ls) AS n, least(CAST(trunc(ts*len(ls)) AS BIGINT), len(ls)-1) AS s0 FROM r), e AS (SELECT *, greatest(s0, least(CAST(trunc(bs*n) AS BIGINT), n)) AS e0 FROM n),
f AS (SELECT *, CASE WHEN s0 >= e0 AND bs-ts > 0.1 AND ts >= 0.5 THEN greatest(0, e0-1) ELSE s0 END AS s1, CASE WHEN s0 >= e0 AND bs-ts > 0.1 AND ts < 0.5 THEN greatest(1, s0+1) WHEN s0 >= e0 AND bs-ts <= 0.1 THEN s0 ELSE e0 END AS e1 FROM e)
SELECT chapter_id, item_idx, page_no, cl-dx AS x, ct-top AS y, cr-cl AS w, cb-ct AS h, array_to_string(ls[s1+1:e1], chr(10)) AS text FROM f""")
def p21b_clip_text_items(t: Tables) -> DataFrame:
    from ..operators import strips as S

    line = F.transform(F.sequence(F.lit(0).cast("long"), F.col("block_idx") % 5), lambda k: F.concat(F.lit("l"), k.cast("string")))
    items = t.fx_strip.select("chapter_id", F.col("block_idx").alias("item_idx"), (F.col("x1") - 120).alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1") + 500).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.array_join(line, "\n").alias("text"))
    return S.clip_text_items(items, t.fx_layout, 760)
