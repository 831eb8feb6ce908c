"""Queries over reports, stores, exports, logs and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lang as L
from ..functions import report as R
from ..operators import reports as O
from .fixtures import Tables
from .registry import query

SKIPS = """fi AS (SELECT run_id, path, reason, min(ts) AS ts, arg_min(event_id, [epoch_us(ts), event_id]) AS ev FROM fx_runs WHERE kind='skip' AND reason NOT IN ('User-skipped','Text Blocks') GROUP BY 1,2,3),
sk AS (SELECT run_id, path, list(reason ORDER BY ts, ev) AS reasons FROM fi GROUP BY 1,2)"""


@query(f"WITH {SKIPS} SELECT run_id, path, reasons FROM sk")
def a10_collect_skips(t: Tables) -> DataFrame:
    return O.collect_skips(t.fx_runs)


@query(f"WITH {SKIPS}, n AS (SELECT run_id, count(*) AS skipped FROM sk GROUP BY 1), tt AS (SELECT run_id, count(DISTINCT path) AS cur, 45 - run_id AS prev FROM fx_runs GROUP BY 1) SELECT tt.run_id, greatest(prev,cur) AS total, coalesce(skipped,0) AS skipped, greatest(greatest(prev,cur)-coalesce(skipped,0),0) AS completed FROM tt LEFT JOIN n ON tt.run_id=n.run_id")
def a11_finalise_report(t: Tables) -> DataFrame:
    totals = t.fx_runs.groupBy("run_id").agg(F.countDistinct("path").alias("current_total")).withColumn("previous_total", 45 - F.col("run_id"))
    return O.finalise_report(O.collect_skips(t.fx_runs), totals)


@query(f"WITH {SKIPS}, p AS (SELECT * FROM sk WHERE run_id=0), c AS (SELECT * FROM sk WHERE run_id=1), r AS (SELECT DISTINCT path FROM fx_runs WHERE run_id=1 AND event_id % 2 = 0) SELECT path, reasons FROM p WHERE path NOT IN (SELECT path FROM r) UNION ALL SELECT path, reasons FROM c")
def j26_carry_pending(t: Tables) -> DataFrame:
    s = O.collect_skips(t.fx_runs)
    run = t.fx_runs.filter("run_id = 1 and event_id % 2 = 0").select("path").distinct()
    return O.carry_pending(s.filter("run_id = 0").drop("run_id"), s.filter("run_id = 1").drop("run_id"), run)


@query(f"WITH {SKIPS} SELECT run_id, path FROM sk WHERE path NOT LIKE 'p1%'")
def j27_resolve_entries(t: Tables) -> DataFrame:
    s = O.collect_skips(t.fx_runs)
    return O.resolve_entries(s, s.filter("path like 'p1%'").select("path").distinct()).select("run_id", "path")


@query(f"WITH {SKIPS} SELECT run_id, path FROM sk WHERE path IN ('p3.png','p7.png','p12.png')")
def j28_retryable(t: Tables) -> DataFrame:
    pages = t.spark.createDataFrame([("p3.png",), ("p7.png",), ("p12.png",), ("gone.png",)], "path string")
    return O.retryable(O.collect_skips(t.fx_runs), pages).select("run_id", "path")


@query("SELECT page_id FROM (SELECT page_id, bool_and(trim(translation) <> '') AS ok FROM fx_blocks WHERE trim(text) <> '' GROUP BY 1) x WHERE ok")
def j33_fully_translated(t: Tables) -> DataFrame:
    return O.fully_translated(t.fx_blocks)


@query("SELECT page_id, CASE WHEN NOT bool_or(trim(text)<>'') THEN 'OCR' ELSE 'Translator' END AS reason FROM fx_blocks GROUP BY 1 HAVING NOT bool_or(trim(text)<>'') OR NOT bool_or(trim(translation)<>'')")
def a9_empty_pages(t: Tables) -> DataFrame:
    return O.empty_pages(t.fx_blocks)


@query("SELECT path, min(page_id) AS position FROM fx_pages WHERE page_id % 4 < 2 AND path IN (SELECT path FROM fx_pages WHERE NOT skip) GROUP BY path")
def p18_run_pages(t: Tables) -> DataFrame:
    requested = t.fx_pages.filter("page_id % 4 < 2").select("path", F.col("page_id").alias("position"))
    return O.run_pages(t.fx_pages, requested)


@query("""SELECT path, CASE WHEN page_id % 10 = 0 THEN 'vanished' WHEN page_id % 10 = 1 THEN 'changed' ELSE 'added' END AS state FROM (SELECT concat(path, '#', CAST(page_id AS VARCHAR(20))) AS path, page_id FROM fx_pages) x WHERE page_id % 10 < 3""")
def u2_diff_pages(t: Tables) -> DataFrame:
    p = t.fx_pages.select(F.concat("path", F.lit("#"), F.col("page_id").cast("string")).alias("path"), "page_id", "width", "height")
    new = p.filter("page_id % 10 <> 0").withColumn("height", F.col("height") + (F.col("page_id") % 10 == 1).cast("int"))
    return O.diff_pages(p.filter("page_id % 10 <> 2"), new, "path", ["width", "height"])


@query("""WITH a AS (SELECT path, page_id AS position, page_id % 3 AS from_table FROM fx_pages) SELECT path, CAST(from_table AS INT) AS from_table, position FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY from_table, position) AS rn FROM a) x WHERE rn = 1""")
def u1_all_pages(t: Tables) -> DataFrame:
    p = t.fx_pages.select("path", F.col("page_id").alias("position"))
    return O.all_pages(*(p.filter(f"position % 3 = {i}") for i in range(3)))


@query("SELECT true AS same")
def u3_is_permutation(t: Tables) -> DataFrame:
    p = t.fx_pages.select("path", "page_no")
    return O.is_permutation(p, p.orderBy(F.desc("page_no")))


@query("SELECT DISTINCT sha256(content) AS hash, length(content) AS size FROM fx_files WHERE sha256(content) NOT IN (SELECT sha256(content) FROM fx_files WHERE file_id % 5 = 0)")
def s7_save_plan(t: Tables) -> DataFrame:
    blobs = t.fx_files.filter("file_id % 5 = 0").select(F.sha2("content", 256).alias("hash"))
    return O.save_plan(t.fx_files, blobs)


@query("""WITH n AS (SELECT chapter_id AS archive, count(*) AS entries FROM fx_pages GROUP BY 1), d AS (SELECT chapter_id AS archive, list(page_id ORDER BY page_id) AS pages FROM fx_pages WHERE page_id % 4 <> 0 GROUP BY 1)
SELECT d.archive, pages, len(pages) >= 0.7*entries AS bulk FROM d JOIN n ON d.archive=n.archive""")
def s5_materialise_plan(t: Tables) -> DataFrame:
    return O.materialise_plan(t.fx_pages.select(F.col("chapter_id").alias("archive"), "page_id"), t.fx_pages.filter("page_id % 4 = 0"))


NAMED = "CASE page_id % 5 WHEN 0 THEN 'Part A' WHEN 1 THEN 'part a' WHEN 2 THEN ' Part B ' WHEN 3 THEN '' ELSE 'x/y' END"


def _named(t: Tables) -> DataFrame:
    return t.fx_pages.withColumn("group_name", F.expr(NAMED)).withColumnRenamed("chapter_id", "bundle")


@query(f"SELECT trim(g) AS group_name, count(*) AS pages FROM (SELECT {NAMED} AS g FROM fx_pages) x WHERE trim(g) <> '' GROUP BY 1")
def a14_chapter_counts(t: Tables) -> DataFrame:
    return O.chapter_counts(_named(t))


@query(f"SELECT bundle, count(DISTINCT g) > 1 OR count(DISTINCT lower(regexp_extract(path,'([^/]*)$',1))) < count(*) AS split FROM (SELECT chapter_id AS bundle, path, {NAMED} AS g FROM fx_pages) x GROUP BY 1")
def a14_needs_split(t: Tables) -> DataFrame:
    return O.needs_split(_named(t))


@query(f"SELECT page_id, coalesce(nullif(trim({NAMED}),''), nullif(CASE WHEN page_id % 2 = 0 THEN 'arc' ELSE '' END,''), 'bundle') AS label FROM fx_pages")
def s12_default_group(t: Tables) -> DataFrame:
    archive = F.when(F.col("page_id") % 2 == 0, "arc").otherwise("")
    return _named(t).select("page_id", O.default_group(F.col("group_name"), archive, F.lit("bundle")).alias("label"))


@query(f"""WITH g AS (SELECT chapter_id AS bundle, {NAMED} AS group_name, page_no FROM fx_pages), a AS (SELECT bundle, group_name, min(page_no) AS first, list(page_no ORDER BY page_no) AS page_nos,
 CASE group_name WHEN ' Part B ' THEN 'Part B' WHEN '' THEN 'chapter' WHEN 'x/y' THEN 'x_y' ELSE group_name END AS stem FROM g GROUP BY 1,2),
n AS (SELECT *, row_number() OVER (PARTITION BY bundle, lower(stem) ORDER BY first) AS n FROM a) SELECT bundle, group_name, page_nos, concat(stem, CASE WHEN n=1 THEN '' ELSE concat('_', lpad(CAST(n AS VARCHAR), 2, '0')) END, '.zip') AS file FROM n""")
def s11_export_plan(t: Tables) -> DataFrame:
    return O.export_plan(_named(t))


@query("""WITH s AS (SELECT page_id, chapter_id, concat(CASE WHEN page_id % 2 = 0 THEN 'Page' ELSE 'page' END, CAST(page_id % 3 AS VARCHAR)) AS stem FROM fx_pages), n AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, lower(stem) ORDER BY page_id) AS n FROM s)
SELECT page_id, CASE WHEN n=1 THEN stem ELSE concat(stem, '_', lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INT), '0')) END AS name FROM n""")
def w10_unique_names(t: Tables) -> DataFrame:
    d = t.fx_pages.withColumn("stem", F.concat(F.when(F.col("page_id") % 2 == 0, "Page").otherwise("page"), (F.col("page_id") % 3).cast("string")))
    return O.unique_names(d, ["chapter_id"], "page_id").select("page_id", "name")


@query("""SELECT page_id, lpad(CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY page_id) AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY chapter_id) AS VARCHAR)) AS INT), '0') AS number FROM fx_pages""")
def s4_number_pages(t: Tables) -> DataFrame:
    return O.number_pages(t.fx_pages, "chapter_id", "page_id").select("page_id", "number")


@query("""WITH d AS (SELECT path, max(ts) AS ts, arg_max(event_id, [epoch_us(ts), event_id]) AS event_id, bool_or(event_id % 97 = 0) AS pinned FROM fx_runs GROUP BY path) SELECT path, event_id, pinned FROM d ORDER BY pinned DESC, ts DESC, event_id DESC LIMIT 15""")
def w15_recent(t: Tables) -> DataFrame:
    return O.recent(t.fx_runs.withColumn("pinned", F.col("event_id") % 97 == 0)).select("path", "event_id", "pinned")


@query("SELECT run_id, tag, arg_min(event_id, [epoch_us(ts), event_id]) AS event_id, arg_min(rss_mb, [epoch_us(ts), event_id]) AS rss_mb FROM fx_memlog GROUP BY 1,2")
def w16_first_per_tag(t: Tables) -> DataFrame:
    return O.first_per_tag(t.fx_memlog)


@query("SELECT run_id, tag, arg_min(rss_mb, [epoch_us(ts), event_id]) AS first_mb, arg_max(rss_mb, [epoch_us(ts), event_id]) AS last_mb, max(rss_mb) AS peak_mb, count(*) AS n FROM fx_memlog GROUP BY 1,2")
def a16_memlog_stats(t: Tables) -> DataFrame:
    return O.memlog_stats(t.fx_memlog)


@query("SELECT run_id, CAST(rank AS INT) AS rank, event_id, rss_mb FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rss_mb DESC, event_id) AS rank FROM fx_memlog) x WHERE rank <= 12")
def a17_top_maps(t: Tables) -> DataFrame:
    return O.top_maps(t.fx_memlog)


@query("""WITH d AS (SELECT page_id, block_idx, text, (row_number() OVER (PARTITION BY page_id ORDER BY block_idx) - 1) // 2 AS batch FROM fx_blocks WHERE trim(text) <> '') SELECT page_id, batch, list(text ORDER BY block_idx) AS texts FROM d GROUP BY 1,2""")
def a18_request_batches(t: Tables) -> DataFrame:
    return O.request_batches(t.fx_blocks, 2)


@query("""WITH h AS (SELECT run_id AS key, floor(rss_mb/10)*10 AS low, floor(rss_mb/10)*10+10 AS high, count(*) AS n FROM fx_memlog GROUP BY 1,2,3), c AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY low) AS upto, sum(n) OVER (PARTITION BY key) AS al FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY low) AS rn FROM c WHERE upto >= 0.9*al AND n > 0) SELECT key, round(low + (0.9*al-(upto-n))/n*(high-low), 6) AS value FROM f WHERE rn=1""")
def a19_hist_quantile(t: Tables) -> DataFrame:
    low = F.floor(F.col("rss_mb") / 10) * 10
    h = t.fx_memlog.groupBy(F.col("run_id").alias("key"), low.alias("low"), (low + 10).alias("high")).agg(F.count("*").alias("n"))
    return O.hist_quantile(h, 0.9).withColumn("value", F.round("value", 6))


@query("""SELECT page_id, CAST(i AS INT) AS version, md5(concat(path, CAST(i AS VARCHAR))) AS hash, i = page_id % 3 AS is_current FROM fx_pages, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE i <= page_no % 3""")
def w12_page_history(t: Tables) -> DataFrame:
    return O.page_history(t.fx_pages.select("page_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("page_no") % 3), lambda i: F.md5(F.concat("path", i.cast("string")))).alias("versions"), (F.col("page_id") % 3).alias("current")))


LOW = "lower(line)"
_SAYS = lambda *xs: "(" + " OR ".join(f"{LOW} LIKE '%{x}%'" for x in xs) + ")"
KIND = f"""CASE WHEN line = '' THEN 'none' WHEN {_SAYS('flagged as unsafe', 'content was flagged', 'safety filters')} THEN 'flagged' WHEN {_SAYS('insufficient credit')} THEN 'credits' WHEN {_SAYS('timed out', 'timeout')} THEN 'time'
WHEN {_SAYS('too many requests', 'rate limit', '429')} THEN 'rate' WHEN {_SAYS('unauthorized', 'invalid api key', '401', '403')} THEN 'auth' WHEN {_SAYS('connection', 'network', 'name or service not known', 'failed to establish')} THEN 'net'
WHEN {_SAYS('bad gateway', 'service unavailable', 'gateway timeout', '502', '503', '504')} THEN 'down' WHEN {_SAYS('jsondecodeerror', 'empty json', 'expecting value')} THEN 'json' ELSE 'other' END"""
#: Errors as they come, and some with lines around, cut or without a telling line.
RAW = """e AS (SELECT event_id, reason, CASE event_id % 7 WHEN 1 THEN concat(chr(10), '  File "a.py", line 1', chr(10), '  ', error, chr(10), 'more') WHEN 2 THEN concat(error, repeat('x', 200)) WHEN 3 THEN concat('something odd ', CAST(event_id AS VARCHAR)) ELSE error END AS error FROM fx_runs),
k0 AS (SELECT event_id, reason, CASE WHEN event_id % 7 <> 3 AND error LIKE '%Traceback%' THEN '' WHEN event_id % 7 = 1 THEN coalesce(nullif(str_split(trim(replace(error, 'File "a.py", line 1', ''), ' ' || chr(10)), chr(10))[1], ''), 'more') WHEN length(error) > 180 THEN concat(substr(error, 1, 177), '...') ELSE error END AS line FROM e)"""
DETAIL = "CASE kind WHEN 'none' THEN '' WHEN 'flagged' THEN 'The AI provider flagged this content' WHEN 'credits' THEN 'Insufficient credits' WHEN 'time' THEN 'Request timed out' WHEN 'rate' THEN 'Rate limited by provider' WHEN 'auth' THEN 'Authentication failed' WHEN 'net' THEN 'Network or connection error' WHEN 'down' THEN 'Provider unavailable' WHEN 'json' THEN 'Invalid translation response' ELSE 'Unexpected tool error' END"
ERRORS = f"{RAW}, k1 AS (SELECT *, {KIND} AS kind FROM k0), d AS (SELECT *, {DETAIL} AS detail FROM k1)"


def _raw_errors(t: Tables) -> DataFrame:
    n, e, s = F.col("event_id") % 7, F.col("error"), F.lit
    text = F.when(n == 1, F.concat(s('\n  File "a.py", line 1\n  '), e, s("\nmore"))).when(n == 2, F.concat(e, s("x" * 200))).when(n == 3, F.concat(s("something odd "), F.col("event_id").cast("string"))).otherwise(e)
    return t.fx_runs.withColumn("error", text)


@query(f"WITH {ERRORS} SELECT event_id, detail, kind = 'flagged' AS flagged, reason = 'User-skipped' AS user_skip, reason = 'Text Blocks' AS no_text, line FROM d")
def f15_f17_errors(t: Tables) -> DataFrame:
    e = F.col("error")
    line = R.error_line(e)
    return _raw_errors(t).select("event_id", R.error_detail(e).alias("detail"), R.is_flagged(line).alias("flagged"), R.is_user_skip(F.col("reason"), e).alias("user_skip"), R.is_no_text(F.col("reason")).alias("no_text"), line.alias("line"))


_BY_REASON = "CASE WHEN reason = 'OCR' THEN 'Try another text recognition tool' WHEN reason IN ('Translator', 'Translation') THEN 'Try another translator' ELSE '{}' END"
ACTION = f"""CASE kind WHEN 'flagged' THEN {_BY_REASON.format('Try another tool')} WHEN 'credits' THEN 'Buy more credits' WHEN 'time' THEN 'Try again' WHEN 'rate' THEN 'Wait and try again' WHEN 'auth' THEN 'Check API settings'
WHEN 'net' THEN 'Check your connection' WHEN 'down' THEN 'Try again later' WHEN 'json' THEN 'Try again' ELSE CASE WHEN reason = 'Text Blocks' THEN '' ELSE {_BY_REASON.format('Try again')} END END"""


@query(f"""WITH {ERRORS}, a AS (SELECT *, {ACTION} AS action FROM d)
SELECT event_id, action, concat(CASE reason WHEN 'OCR' THEN 'Text recognition failed' WHEN 'Translator' THEN 'Translation failed' WHEN 'Text Blocks' THEN 'No text blocks detected' WHEN 'Image Load' THEN 'Image could not be opened' ELSE 'Page processing failed' END,
 CASE WHEN detail <> '' THEN concat(': ', detail) ELSE '' END, CASE WHEN action <> '' THEN concat('. ', action, '.') ELSE '' END) AS told FROM a""")
def f18_f19_reasons(t: Tables) -> DataFrame:
    r, e = F.col("reason"), F.col("error")
    return _raw_errors(t).select("event_id", R.error_action(r, e).alias("action"), R.skip_reason(r, e).alias("told"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN reason WHEN 1 THEN error ELSE 'bad field' END AS told, CASE WHEN event_id % 4 = 0 THEN 'credits' WHEN event_id % 4 = 1 AND (CASE event_id % 3 WHEN 0 THEN reason WHEN 1 THEN error ELSE 'bad field' END) LIKE '%flagged%' THEN 'flagged' WHEN event_id % 4 = 2 THEN 'server' ELSE 'other' END AS kind FROM fx_runs""")
def f20_http_error(t: Tables) -> DataFrame:
    n = F.col("event_id")
    body = F.when(n % 3 == 0, F.to_json(F.struct(F.col("reason").alias("detail")))).when(n % 3 == 1, F.to_json(F.struct(F.struct(F.col("error").alias("message")).alias("detail")))).otherwise('{"detail":[{"msg":"bad field"}]}')
    status = F.when(n % 4 == 0, 402).when(n % 4 == 1, 400).when(n % 4 == 2, 503).otherwise(404)
    told, kind = R.http_error(status, F.col("body"))
    return t.fx_runs.withColumn("body", body).select("event_id", told.alias("told"), kind.alias("kind"))


@query("""WITH s AS (SELECT event_id, event_id % 10 AS i, event_id % 11 AS step FROM fx_runs)
SELECT event_id, CASE WHEN i < 7 THEN 90*(i + step/10.0)/7 ELSE 90 + 10*(i - 7 + step/10.0)/3 END AS pct,
CASE step WHEN 0 THEN 'start-image' WHEN 1 THEN 'text-block-detection' WHEN 2 THEN 'ocr-processing' WHEN 3 THEN 'translation' WHEN 5 THEN 'pre-inpaint-setup' WHEN 7 THEN 'inpainting' WHEN 9 THEN 'text-rendering-prepare' WHEN 10 THEN 'save-and-finish' ELSE concat('stage-', CAST(step AS VARCHAR)) END AS stage FROM s""")
def f33_progress(t: Tables) -> DataFrame:
    i, step = F.col("event_id") % 10, F.col("event_id") % 11
    return t.fx_runs.select("event_id", R.progress_pct(i, F.lit(7), step, F.lit(10), F.lit(3)).alias("pct"), R.stage_name(step).alias("stage"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id END AS subscription, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 1 END AS one_time, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id + 1 END AS total FROM fx_runs")
def f34_credits(t: Tables) -> DataFrame:
    n = F.col("event_id")
    c = F.when(n % 2 == 0, n.cast("string")).otherwise(F.to_json(F.struct(n.alias("subscription"), F.lit(1).alias("one_time"), (n + 1).alias("total"))))
    return t.fx_runs.select("event_id", R.parse_credits(c).alias("c")).select("event_id", "c.*")


SCRIPT = "CASE WHEN script LIKE 'Japanese%' THEN 'Japanese' WHEN script LIKE 'HanS%' THEN 'HanS' ELSE script END"
SUM = f"""s AS (SELECT page_id, {SCRIPT} AS script, sum((x2-x1)*(y2-y1)) AS area, min(block_idx) AS first FROM fx_blocks WHERE {SCRIPT} IN ('Latin','Japanese','Hangul','HanS','HanT','Cyrillic') GROUP BY 1,2),
r AS (SELECT *, sum(area) OVER (PARTITION BY page_id) AS al, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, first) AS rn FROM s),
dom AS (SELECT p.page_id, CASE WHEN r.area*1.0/r.al >= 0.7 THEN r.script ELSE '' END AS script, coalesce(r.script, '') AS loose FROM (SELECT DISTINCT page_id FROM fx_blocks) p LEFT JOIN r ON p.page_id=r.page_id AND r.rn=1)"""


@query(f"WITH {SUM} SELECT page_id, coalesce(script,'') AS script FROM dom")
def a1_dominant_script(t: Tables) -> DataFrame:
    from ..operators import languages as G

    return G.dominant_script(t.fx_blocks)


@query(f"WITH {SUM} SELECT page_id, CASE coalesce(nullif(coalesce(script,''),''), loose) WHEN 'Japanese' THEN 'Japanese' WHEN 'Hangul' THEN 'Korean' WHEN 'HanS' THEN 'Chinese' WHEN 'HanT' THEN 'Chinese' WHEN 'Cyrillic' THEN 'Russian' ELSE 'Auto' END AS language FROM dom")
def a2_auto_language(t: Tables) -> DataFrame:
    from ..operators import languages as G

    return G.resolve_auto_lang(t.fx_blocks)


@query(f"""WITH {SUM}, b AS (SELECT f.page_id, CASE WHEN {SCRIPT.replace('script', 'f.script')} IN ('Latin','Japanese','Hangul','HanS','HanT','Cyrillic') THEN {SCRIPT.replace('script', 'f.script')} ELSE coalesce(dom.script,'') END AS s FROM fx_blocks f JOIN dom ON f.page_id=dom.page_id)
SELECT page_id, CASE s WHEN 'Latin' THEN 'latin' WHEN 'Japanese' THEN 'japanese' WHEN 'Hangul' THEN 'korean' WHEN 'Cyrillic' THEN 'cyrillic' ELSE 'chinese' END AS bucket, count(*) AS blocks FROM b GROUP BY 1,2""")
def a3_route_blocks(t: Tables) -> DataFrame:
    from ..operators import languages as G

    return G.route_blocks(t.fx_blocks).groupBy("page_id", "bucket").agg(F.count("*").alias("blocks"))


@query(f"""SELECT page_id, block_idx, {SCRIPT} AS script, CASE {SCRIPT} WHEN 'Latin' THEN 'en' WHEN 'Japanese' THEN 'ja' WHEN 'Hangul' THEN 'ko' WHEN 'Cyrillic' THEN 'ru' ELSE 'zh' END AS code,
CASE {SCRIPT} WHEN 'Japanese' THEN 'Japanese' WHEN 'Hangul' THEN 'Korean' WHEN 'HanS' THEN 'Chinese' WHEN 'Cyrillic' THEN 'Russian' ELSE 'Auto' END AS language, CASE {SCRIPT} WHEN 'Latin' THEN 'latin' WHEN 'Japanese' THEN 'japanese' WHEN 'Hangul' THEN 'korean' WHEN 'Cyrillic' THEN 'cyrillic' ELSE 'chinese' END AS bucket, {SCRIPT} IN ('Latin','Japanese','Hangul','HanS','HanT','Cyrillic') AS ok FROM fx_blocks""")
def f1_f2_scripts(t: Tables) -> DataFrame:
    s = F.col("script")
    return t.fx_blocks.select("page_id", "block_idx", L.normalize_script(s).alias("script"), L.script_lang(s).alias("code"), L.script_language(s).alias("language"), L.ocr_bucket(s).alias("bucket"), L.script_ok(s).alias("ok"))


@query("""WITH c AS (SELECT page_id, block_idx, CASE (page_id+block_idx) % 7 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'ja' WHEN 2 THEN 'en' WHEN 3 THEN 'ar' WHEN 4 THEN 'he' WHEN 5 THEN 'hr' ELSE 'pt' END AS code FROM fx_blocks)
SELECT page_id, block_idx, CASE code WHEN 'zh-CN' THEN 'Simplified Chinese' WHEN 'ja' THEN 'Japanese' WHEN 'en' THEN 'English' WHEN 'ar' THEN 'Arabic' WHEN 'he' THEN 'Hebrew' WHEN 'hr' THEN 'Croatian' ELSE 'Portuguese' END AS name, code AS back, code IN ('ar', 'he') AS rtl, code IN ('zh-CN','ja') AS no_space,
CASE code WHEN 'zh-CN' THEN 'zh-Hans' ELSE code END AS a, CASE code WHEN 'zh-CN' THEN 'ZH-HANS' WHEN 'en' THEN 'EN-US' WHEN 'pt' THEN 'PT-PT' ELSE upper(code) END AS b, CASE code WHEN 'zh-CN' THEN 'zh' ELSE code END AS c FROM c""")
def f3_f5_codes(t: Tables) -> DataFrame:
    from ..functions import texts as T

    n = (F.col("page_id") + F.col("block_idx")) % 7
    code = F.element_at(F.array(*map(F.lit, ("zh-CN", "ja", "en", "ar", "he", "hr", "pt"))), (n + 1).cast("int"))
    d = t.fx_blocks.withColumn("code", code)
    name = L.canonical_lang(F.col("code"))
    return d.select("page_id", "block_idx", name.alias("name"), L.lang_code(name).alias("back"), L.is_rtl(F.col("code")).alias("rtl"), T.is_no_space(F.col("code")).alias("no_space"), *(L.provider_code(F.col("code"), p).alias(p) for p in "abc"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN concat('page_', lpad(CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY page_no) AS VARCHAR), 4, '0'), '.png') ELSE concat('p', CAST(page_id % 37 AS VARCHAR), '.png') END AS file FROM fx_pages")
def w11_page_names(t: Tables) -> DataFrame:
    d = t.fx_pages.withColumn("path", F.when(F.col("page_id") % 6 == 0, "x/.png").otherwise(F.col("path")))
    return O.page_names(d).select("page_id", "file")


@query("""SELECT chapter_id AS project_id, path, CASE WHEN max(page_id % 3) > 0 THEN 's' END AS state, CASE WHEN min(page_id % 3) = 0 THEN 'p' END AS patch FROM (SELECT chapter_id, concat(path, '#', CAST(page_id AS VARCHAR)) AS path, page_id FROM fx_pages) x GROUP BY 1,2""")
def s9_legacy_state(t: Tables) -> DataFrame:
    p = t.fx_pages.withColumn("path", F.concat("path", F.lit("#"), F.col("page_id").cast("string")))
    entry = lambda keep, v: F.map_from_entries(F.collect_list(F.when(keep, F.struct(F.col("path").alias("key"), F.lit(v).alias("value")))))
    old = p.groupBy(F.col("chapter_id").alias("project_id")).agg(entry(F.col("page_id") % 3 > 0, "s").alias("states"), entry(F.col("page_id") % 3 == 0, "p").alias("patches"))
    return O.explode_legacy_state(old)
