"""Fixture views: box, page, line, block, cache and event tables made from the given tables.

Each view is one SQL text that Spark and DuckDB both run unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_det": """
        SELECT page_id, det_idx, label, score,
               CASE WHEN label = 0 THEN greatest(x-80, 0) ELSE x END AS x1,
               CASE WHEN label = 0 THEN greatest(y-80, 0) ELSE y END AS y1,
               CASE WHEN label = 0 THEN x+w+200 ELSE x+w END AS x2,
               CASE WHEN label = 0 THEN y+h+200 ELSE y+h END AS y2
        FROM (SELECT page_id, det_idx,
                     CASE WHEN det_idx % 3 = 0 THEN 0 WHEN rf = 'R' THEN 1 ELSE 2 END AS label, dc * 10 AS score,
                     (pk*37 + det_idx*61) % 600 AS x, (sk*53 + det_idx*97) % 700 AS y,
                     CAST(40 + q*4 AS BIGINT) AS w, 30 + (pk*11) % 160 AS h
              FROM (SELECT l_orderkey AS page_id, l_linenumber AS det_idx, min(l_partkey) AS pk, min(l_suppkey) AS sk,
                           min(l_quantity) AS q, min(l_returnflag) AS rf, min(l_discount) AS dc
                    FROM lineitem GROUP BY l_orderkey, l_linenumber) k) b""",
    "fx_text": "SELECT * FROM fx_det WHERE label > 0",
    "fx_bubble": "SELECT * FROM fx_det WHERE label = 0",
    "fx_pages": """
        SELECT o_custkey AS chapter_id, o_orderkey AS page_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS page_no,
               700 + (o_orderkey % 4) * 20 AS width, 800 + (o_orderkey * 7919) % 9000 AS height,
               concat('ch', CAST(o_custkey AS VARCHAR(20)), '/p', CAST(o_orderkey % 37 AS VARCHAR(20)), '.png') AS path,
               o_orderkey % 11 = 0 AS skip FROM orders""",
    "fx_lines": """
        SELECT d.page_id, d.det_idx AS block_idx, n.i AS line_idx, d.x1 + n.i*3 AS x1, d.y1 + n.i*20 AS y1,
               d.x2 - (d.det_idx % 5)*4 AS x2, d.y1 + n.i*20 + 16 AS y2
        FROM fx_det d JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n ON n.i <= (d.page_id + d.det_idx) % 3
        WHERE d.label > 0""",
    "fx_blocks": """
        SELECT conv_id AS page_id, turn AS block_idx,
               40 + (turn % 2)*420 + (conv_id % 7) AS x1, 60 + turn*90 AS y1,
               40 + (turn % 2)*420 + 300 AS x2, 60 + turn*90 + 70 AS y2, conv_id % 3 AS angle,
               CASE (conv_id*7 + turn) % 8 WHEN 0 THEN 'Latin' WHEN 1 THEN 'Japanese_vert' WHEN 2 THEN 'Japanese'
                    WHEN 3 THEN 'Hangul' WHEN 4 THEN 'HanS_vert-dn' WHEN 5 THEN 'Cyrillic' WHEN 6 THEN 'Greek' ELSE '' END AS script,
               CASE WHEN (conv_id + turn) % 9 = 0 THEN '...!?' WHEN (conv_id + turn) % 10 = 0 THEN '' ELSE text END AS text,
               CASE WHEN turn % 4 = 3 THEN '' ELSE upper(role) END AS translation
        FROM conversations""",
    "fx_cache": """
        SELECT page_id, CAST(block_idx AS INT) AS cached_idx,
               x1 + (block_idx*5) % 13 - 6 AS x1, y1 + (block_idx*3) % 7 - 3 AS y1,
               x2 + (block_idx*5) % 13 - 6 AS x2, y2 + (block_idx*3) % 7 - 3 AS y2, angle + (page_id % 2) AS angle,
               CASE WHEN page_id % 6 = 0 THEN concat(text, '~') ELSE text END AS source_text, concat('t:', script) AS value
        FROM fx_blocks WHERE (page_id + block_idx) % 5 <> 0""",
    "fx_runs": """
        SELECT user_id % 5 AS run_id, ts, concat('p', CAST(user_id % 40 AS VARCHAR(20)), '.png') AS path, event_id,
               CASE event_type WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'page_done' ELSE 'progress' END AS kind,
               CASE event_id % 6 WHEN 0 THEN 'OCR' WHEN 1 THEN 'Translator' WHEN 2 THEN 'Text Blocks' WHEN 3 THEN 'Image Load'
                    WHEN 4 THEN 'Translation' ELSE 'User-skipped' END AS reason,
               CASE event_id % 10 WHEN 0 THEN 'Request timed out after 30s' WHEN 1 THEN 'HTTP 429 Too Many Requests'
                    WHEN 2 THEN '401 Unauthorized' WHEN 3 THEN 'Connection refused' WHEN 4 THEN '503 Service Unavailable'
                    WHEN 5 THEN 'JSONDecodeError: Expecting value' WHEN 6 THEN 'content was flagged by safety filters'
                    WHEN 7 THEN 'Insufficient credits' WHEN 8 THEN 'Traceback (most recent call last): x' ELSE '' END AS error
        FROM events""",
    "fx_memlog": "SELECT user_id % 5 AS run_id, ts, event_id, event_type AS tag, value AS rss_mb FROM events",
    "fx_files": "SELECT doc_id AS file_id, text AS content FROM documents",
    # What an audit finds in place: some assets are missing.
    "fx_present": "SELECT file_id, content FROM fx_files WHERE file_id % 13 <> 0",
    "fx_assets": """
        SELECT doc_id AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'abc' WHEN doc_id % 7 = 0 THEN md5(concat(text, 'x'))
                                       ELSE md5(text) END AS expected FROM documents""",
    "fx_html": "SELECT page_id, html FROM pages",
    # The strip: pages stacked from offset 100 without gaps.
    "fx_layout": """
        SELECT chapter_id, page_id, page_no, width, height,
               CAST(100 + coalesce(sum(height) OVER (PARTITION BY chapter_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top
        FROM fx_pages""",
    # Items that page borders cut: one at the lower and one at the upper edge of each page.
    "fx_cut": """
        SELECT l.chapter_id, l.page_no, n.i AS idx, 100 + l.chapter_id % 7 + (l.page_no % 3) * 6 AS x1,
               CASE WHEN n.i = 0 THEN l.top + l.height - l.page_id % 20 - 60 ELSE l.top + l.page_id % 9 END AS y1,
               250 + l.chapter_id % 7 + (l.page_no % 3) * 6 + (l.page_id % 4) * 5 AS x2,
               CASE WHEN n.i = 0 THEN l.top + l.height - l.page_id % 20 ELSE l.top + l.page_id % 9 + 50 END AS y2,
               CASE WHEN l.page_id % 11 = 0 THEN 'b' ELSE 'a' END AS style,
               CAST((l.page_id % 4) * 0.5 AS DOUBLE) AS angle,
               CASE WHEN l.page_id % 5 = 0 THEN '' ELSE concat('t', CAST(l.page_id % 4 AS VARCHAR(20))) END AS text
        FROM fx_layout l CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) n""",
    # Boxes in strip coordinates: two for each page, some over the border to the next page.
    "fx_strip": """
        SELECT l.chapter_id, l.page_id * 2 + n.i AS block_idx, l.page_id % 300 AS x1,
               l.top + (l.page_id * 31 + n.i * 577) % l.height AS y1, l.page_id % 300 + 150 AS x2,
               l.top + (l.page_id * 31 + n.i * 577) % l.height + 60 + l.page_id % 90 AS y2
        FROM fx_layout l CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) n""",
}


def used(sql: str) -> list[str]:
    """The views a text needs, each after those it needs itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in out:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """The text with the views it needs in front, as DuckDB runs it."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used(sql))
    body = sql.strip()
    if not views:
        return body
    head, rest = re.match(r"(WITH RECURSIVE |WITH |)(.*)", body, re.S).groups()
    return f"{head}{views}, {rest}" if head else f"WITH {views} {rest}"


class Tables:
    """The given tables and the fixture views of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = with_views(f"SELECT * FROM {name}")
        needed = {t: self.__getattr__(t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
        for t, df in needed.items():
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **needed)
