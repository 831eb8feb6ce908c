"""Scripts of pages by area, and the reader each block goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lang as L


def _shares(blocks: DataFrame) -> DataFrame:
    """The script of largest area of each page, the earliest on ties, and its share."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    s = blocks.filter(L.script_ok(F.col("script"))).groupBy("page_id", L.normalize_script(F.col("script")).alias("script")).agg(F.sum(area).alias("area"), F.min("block_idx").alias("first"))
    best = s.groupBy("page_id").agg(F.max(F.struct("area", (-F.col("first")).alias("neg"), "script")).alias("m"), F.sum("area").alias("all"))
    d = best.select("page_id", F.col("m.script").alias("top"), F.try_divide("m.area", "all").alias("share"))
    return blocks.select("page_id").distinct().join(d, "page_id", "left")


def dominant_script(blocks: DataFrame, least: float = 0.7) -> DataFrame:
    return _shares(blocks).select("page_id", F.when(F.col("share") >= least, F.col("top")).otherwise("").alias("script"))


def resolve_auto_lang(blocks: DataFrame) -> DataFrame:
    """The language of a sure script, else of the largest; Latin leaves it open."""
    return _shares(blocks).select("page_id", L.script_language(F.coalesce("top", F.lit(""))).alias("language"))


def route_blocks(blocks: DataFrame) -> DataFrame:
    """Each block's own script if a reader knows it, else the page's; its language code and bucket."""
    page = dominant_script(blocks).withColumnRenamed("script", "page_script")
    own = L.normalize_script(F.col("script"))
    d = blocks.join(page, "page_id").withColumn("used", F.when(L.script_ok(F.col("script")), own).otherwise(F.col("page_script")))
    return d.select("page_id", "block_idx", "used", L.script_lang(F.col("used")).alias("code"), L.ocr_bucket(F.col("used")).alias("bucket"))
