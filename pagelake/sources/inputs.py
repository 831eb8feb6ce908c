"""Inputs: which come from archives, memory logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "\\.(cbz|zip|epub|cbt|tar|cbr|rar|cb7|7z|pdf)$"


def plan_inputs(asked: DataFrame) -> DataFrame:
    """Which rows come from an archive, and the label: the archive's stem, or chapter for loose files."""
    archive = F.lower("source").rlike(ARCHIVE)
    stem = F.regexp_extract("source", "([^/]*)\\.[^.]*$", 1)
    return asked.withColumns({"archive": archive, "label": F.coalesce(F.nullif(stem, F.lit("")), F.lit("chapter"))})


def read_memlog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Memory snapshots, an object on each line."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("ts timestamp, run_id long, tag string, rss_mb double").json(path)


def attach_archive(pages: DataFrame, archives: DataFrame) -> DataFrame:
    """The archive that each page was taken from, its stem and folder; pages of none get their own folder."""
    a = archives.select(F.explode("extracted").alias("path"), F.col("archive"))
    d = pages.join(a, "path", "left")
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    return d.withColumns({"stem": F.coalesce(F.nullif(F.regexp_extract("archive", "([^/]*)\\.[^.]*$", 1), F.lit("")), F.lit("")), "dir": F.coalesce(folder(F.col("archive")), folder(F.col("path")))})
