"""Streaming operators over the event table, run to the end of what there is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.folders import drop_at_end, shared_folder
from ..sources.inputs import read_memlog
from ..streaming import streams as S
from .fixtures import VIEWS, Tables
from .registry import query
from .strips import EDGE, MATCHES, MERGED, SEAMS, SLICE, slice_blocks


def live(t: Tables, view: str) -> DataFrame:
    """A fixture view of events as a stream over the table's file or folder."""
    schema = t.events.schema
    path = f"{t.sf_dir}/events.parquet"
    files = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = files.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files).isDirectory()
    reader = t.spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return S.event_time(t.spark.sql(re.sub(r"\bFROM events\b", "FROM {events}", VIEWS[view]), events=stream))


@query("SELECT run_id, count(*) AS events, arg_max(path, [epoch_us(ts), event_id]) AS path FROM fx_runs GROUP BY 1")
def t1_stream_progress(t: Tables) -> DataFrame:
    return S.run_to_end(S.stream_progress(live(t, "fx_runs")), "complete")


@query("SELECT run_id, path, list_sort(list(DISTINCT reason)) AS reasons FROM fx_runs WHERE kind='skip' AND reason NOT IN ('User-skipped','Text Blocks') GROUP BY 1,2")
def t2_stream_report(t: Tables) -> DataFrame:
    return S.run_to_end(S.stream_report(live(t, "fx_runs")), "complete")


def in_batches(t: Tables, rows: DataFrame, part: Column, parts: int, each: int = 500_000) -> DataFrame:
    """The rows as a stream of so many batches, in the order of part; a batch is as many files of about `each` rows as all parts need on average."""
    place = shared_folder(t.spark, "batches")
    drop_at_end(t.spark, place)
    dealt = shared_folder(t.spark, "dealt")
    drop_at_end(t.spark, dealt)
    rows.withColumn("__part", part.cast("int")).write.partitionBy("__part").parquet(dealt)  # once, by all tasks
    back = t.spark.read.schema(StructType([*rows.schema.fields, StructField("__part", IntegerType())])).parquet(dealt)
    files = max(1, round(back.count() / parts / each))
    for i in range(parts):  # one after the other: files are taken in the order of their times
        one = back.filter(F.col("__part") == i).drop("__part")
        (one.coalesce(1) if files == 1 else one.repartition(files)).write.parquet(f"{place}/{i:03d}")
        for _ in range(files - len(t.spark.read.parquet(f"{place}/{i:03d}").inputFiles()) if files > 1 else 0):
            one.limit(0).coalesce(1).write.mode("append").parquet(f"{place}/{i:03d}")  # no task writes an empty file of many
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(place)


def _runs_in_batches(t: Tables) -> DataFrame:
    """Runs over six batches by time, now and then ended."""
    d = t.fx_runs.withColumn("ended", F.col("event_id") % 499 == 0)
    ends = d.agg(F.min("ts").cast("timestamp").cast("double").alias("a"), F.max("ts").cast("timestamp").cast("double").alias("b")).first()
    share = (F.col("ts").cast("timestamp").cast("double") - ends["a"]) / (ends["b"] - ends["a"])
    return in_batches(t, d, F.least(F.floor(share * 6), F.lit(5)), 6)


_EPOCHS = "e AS (SELECT *, sum(CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS epoch FROM fx_runs)"


@query(f"WITH {_EPOCHS} SELECT run_id, path, reason, arg_min(event_id, [epoch_us(ts), event_id]) AS event_id FROM e WHERE event_id % 499 <> 0 GROUP BY run_id, epoch, path, reason")
def t4_stream_deltas(t: Tables) -> DataFrame:
    """The first of each path and reason within a run, over six batches."""
    found = S.stream_deltas(_runs_in_batches(t).select("run_id", "path", "reason", "ts", "event_id", "ended"), ["path", "reason"], ["ts", "event_id"])
    return S.run_to_end(found, "append").select("run_id", "path", "reason", "event_id")


@query(f"WITH {_EPOCHS} SELECT run_id, path, arg_min(event_id, [epoch_us(ts), event_id]) AS event_id FROM e WHERE reason = 'Image Load' AND event_id % 499 <> 0 GROUP BY run_id, epoch, path")
def t5_once_per_path(t: Tables) -> DataFrame:
    errors = _runs_in_batches(t).filter("ended or reason = 'Image Load'").select("run_id", "path", "ts", "event_id", "ended")
    return S.run_to_end(S.once_per_path(errors, ["ts", "event_id"]), "append").select("run_id", "path", "event_id")


@query("""WITH d AS (SELECT run_id, ts, lag(ts) OVER (PARTITION BY run_id ORDER BY ts) AS pv FROM fx_runs WHERE kind='page_done'),
s AS (SELECT *, sum(CASE WHEN pv IS NULL OR ts >= pv + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts) AS sid FROM d) SELECT run_id, min(ts) AS start, max(ts) AS last, count(*) AS pages FROM s GROUP BY run_id, sid""")
def t6_coalesce_saves(t: Tables) -> DataFrame:
    d = S.run_to_end(S.coalesce_saves(live(t, "fx_runs")), "complete")
    return d.select("run_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "pages")


@query("SELECT run_id, tag, date_trunc('hour', ts) AS start, min(rss_mb) AS low_mb, max(rss_mb) AS peak_mb, count(*) AS n FROM fx_memlog GROUP BY 1,2,3")
def t7_stream_memlog(t: Tables) -> DataFrame:
    d = S.run_to_end(S.stream_memlog(live(t, "fx_memlog")), "complete")
    return d.select("run_id", "tag", F.col("window.start").cast("timestamp_ntz").alias("start"), "low_mb", "peak_mb", "n")


@query(f"WITH {SEAMS}, {MATCHES}, {MERGED} SELECT chapter_id, slice_no, block_idx AS idx, x1, y1, x2, y2 FROM mg")
def t3_stream_seams(t: Tables) -> DataFrame:
    """Slices and end markers in any order over ten batches: the rows of j15_seam_merge."""
    part = F.struct("slice_no", F.col("block_idx").alias("idx"), *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
    chapters = slice_blocks(t).groupBy("chapter_id").agg(F.sort_array(F.collect_list(part)).alias("found"))  # eight slices of seven blocks at most
    of_slice = F.transform(F.filter("found", lambda b: b["slice_no"] == F.col("slice_no")), lambda b: b.dropFields("slice_no"))
    slices = chapters.withColumn("slice_no", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<long>")))
    every = slices.select("chapter_id", "slice_no", F.lit(SLICE).cast("long").alias("height"), F.when(F.col("slice_no") < 8, of_slice).alias("blocks"))  # 8: the end
    stream = in_batches(t, every, F.pmod(F.xxhash64("chapter_id", "slice_no"), F.lit(10)), 10)
    return S.run_to_end(S.stream_seams(stream, EDGE), "append")


@query("SELECT run_id, tag, count(*) AS n, min(rss_mb) AS low_mb, max(rss_mb) AS peak_mb FROM fx_memlog GROUP BY 1, 2")
def s13_read_memlog(t: Tables) -> DataFrame:
    """Snapshots written as JSON lines, read back as a stream."""
    place = shared_folder(t.spark, "memlog")
    drop_at_end(t.spark, place)
    t.fx_memlog.select("ts", "run_id", "tag", "rss_mb").write.json(place)
    log = S.run_to_end(read_memlog(t.spark, place, stream=True), "append")
    return log.groupBy("run_id", "tag").agg(F.count("*").alias("n"), F.min("rss_mb").alias("low_mb"), F.max("rss_mb").alias("peak_mb"))
