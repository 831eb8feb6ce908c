"""Run reports, stores and exports: failures, saved pages, chapters, names, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import report as R
from ..functions import texts as T


def run_pages(pages: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths once each, in the order they were first asked for, without skipped pages."""
    first = requested.groupBy("path").agg(F.min("position").alias("position"))
    known = pages.filter(~F.col("skip")).select("path").distinct()
    return first.join(known, "path", "left_semi")


def collect_skips(events: DataFrame) -> DataFrame:
    """Reasons of each path of a run, distinct, in the order first seen; skips by the user or for lack of text don't count."""
    e = events.filter((F.col("kind") == "skip") & ~R.is_user_skip(F.col("reason")) & ~R.is_no_text(F.col("reason")))
    first = e.groupBy("run_id", "path", "reason").agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    listed = first.groupBy("run_id", "path").agg(F.sort_array(F.collect_list(F.struct("seen", "reason"))).alias("r"))
    return listed.select("run_id", "path", F.transform("r", lambda x: x["reason"]).alias("reasons"))


def finalise_report(skips: DataFrame, totals: DataFrame) -> DataFrame:
    n = skips.groupBy("run_id").agg(F.count("*").alias("skipped"))
    d = totals.join(n, "run_id", "left").na.fill(0, ["skipped"])
    total = F.greatest("previous_total", "current_total")
    return d.select("run_id", total.alias("total"), "skipped", F.greatest(total - F.col("skipped"), F.lit(0)).alias("completed"))


def carry_pending(previous: DataFrame, current: DataFrame, run: DataFrame) -> DataFrame:
    """Failures of earlier runs stay unless this run had the page; then this run's hold."""
    return previous.join(run.select("path"), "path", "left_anti").unionByName(current)


def resolve_entries(report: DataFrame, fixed: DataFrame) -> DataFrame:
    return report.join(fixed.select("path"), "path", "left_anti")


def retryable(report: DataFrame, pages: DataFrame) -> DataFrame:
    return report.join(pages.select("path"), "path", "left_semi")


def fully_translated(blocks: DataFrame) -> DataFrame:
    """Pages with text, every block of which is translated."""
    return blocks.filter("trim(text) <> ''").groupBy("page_id").agg(F.bool_and(F.trim("translation") != "").alias("ok")).filter("ok").select("page_id")


def diff_pages(old: DataFrame, new: DataFrame, key: str, row: list[str]) -> DataFrame:
    """vanished, added and changed keys; rows are compared by a hash."""
    digest = lambda c: F.sha2(F.to_json(F.struct(*row)), 256).alias(c)
    d = old.select(key, digest("a")).join(new.select(key, digest("b")), key, "full")
    state = F.when(F.col("b").isNull(), "vanished").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return d.select(key, state.alias("state")).filter("state is not null")


def all_pages(*tables: DataFrame) -> DataFrame:
    """Page keys of several tables, each once, in the order of the tables."""
    rows = [t.select("path", "position").withColumn("from_table", F.lit(i)) for i, t in enumerate(tables)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("path").agg(F.min(F.struct("from_table", "position")).alias("o")).select("path", "o.*")


def is_permutation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same values equally often."""
    n = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("n").alias("n"))
    return n.agg((F.coalesce(F.sum(F.abs("n")), F.lit(0)) == 0).alias("same"))


def save_plan(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents to store: each hash once, none that is stored already."""
    d = files.select(F.sha2("content", 256).alias("hash"), F.length("content").alias("size")).dropDuplicates(["hash"])
    return d.join(blobs.select("hash"), "hash", "left_anti")


def save_pages(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, size, mtime, hash and state of every page of a save, against what is stored (path, size, mtime, hash).

    state: new, changed, touched (hashed anew, the content is the same), same
    (path, size and mtime as stored, so the content isn't hashed) or vanished.
    Rows to upsert are those of new, changed and touched; save_plan gives the
    contents to store.
    """
    old = known.select("path", *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "hash")))
    d = files.join(old, "path", "full")
    gone, fresh = F.col("content").isNull(), F.col("old_hash").isNull()
    same = ~gone & ~fresh & (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    hashed = F.when(gone | same, F.col("old_hash")).otherwise(F.sha2("content", 256))
    d = d.select("path", "size", "mtime", hashed.alias("hash"), gone.alias("gone"), fresh.alias("fresh"), same.alias("same"), "old_hash")
    state = F.when(F.col("gone"), "vanished").when(F.col("fresh"), "new").when(F.col("same"), "same").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("changed")
    return d.select("path", "size", "mtime", "hash", state.alias("state"))


def materialise_plan(pages: DataFrame, ready: DataFrame) -> DataFrame:
    """Archives that still need entries read: which, and whether to read all at once (70 % or more are asked for)."""
    need = pages.join(ready.select("page_id"), "page_id", "left_anti")
    n = pages.groupBy("archive").agg(F.count("*").alias("entries"))
    d = need.groupBy("archive").agg(F.sort_array(F.collect_list("page_id")).alias("pages"))
    return d.join(n, "archive").select("archive", "pages", (F.size("pages") >= 0.7 * F.col("entries")).alias("bulk"))


def chapter_counts(pages: DataFrame) -> DataFrame:
    return pages.filter("trim(group_name) <> ''").groupBy(F.trim("group_name").alias("group_name")).agg(F.count("*").alias("pages"))


def needs_split(pages: DataFrame) -> DataFrame:
    base = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    return pages.groupBy("bundle").agg(((F.countDistinct("group_name") > 1) | (F.countDistinct(base) < F.count("*"))).alias("split"))


def default_group(stored: Column, archive: Column, bundle: Column) -> Column:
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(known(stored), known(archive), known(bundle))


def export_plan(pages: DataFrame, ext: str = ".zip") -> DataFrame:
    """Groups of a bundle in the order first seen, with their pages in order and an unused file name."""
    g = pages.groupBy("bundle", "group_name").agg(F.min("page_no").alias("first"), F.sort_array(F.collect_list("page_no")).alias("page_nos"))
    d = unique_names(g.withColumn("stem", T.safe_stem(F.col("group_name"))), ["bundle"], "first")
    return d.select("bundle", "group_name", "page_nos", F.concat("name", F.lit(ext)).alias("file"))


def unique_names(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stem, stem_02, stem_03 ...: equal stems, whatever their case, numbered in order."""
    n = F.row_number().over(Window.partitionBy(*keys, F.lower("stem")).orderBy(order))
    return df.withColumn("name", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.format_string("_%02d", n))))


def number_pages(df: DataFrame, part: str, order: str) -> DataFrame:
    """1-based numbers, padded to the width of the total."""
    w = Window.partitionBy(part)
    n, total = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return df.withColumn("n", n).withColumn("number", F.lpad(F.col("n").cast("string"), F.length(total.cast("string")), F.lit("0"))).drop("n")


def recent(df: DataFrame, most: int = 15) -> DataFrame:
    """Newest row of each path, pinned ones first, at most so many: the list is a report of fixed length."""
    d = df.groupBy("path").agg(F.max(F.struct("ts", "event_id")).alias("o"), F.bool_or("pinned").alias("pinned"))
    return d.select("path", F.col("o.ts").alias("ts"), F.col("o.event_id").alias("event_id"), "pinned").orderBy(F.desc("pinned"), F.desc("ts"), F.desc("event_id")).limit(most)


def first_per_tag(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id", "tag").agg(F.min_by(F.struct("event_id", "rss_mb"), F.struct("ts", "event_id")).alias("s")).select("run_id", "tag", "s.*")


def memlog_stats(log: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    return log.groupBy("run_id", "tag").agg(F.min_by("rss_mb", order).alias("first_mb"), F.max_by("rss_mb", order).alias("last_mb"), F.max("rss_mb").alias("peak_mb"), F.count("*").alias("n"))


def top_maps(log: DataFrame, n: int = 12) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc("rss_mb"), "event_id")
    return log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("run_id", "rank", "event_id", "rss_mb")


def request_batches(blocks: DataFrame, n: int = 25) -> DataFrame:
    """Non-blank texts of a page in requests of n."""
    w = Window.partitionBy("page_id").orderBy("block_idx")
    d = blocks.filter("trim(text) <> ''").withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))
    return d.groupBy("page_id", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]).alias("texts"))


def hist_quantile(hist: DataFrame, share: float) -> DataFrame:
    """The quantile of a histogram (key, low, high, n), linear within its bucket."""
    w = Window.partitionBy("key").orderBy("low")
    d = hist.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("key"))}).filter((F.col("upto") >= share * F.col("all")) & (F.col("n") > 0))
    first = d.groupBy("key").agg(F.min_by(F.struct("low", "high", "n", "upto", "all"), "low").alias("b"))
    b = F.col("b")
    part = (share * b["all"] - (b["upto"] - b["n"])) / b["n"]
    return first.select("key", (b["low"] + part * (b["high"] - b["low"])).alias("value"))


def page_history(pages: DataFrame) -> DataFrame:
    """Versions of each page in order, and which one is current."""
    return pages.select("page_id", F.posexplode("versions").alias("version", "hash"), "current").withColumn("is_current", F.col("version") == F.col("current")).drop("current")


def empty_pages(blocks: DataFrame) -> DataFrame:
    d = blocks.groupBy("page_id").agg(F.bool_or(F.trim("text") != "").alias("has_text"), F.bool_or(F.trim("translation") != "").alias("has_translation"))
    return d.withColumn("reason", F.when(~F.col("has_text"), "OCR").when(~F.col("has_translation"), "Translator")).filter("reason is not null").select("page_id", "reason")


def page_names(df: DataFrame) -> DataFrame:
    """File names within a chapter: the safe stem, page_%04d where it is empty, and the extension."""
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("page_no"))
    stem = F.regexp_extract("path", "([^/]*?)(\\.[^./]*)?$", 1)
    named = F.when(F.trim(stem) == "", F.format_string("page_%04d", n)).otherwise(T.safe_stem(stem))
    return df.withColumn("file", F.concat(named, T.safe_ext(F.col("path"))))


def write_page_json(pages: DataFrame, path: str) -> None:
    """One document for each page (chapter_id, page_id, json), in a folder for each chapter."""
    pages.select("chapter_id", F.to_json(F.struct("page_id", "json")).alias("value")).write.mode("overwrite").partitionBy("chapter_id").text(path)


def explode_legacy_state(df: DataFrame) -> DataFrame:
    """Old one-row states (maps by path) as a row for each path that has a state or a patch."""
    keys = F.array_union(F.map_keys("states"), F.map_keys("patches"))
    d = df.select("project_id", "states", "patches", F.explode(keys).alias("path"))
    return d.select("project_id", "path", F.try_element_at("states", F.col("path")).alias("state"), F.try_element_at("patches", F.col("path")).alias("patch"))
