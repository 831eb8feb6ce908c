"""The page flow as streams. Functions take a streaming (or batch) frame and give one back."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import drop_at_end, shared_folder

LATE = "1 hour"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state lies in RocksDB, beside the heap; a session that has chosen a provider of its own keeps it if it can do the same."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """ts as a time with zone, which a watermark needs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_progress(events: DataFrame) -> DataFrame:
    """Of each run: events so far, and the page last heard of."""
    order = F.struct("ts", "event_id")
    return events.groupBy("run_id").agg(F.count("*").alias("events"), F.max_by("path", order).alias("path"))


def stream_report(events: DataFrame) -> DataFrame:
    """Of each run and path: the distinct reasons of its skips."""
    skips = events.filter("kind = 'skip' and reason not in ('User-skipped', 'Text Blocks')")
    return skips.groupBy("run_id", "path").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


class _FirstOfRun(StatefulProcessor):
    """What a run has been told already, until the run ends."""

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "item string", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  Spark's names
        import pandas as pd

        frames = [f for f in rows if len(f)]
        if not frames:
            return
        d = pd.concat(frames).sort_values([*self.order, "ended"], kind="stable")
        fresh, known = [], {}
        for i, (item, ended) in enumerate(zip(d["item"], d["ended"], strict=True)):
            if ended:
                self.told.clear()
                known = {}
            elif item not in known:
                known[item] = True
                if not self.told.containsKey((item,)):
                    self.told.updateValue((item,), (1,))
                    fresh.append(i)
        yield d.iloc[fresh].drop(columns=["bucket", "item", "ended"])

    def close(self) -> None:
        pass


def first_of_run(events: DataFrame, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Of each run the events that are the first of their keys; columns as in events, but for `ended`.

    events: run_id, keys, order (columns that sort a run's events) and
    ended, true for a run's end, after which it may begin again. A run is
    remembered however long it goes on; it lies in `buckets` states by a hash of
    the keys, so a large one is no single task's, and an end goes to all of them.
    An end counts for what stands before it in its batch or has come in
    earlier ones; equal order counts the event first.
    """
    use_keyed_state(events.sparkSession)
    item = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    own = F.array(F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int"))
    d = events.withColumns({"item": item, "ended": F.coalesce("ended", F.lit(False))})
    d = d.withColumn("bucket", F.explode(F.when(F.col("ended"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(own)))
    schema = T.StructType([f for f in events.schema.fields if f.name != "ended"])
    columns = [f.name for f in schema.fields]
    return d.select(*columns, "bucket", "item", "ended").groupBy("run_id", "bucket").transformWithStateInPandas(_FirstOfRun(keys, order), schema, "append", "None")


def stream_deltas(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of a run's items, those that it has not published yet."""
    return first_of_run(items, keys, order)


def once_per_path(errors: DataFrame, order: list[str]) -> DataFrame:
    """A run's unreadable paths, each reported once."""
    return first_of_run(errors, ["path"], order)


def coalesce_saves(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Page-done events of a run that follow each other within the gap are one save."""
    done = events.filter("kind = 'page_done'")
    return done.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("pages"), F.max("ts").alias("last"))


def stream_memlog(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """Memory of each run and tag in tumbling windows."""
    return log.groupBy("run_id", "tag", F.window("ts", size)).agg(F.min("rss_mb").alias("low_mb"), F.max("rss_mb").alias("peak_mb"), F.count("*").alias("n"))


_PARTS = ("idx", "x1", "y1", "x2", "y2")


class _Seams(StatefulProcessor):
    """The slices of a chapter that wait for one before them, and the last one that hasn't been published.

    A call reads and writes one value. It holds the slices that wait and are
    fewer than `near` ahead of the one due; those further ahead lie in a map,
    so the value stays small however many there are.
    """

    def __init__(self, edge: float, first: int, timeout_ms: int | None, near: int = 16):
        self.edge, self.first, self.timeout_ms, self.near = edge, first, timeout_ms, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chapter = handle.getValueState("chapter", "due long, ahead long, body string")
        self.waiting = handle.getMapState("waiting", "slice_no long", "slice string")

    def _load(self) -> None:
        known = self.chapter.get()
        self.due, self.ahead, body = known or (self.first, 0, '[null, {}]')
        self.held, close = json.loads(body)  # held: number, height, consumed ids, blocks
        self.close_by = {int(k): v for k, v in close.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        self._load()
        for r in rows:
            self._add(r["slice_no"], (0, None) if r["blocks"] is None else (r["height"], [tuple(b[k] for k in _PARTS) for b in r["blocks"]]))
        out = self._go_on()
        self.chapter.update((self.due, self.ahead, json.dumps((self.held, self.close_by))))
        yield from self._rows(key, out)
        if self.timeout_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        """Nothing has come for long: what waits is published, gaps and all."""
        self._load()
        out = []
        ahead = [k[0] for k in self.waiting.keys()] if self.ahead else []
        for number in sorted({*self.close_by, *ahead}):
            self.due = max(number, self.due)
            out += self._go_on()
        out += self._publish(None)
        self._forget()
        self.chapter.clear()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass

    def _add(self, number: int, one: tuple) -> None:
        if number < self.due:  # it has come before
            return
        if number < self.due + self.near:
            self.close_by[number] = one
        else:
            self.ahead += not (self.ahead and self.waiting.containsKey((number,)))
            self.waiting.updateValue((number,), (json.dumps(one),))

    def _forget(self) -> None:
        if self.ahead:
            self.waiting.clear()
        self.held, self.close_by, self.ahead = None, {}, 0

    def _rows(self, key, out: list[tuple]) -> Iterator[Row]:
        for r in out:
            yield Row(chapter_id=key[0], slice_no=r[0], **dict(zip(_PARTS, r[1:], strict=True)))

    def _publish(self, follower: tuple | None) -> list[tuple]:
        """The held slice's blocks, joined with those of the slice (number, height, blocks) that takes its place."""
        out: list[tuple] = []
        gone: list[int] = []
        if self.held is not None:
            number, height, consumed, blocks = self.held
            own = [b for b in blocks if b[0] not in consumed]
            if follower is not None and follower[0] == number + 1:
                own, gone = join_slices((number, height, consumed, blocks), follower[2], self.edge)
            out = [(number, *b) for b in own]
        self.held = None if follower is None else (follower[0], follower[1], gone, follower[2])
        return out

    def _take(self) -> tuple | None:
        """The slice that is due, if it has come."""
        if self.due in self.close_by:
            if self.ahead and self.waiting.containsKey((self.due,)):  # it came once more when it was near
                self.waiting.removeKey((self.due,))
                self.ahead -= 1
            return self.close_by.pop(self.due)
        if self.ahead and self.waiting.containsKey((self.due,)):
            one = json.loads(self.waiting.getValue((self.due,))[0])
            self.waiting.removeKey((self.due,))
            self.ahead -= 1
            return one
        return None

    def _go_on(self) -> list[tuple]:
        """Take the slices that have come, as far as they follow each other."""
        out: list[tuple] = []
        while (one := self._take()) is not None:
            height, blocks = one
            if blocks is None:
                out += self._publish(None)
                self._forget()
                self.due += 1  # what comes again of this chapter is known to be old
                return out
            out += self._publish((self.due, height, blocks))
            self.due += 1
        return out


class _OfChapter:
    """The slices far ahead of one chapter, in the map of its bucket."""

    def __init__(self, waiting, chapter: int):
        self.waiting, self.chapter = waiting, chapter

    def containsKey(self, key: tuple) -> bool:  # noqa: N802  Spark's names
        return self.waiting.containsKey((self.chapter, *key))

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self.waiting.getValue((self.chapter, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.waiting.updateValue((self.chapter, *key), value)

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.waiting.removeKey((self.chapter, *key))

    def clear(self) -> None:
        for chapter, number in [k for k in self.waiting.keys() if k[0] == self.chapter]:
            self.waiting.removeKey((chapter, number))


class _SeamsOfBucket(StatefulProcessor):
    """_Seams for all chapters of a bucket: a batch reads and writes two values, however many chapters it has slices of.

    open: what _Seams holds of each chapter that is under way. ended: numbers of
    the others, and from which slice on they would begin again.
    """

    def __init__(self, edge: float, first: int, near: int = 16):
        self.edge, self.first, self.near = edge, first, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "body string")
        self.ended = handle.getValueState("ended", "chapters binary, due binary")
        self.waiting = handle.getMapState("waiting", "chapter_id long, slice_no long", "slice string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        come: dict[int, list[tuple]] = {}
        for d in rows:
            for chapter, number, height, blocks in zip(d["chapter_id"].tolist(), d["slice_no"].tolist(), d["height"].tolist(), d["blocks"], strict=True):
                one = (0, None) if blocks is None else (height, list(zip(*[iter(blocks.tolist())] * len(_PARTS), strict=True)))
                come.setdefault(chapter, []).append((number, one))
        known = self.open.get()
        under_way = {c: of for c, *of in json.loads(known[0])} if known else {}
        known = self.ended.get()
        chapters, dues = (np.frombuffer(x, np.int64) for x in known) if known else (np.zeros(0, np.int64),) * 2
        again = np.isin(chapters, np.fromiter((c for c in come if c not in under_way), np.int64))
        due_again, ended = dict(zip(chapters[again].tolist(), dues[again].tolist(), strict=True)), []
        seams, out = _Seams(self.edge, self.first, None, self.near), []
        for chapter, slices in come.items():
            seams.waiting = _OfChapter(self.waiting, chapter)
            seams.due, seams.ahead, seams.held, close_by = under_way.get(chapter) or (due_again.get(chapter, self.first), 0, None, {})
            seams.close_by = {int(k): v for k, v in close_by.items()}
            for number, one in slices:
                seams._add(number, one)
            out += [(chapter, *r) for r in seams._go_on()]
            if seams.held is None and not seams.close_by and not seams.ahead:
                under_way.pop(chapter, None)
                if seams.due != self.first:
                    ended.append((chapter, seams.due))
            else:
                under_way[chapter] = (seams.due, seams.ahead, seams.held, seams.close_by)
        self.open.update((json.dumps([(c, *of) for c, of in under_way.items()], separators=(",", ":")),))
        if again.any() or ended:
            more = np.array(ended, np.int64).reshape(-1, 2)
            self.ended.update((np.append(chapters[~again], more[:, 0]).tobytes(), np.append(dues[~again], more[:, 1]).tobytes()))
        found = pd.DataFrame(np.array(out, np.int64).reshape(-1, 2 + len(_PARTS)), columns=["chapter_id", "slice_no", *_PARTS])
        yield found if key[0] >= 0 else found.assign(chapter_id=None)

    def close(self) -> None:
        pass


def stream_seams(slices: DataFrame, edge: float = 60, timeout_ms: int | None = None, first: int = 0, buckets: int = 2048) -> DataFrame:
    """Merge blocks cut by the border of consecutive slices of a chapter, as seam_match and seam_merge do for whole tables.

    slices: chapter_id, slice_no, height and blocks, an array of (idx, x1, y1,
    x2, y2); a chapter's slices count from `first` and may come in any order
    over any number of batches. State holds those that wait for one before them,
    and the last slice with what the seam above has consumed of it. A slice is
    published when the next has come, the last one at the chapter's end marker,
    the number after it with blocks null. With a timeout, what waits is
    published when nothing has come for so long; without one a slice that never
    comes holds up those after it. A slice that comes again is left out.

    Without a timeout chapters lie in so many buckets by a hash, each one key of
    the state, as calls to the state cost more than all else; a bucket's open
    chapters are in memory together. A timeout needs a key for each chapter.
    """
    use_keyed_state(slices.sparkSession)
    out = "chapter_id long, slice_no long, idx long, x1 long, y1 long, x2 long, y2 long"
    if timeout_ms:
        return slices.select("chapter_id", "slice_no", "height", "blocks").groupBy("chapter_id").transformWithState(_Seams(edge, first, timeout_ms), out, "append", "ProcessingTime")
    flat = F.flatten(F.transform("blocks", lambda b: F.array(*(b[k].cast("long") for k in _PARTS))))
    height = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.col("height")).alias("height")
    chapter = F.col("chapter_id").cast("long")  # slices without one lie in a bucket of their own
    bucket = F.when(chapter.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(chapter), F.lit(buckets)))
    d = slices.select(bucket.alias("bucket"), F.coalesce(chapter, F.lit(0)).alias("chapter_id"), F.col("slice_no").cast("long").alias("slice_no"), height, flat.alias("blocks"))
    return d.groupBy("bucket").transformWithStateInPandas(_SeamsOfBucket(edge, first), out, "append", "None")


def seam_score(a: tuple, b: tuple, height: int, edge: float) -> float | None:
    """The score of two blocks (idx, x1, y1, x2, y2) at a seam; operators.strips has the rule."""
    edge = float(max(10, edge))
    wa, wb = max(1, a[3] - a[1]), max(1, b[3] - b[1])
    narrow, wide = min(wa, wb), max(wa, wb)
    far = abs(height - a[4]), abs(b[2])
    at_edge = a[4] >= height - edge and a[2] < height and b[2] <= edge and b[4] > 0 and max(far) <= 1.6 * edge
    overlap = max(0, min(a[3], b[3]) - max(a[1], b[1])) / narrow
    centre = abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) / wide
    score = 2.6 * overlap - 0.75 * centre - 0.35 * abs(wide / narrow - 1) - sum(far) / (3 * edge)
    return score if at_edge and wide / narrow <= 2.2 and (overlap >= 0.35 or centre <= 0.35) and score > 0 else None


def join_slices(held: tuple, blocks: list[tuple], edge: float = 60) -> tuple[list[tuple], list[int]]:
    """What is published of the held slice (number, height, consumed ids, blocks), and the ids that it consumes of the next one's blocks."""
    _, height, gone, upper = held
    near = float(max(10, edge))
    over, under = [a for a in upper if a[4] >= height - near and a[2] < height], [b for b in blocks if b[2] <= near and b[4] > 0]
    scored = sorted((-s, a[0], b[0]) for a in over for b in under if (s := seam_score(a, b, height, edge)) is not None)
    pairs: dict[int, int] = {}
    taken: set[int] = set()
    for _, i, j in scored:
        if i not in pairs and j not in taken:
            pairs[i] = j
            taken.add(j)
    below, out, consumed = {b[0]: b for b in blocks}, [], []
    for a in upper:
        if a[0] in gone:
            continue
        if a[0] in pairs:
            b = below[pairs[a[0]]]
            consumed.append(b[0])
            a = (a[0], min(a[1], b[1]), min(a[2], b[2] + height), max(a[3], b[3]), max(a[4], b[4] + height))
        out.append(a)
    return out, consumed


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is, and its result: all batches, or in complete mode the last."""
    spark: SparkSession = df.sparkSession
    place = shared_folder(spark, "stream")
    drop_at_end(spark, place)
    last = {"n": 0}

    def sink(batch: DataFrame, n: int) -> None:
        last["n"] = n
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    path = f"{place}/out/batch={last['n']}" if mode == "complete" else f"{place}/out"
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(df.columns)
