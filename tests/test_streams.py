"""Streams over many batches: state for a run, slices in any order, timers."""

import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.operators import strips
from pagelake.plans.streams import in_batches
from pagelake.streaming import streams

BLOCK = "struct<idx:long,x1:long,y1:long,x2:long,y2:long>"
SLICES = f"chapter_id long, slice_no long, height long, blocks array<{BLOCK}>"


def stream_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_a_path_is_reported_once_for_a_run_however_long(spark, tmp_path):
    hour = lambda h: f"2026-01-01 {h:02d}:00:00"
    schema = "run_id long, path string, ts string, event_id long, ended boolean, item string, extra int"
    row = lambda run, path, h, n, ended=False: (run, path, hour(h), n, ended, "clash", 1)
    batches = [
        [row(1, "p1", 0, 1), row(1, "p1", 0, 2), row(2, "p1", 0, 3)],
        [row(1, "p2", 3, 4)],
        [row(1, "p1", 9, 5), row(1, None, 9, 6)],  # nine hours on
        [row(1, None, 10, 7, True), row(1, "p1", 10, 8), row(1, "p2", 9, 9), row(1, None, 11, 10)],  # p2 still belongs to the run before
        [row(1, "p2", 12, 11), row(2, "p1", 12, 12), row(3, "p1", 13, 13, None)],
    ]
    found = streams.once_per_path(stream_of(spark, tmp_path / "in", batches, schema).drop("item"), ["ts", "event_id"])
    got = sorted(r["event_id"] for r in streams.run_to_end(found, "append").collect())
    assert got == [1, 3, 4, 6, 8, 10, 11, 13]


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    height, rows = 1000, []
    for chapter in range(6):
        n = rng.randint(1, 9)
        for k in range(n):
            blocks = [(i, x := rng.randint(0, 900), y := rng.choice([0, 5, 400, 940, 955]), x + rng.randint(40, 90), min(y + rng.randint(30, 60), 1000)) for i in range(rng.randint(0, 5))]
            rows.append((chapter, k, height, blocks))
        rows.append((chapter, n, None, None))
    want = streams.run_to_end(streams.stream_seams(stream_of(spark, tmp_path / "a", [rows], SLICES)), "append")
    shuffled = rows + rows[:7]  # some come twice
    rng.shuffle(shuffled)
    got = streams.run_to_end(streams.stream_seams(stream_of(spark, tmp_path / "b", [shuffled[i::10] for i in range(10)], SLICES)), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() <= sum(len(r[3] or ()) for r in rows)


def test_a_missing_slice_holds_up_until_the_timeout(spark, tmp_path):
    rows = [(1, 0, 1000, [(0, 10, 950, 110, 1000)]), (1, 2, 1000, [(0, 10, 0, 110, 40)])]
    held = streams.run_to_end(streams.stream_seams(stream_of(spark, tmp_path / "a", [rows], SLICES)), "append")
    assert held.count() == 0
    timed = streams.stream_seams(stream_of(spark, tmp_path / "b", [rows], SLICES), timeout_ms=1)
    query = timed.writeStream.format("memory").queryName("late_slices").option("checkpointLocation", str(tmp_path / "c")).start()  # timers go on for ever
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("late_slices").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {(r["chapter_id"], r["slice_no"], r["idx"]) for r in spark.table("late_slices").collect()} == {(1, 0, 0), (1, 2, 0)}


def test_both_seam_scores_agree(spark):
    rng = random.Random(4)
    pairs = []
    for n in range(400):
        a = (0, x := rng.randint(0, 200), y := rng.randint(880, 990), x + rng.randint(1, 200), y + rng.randint(1, 80))
        b = (1, x := rng.randint(0, 200), y := rng.randint(-30, 70), x + rng.randint(1, 200), y + rng.randint(1, 80))
        pairs.append((n, *a[1:], *b[1:]))
    names = ["n", *(f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2"))]
    d = spark.createDataFrame(pairs, names)
    side = lambda p: [F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]
    got = {r["n"]: r["s"] for r in d.select("n", strips.seam_score(side("a"), side("b"), F.lit(1000), 60).alias("s")).collect()}
    for n, *box in pairs:
        want = streams.seam_score((0, *box[:4]), (1, *box[4:]), 1000, 60)
        assert (got[n] is None) == (want is None) and (want is None or got[n] == pytest.approx(want, abs=1e-9))
    assert 20 < sum(v is not None for v in got.values()) < 400


def test_a_chapter_reads_and_writes_one_value_a_batch():
    """Slices up to 16 ahead wait in the chapter's value, others in the map; calls to the state cost more than all else."""
    calls = []

    class State:
        def __init__(self):
            self.known = {}

        def __getattr__(self, name):
            known = self.known
            does = {"get": lambda: known.get(()), "update": lambda v: known.update({(): v}), "updateValue": known.__setitem__, "getValue": known.get, "removeKey": known.pop, "containsKey": known.__contains__, "clear": known.clear, "keys": lambda: list(known)}[name]
            return lambda *a: calls.append(name) or does(*a)

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        getMapState = getValueState  # noqa: N815

    block = [{"idx": 0, "x1": 10, "y1": 0, "x2": 110, "y2": 1000}]
    slices = [{"slice_no": n, "height": 1000, "blocks": block if n < 15 else None} for n in range(16)]
    for near, most in ((16, 2), (2, 40)):  # with 2 most slices wait in the map
        seams = streams._Seams(60, 0, None, near)
        seams.init(Handle())
        random.Random(8).shuffle(slices)
        out = []
        for s in [*slices, slices[0]]:
            before = len(calls)
            out += seams.handleInputRows((7,), iter([s]), None)
            assert len(calls) - before <= most
        assert [(r["chapter_id"], r["slice_no"], r["y2"]) for r in out] == [(7, n, 2000 if n < 14 else 1000) for n in range(0, 15, 2)]


def test_a_bucket_reads_and_writes_two_values_for_all_its_chapters():
    """The same rows as chapter by chapter; far slices wait in the map; what has ended may go on; calls don't grow with the chapters."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.known = {}

        def __getattr__(self, name):
            known = self.known
            does = {"get": lambda: known.get(()), "update": lambda v: known.update({(): v}), "updateValue": known.__setitem__, "getValue": known.get, "removeKey": known.pop, "containsKey": known.__contains__, "clear": known.clear, "keys": lambda: list(known)}[name]
            return lambda *a: calls.append(name) or does(*a)

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        getMapState = getValueState  # noqa: N815

    rng = random.Random(6)
    rows = []
    for chapter in range(300):
        n = rng.randint(1, 9)
        for k in range(n):
            rows.append((chapter, k, 1000, [(i, x := rng.randint(0, 300), y := rng.choice([0, 5, 940, 955]), x + rng.randint(40, 90), y + rng.randint(30, 60)) for i in range(rng.randint(0, 4))]))
        rows.append((chapter, n, 0, None))
        rows += [(chapter, n + 1, 1000, [(9, 1, 1, 2, 2)]), (chapter, n + 2, 0, None)][: 2 * (chapter % 2)]
    rng.shuffle(rows)
    for near in (16, 2):
        bucket, own, out, want = streams._SeamsOfBucket(60, 0, near), {}, [], []
        bucket.init(Handle())
        for lo in range(0, len(rows), 400):
            some = rows[lo : lo + 400] + rows[:5]
            for chapter in {c for c, *_ in some}:
                if chapter not in own:
                    own[chapter] = streams._Seams(60, 0, None, near)
                    own[chapter].init(Handle())
                slices = [{"slice_no": k, "height": h, "blocks": None if b is None else [dict(zip(streams._PARTS, x, strict=True)) for x in b]} for c, k, h, b in some if c == chapter]
                want += [tuple(r) for r in own[chapter].handleInputRows((chapter,), iter(slices), None)]
            calls.clear()
            flat = [(c, k, h, None if b is None else np.array([v for x in b for v in x], np.int64)) for c, k, h, b in some]
            for found in bucket.handleInputRows((0,), iter([pd.DataFrame(flat[i::2], columns=["chapter_id", "slice_no", "height", "blocks"]) for i in range(2)]), None):
                out += found.itertuples(index=False, name=None)
            assert len(calls) <= 4 or near == 2
        assert sorted(out) == sorted(want) and len(want) > 1000


def test_slices_without_a_chapter(spark, tmp_path):
    rows = [(None, 0, 1000, [(0, 10, 950, 110, 1000)]), (2**60 + 1, 0, 1000, [(0, 10, 950, 110, 1000)]), (None, 1, None, None), (2**60 + 1, 1, None, None)]
    got = streams.run_to_end(streams.stream_seams(stream_of(spark, tmp_path, [rows], SLICES)), "append")
    assert {tuple(r) for r in got.collect()} == {(c, 0, 0, 10, 950, 110, 1000) for c in (None, 2**60 + 1)}


def test_large_batches_come_as_several_files_each(spark):
    """Parts of many, few and no rows stay batches of their own."""
    from types import SimpleNamespace

    part = F.expr("case when id < 60 then 0 when id < 62 then 1 else 3 end")
    stream = in_batches(SimpleNamespace(spark=spark), spark.range(100), part, 4, each=6)
    place = tempfile.mkdtemp(prefix="spark-")
    seen = {}
    stream.writeStream.foreachBatch(lambda batch, n: seen.update({n: sorted(r["id"] for r in batch.collect())})).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    assert [seen[n] for n in sorted(seen) if seen[n]] == [list(range(60)), [60, 61], list(range(62, 100))]
