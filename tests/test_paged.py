"""Folds of many whole pages at a time against the rules, row by row."""

import random
import statistics
import time

import numpy as np
import pyarrow as pa
import pytest

from pagelake.operators import clusters as C
from pagelake.operators import orientation as D
from pagelake.operators import paged
from pagelake.operators import strips as S
from pagelake.plans import registry

ITEMS = "page_id long, idx long, x1 long, y1 long, x2 long, y2 long, x long, y long, w long, h long, angle double, plain string"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_pages_come_whole_and_in_order(spark, small_batches, size):
    rows = [(page, i) for page, n in [(None, 9), *((p, p % 13) for p in range(40)), (99, 50)] for i in range(n)]
    random.Random(3).shuffle(rows)

    def fold(rows, starts):
        ends = [*starts[1:].tolist(), rows.num_rows]
        found = [rows["i"].slice(a, b - a).to_pylist() for a, b in zip(starts.tolist(), ends, strict=True)]
        assert all(i == list(range(len(i))) for i in found)
        return pa.RecordBatch.from_arrays([rows["page_id"].take(pa.array(starts)), pa.array([len(i) for i in found], pa.int64())], names=["page_id", "n"])

    d = paged.by_page(spark.createDataFrame(rows, "page_id long, i long"), ["page_id"], ["i"], fold, "page_id long, n long", size)
    got = [tuple(r) for r in d.collect()]
    assert sorted(got, key=str) == sorted(((p, sum(1 for q, _ in rows if q == p)) for p in {p for p, _ in rows}), key=str)


def test_near_meets_all_close_rows():
    rng = np.random.default_rng(5)
    page, u, v = rng.integers(0, 6, 400), rng.integers(-40, 40, 400).astype(float), rng.integers(-40, 40, 400).astype(float)
    met = {(int(a), int(b)) for i, j in paged.near(page, u, v, 6, 5) for a, b in zip(i, j, strict=True)}
    wanted = {(a, b) for a in range(400) for b in range(400) if a != b and page[a] == page[b] and abs(u[a] - u[b]) < 6 and 0 <= v[b] - v[a] <= 5}
    assert all((a, b) in met or (v[a] == v[b] and (b, a) in met) for a, b in wanted)
    assert all(page[a] == page[b] and 0 <= v[b] - v[a] <= 5 for a, b in met)


def inserted(new, known, kind):
    numbers, turned, worded = C.KINDS[kind]

    def same(a, b):
        near = all(a[c] is not None and b[c] is not None and abs(a[c] - b[c]) <= 5 for c in numbers)
        near = near and (not turned or (a["angle"] is not None and b["angle"] is not None and abs(a["angle"] - b["angle"]) <= 1))
        return near and (not worded or (a["plain"] is not None and a["plain"] == b["plain"]))

    out = []
    for n in sorted(new, key=lambda r: (r["page_id"], r["idx"])):
        page = [e for e in known if e["page_id"] == n["page_id"]]
        if not any(same(n, e) for e in page) and not any(same(n, k) for k in out if k["page_id"] == n["page_id"]):
            out.append(n)
    return [(r["page_id"], r["idx"]) for r in out]


@pytest.mark.parametrize("kind", C.KINDS)
def test_inserted_items(spark, small_batches, kind):
    rng = random.Random(8)

    def items(page, n, far):
        for i in range(n):
            x, y = rng.choice([rng.randrange(-9, far), None]) if i % 17 == 3 else rng.randrange(-9, far), rng.randrange(-9, far)
            yield page, i, x, y, (x or 0) + 30 + rng.randrange(4), y + 20, x, y, 30 + rng.randrange(4), 20, rng.choice([0.0, 0.5, 1.5, None]), rng.choice(["a", "b", None])

    deals = [(p, rng.randrange(12), 30) for p in range(60)] + [(100, 500, 60)]  # page 100 is over the crowd
    new, known = (spark.createDataFrame([r for p, n, far in deals for r in items(p, n // share, far)], ITEMS) for share in (1, 3))
    wanted = inserted(new.collect(), known.collect(), kind)
    got = C.insert_new(new, known, kind)
    assert sorted((r["page_id"], r["idx"]) for r in got.collect()) == wanted
    assert sorted((r["page_id"], r["idx"]) for r in C.insert_kinds(new, known).filter(f"kind = '{kind}'").collect()) == wanted
    assert len(wanted) < new.count()


def test_kinds_share_one_pass(spark):
    text = plan(registry.queries()["c9_insert_new"](spark, "/root/testdata/sf0.001"))
    assert text.count("MapInArrow") == 1
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def lines_by_hand(boxes, votes):
    """group_lines_auto of one page from its orientation."""
    flat = votes == "horizontal"
    mid = lambda r: (r[3] + r[5]) / 2 if flat else (r[2] + r[4]) / 2
    limit = 0.5 * statistics.median(r[5] - r[3] if flat else r[4] - r[2] for r in boxes)
    islands = []
    for r in sorted(boxes, key=lambda r: (mid(r), r[1])):
        if islands and mid(r) - mid(islands[-1][-1]) <= limit:
            islands[-1].append(r)
        else:
            islands.append([r])
    islands.sort(key=lambda g: (min(r[3] for r in g) if flat else -min(r[2] for r in g), min(r[1] for r in g)))
    for line, g in enumerate(islands):
        for place, r in enumerate(sorted(g, key=lambda r: (r[2] if flat else r[3], r[1])), 1):
            yield r[0], r[1], votes, "ltr" if flat else "rtl", line, place


def test_votes_and_lines_come_from_one_pass(spark, small_batches):
    """The sum of the five votes, and lines in the direction that they give; a page of which nothing is known has no votes."""
    rng = random.Random(4)
    rows = []
    for page in range(120):
        far = (900, 200) if page % 3 else (200, 900)
        for i in range(rng.randrange(1, 20)):
            x, y = rng.randrange(far[0]), rng.randrange(far[1])
            rows.append((page, i, x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 60)))
    rows.append((500, 0, None, 1, 2, 3))
    d = spark.createDataFrame(rows, "page_id long, det_idx long, x1 long, y1 long, x2 long, y2 long")
    want = {r[0]: [0, 0] for r in rows}
    for f in (D.vote_spread, D.vote_aspect, D.vote_projection, D.vote_jitter, D.vote_flow):
        for r in f(D.centres(d)).collect():
            want[r["page_id"]][0] += r["horizontal"]
            want[r["page_id"]][1] += r["vertical"]
    got = D.direction_votes(d)
    assert {r["page_id"]: [r["horizontal_votes"], r["vertical_votes"]] for r in got.collect()} == want
    assert want[500] == [0, 0] and len({h > v for h, v in want.values()}) == 2
    told = {r["page_id"]: r["orientation"] for r in got.collect()}
    lines = D.group_lines_auto(d)
    for df in (D.direction_votes(d), D.group_lines_auto(d)):
        assert plan(df).count("MapInArrow") == 1 and "Join" not in plan(df) and "Window" not in plan(df)
    known = [r for r in rows if r[0] != 500]
    hand = sorted(x for page in range(120) for x in lines_by_hand([r for r in known if r[0] == page], told[page]))
    assert sorted(tuple(r) for r in lines.filter("page_id <> 500").collect()) == hand
    asked = D.group_lines_auto(d, "vertical", "ltr").filter("page_id = 500").collect()
    assert [tuple(r) for r in asked] == [(500, 0, "vertical", "ltr", 0, 1)]


@pytest.mark.parametrize("aside", [0, 1])
def test_flow_of_a_crowded_page(aside):
    """Columns of 100,000 boxes at one place across: a box looks only at those within reach."""
    n = 100_000
    y = np.arange(n) * 7
    x = (np.arange(n) % 2) * 30 * aside
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, int)), pa.array(x), pa.array(y), pa.array(x + 20), pa.array(y + 5)], names=["page_id", "x1", "y1", "x2", "y2"])
    start = time.process_time()
    vertical, horizontal, has, _ = D._flow(D._Boxes(rows, np.zeros(1, int)))
    assert vertical.tolist() == [True] and horizontal.tolist() == [False] and has.all()
    assert time.process_time() - start < 30


def test_merged_seams_without_rounds(spark, small_batches):
    """Chains of matches down a chapter: every second one counts, a gap begins anew; no job runs before the rows are asked for."""
    rng = random.Random(6)
    blocks = [(c, s, i, 10 * i, 5, 10 * i + 9, 90, *((10 * i - 5, 0, 10 * i + 14, 95) if i % 2 == 0 else (None,) * 4)) for c in range(5) for s in range(40) for i in range(4)]
    links = [(c, s, i, i) for c in range(5) for s in range(39) for i in range(4) if rng.random() < 0.7]
    sides = [f"{p}{c}" for p in ("", "bubble_") for c in C.CORNERS]
    b = spark.createDataFrame(blocks, "chapter_id long, slice_no long, block_idx long, " + ", ".join(f"{c} long" for c in sides))
    m = spark.createDataFrame(links, "chapter_id long, slice_no long, block_idx long, next_idx long")
    heights = spark.createDataFrame([(c, s, 100 + s) for c in range(5) for s in range(40)], "chapter_id long, slice_no long, height long")
    kept = set()
    for c, s, i, _ in sorted(links):
        if (c, s - 1, i) not in kept:
            kept.add((c, s, i))
    own = {r[:3]: r[3:] for r in blocks}
    for given in (100, heights):
        want = []
        for (c, s, i), box in own.items():
            if (c, s - 1, i) in kept:
                continue
            high = given if given == 100 else 100 + s
            both = [v + high if k % 2 and v is not None and (c, s, i) in kept and k % 4 == 3 else v for k, v in enumerate(box)]
            want.append((c, s, i, *both))
        group = f"seams {len(str(given))}"
        spark.sparkContext.setJobGroup(group, "none before asked")
        merged = S.seam_merge(b, given, m)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, want))


def test_slices_of_many_pages_are_merged_at_once(spark, small_batches):
    """What the fold over an array gives, for pages of few and of many boxes; one without all its corners stays."""
    rng = random.Random(9)
    rows = []
    for page, n in enumerate([1, 2, 2, 3, 5, 9, 20, 60] * 4 + [450]):
        for i in range(n):
            x, y, w, h = rng.randrange(300), rng.randrange(20 * n), rng.choice([0, 20, 60, 110]), rng.choice([0, 30, 90])
            if rows and i % 3 == 1:
                x, y = rows[-1][3], rng.choice([rows[-1][6], rows[-1][4] + 5])
            rows.append((page, i // 6 % 2, i, x, y, x + w, y + h))
    boxes = "page_id long, label int, det_idx int, x1 long, y1 long, x2 long, y2 long"
    d = spark.createDataFrame(rows, boxes)
    merged = C.merge_slices(d, 900)
    assert "collect_list" not in plan(merged) and plan(merged).count("MapInArrow") == 1
    got, usual = (sorted(map(str, map(tuple, f.collect()))) for f in (merged, C.merge_slices(d, 900, crowd=1 << 30)))
    assert got == usual and len(got) < len(rows)
    odd = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9), (1, 0, 1, None, 0, 9, 9), (1, 0, 2, 0, 0, 9, 8)], boxes)
    assert sorted(map(str, map(tuple, C.merge_slices(odd, 900).collect()))) == ["(1, 0, 0, 0, 9, 9)", "(1, 0, None, 0, 9, 9)"]
