"""Crowded pages by cells against the folds over an array, and what they cost."""

import random
import time

import pandas as pd
import pytest

from pagelake.operators import clusters as C
from pagelake.operators import crowded

SCHEMA = "page_id long, label int, det_idx int, x1 long, y1 long, x2 long, y2 long, angle double, text string"
EVER = 1 << 30
WAYS = {
    "contained": lambda d, crowd: C.merge_contained(d, crowd=crowd),
    "touching": lambda d, crowd: C.merge_touching(d, 400, 600, 6, crowd=crowd),
    "lines": lambda d, crowd: C.merge_line_boxes(d, 400, 600, crowd=crowd),
    "dedup": lambda d, crowd: C.dedup_blocks(d, crowd=crowd),
    "absorb": lambda d, crowd: C.absorb_fragments(d, crowd=crowd),
}


def boxes(page, n, rng, side=400, tall=600):
    """Boxes of many sizes, equal ones, empty ones, some over the edge, some beside one another."""
    out = []
    for i in range(n):
        x, y = rng.randrange(-5, side), rng.randrange(-5, tall)
        w, h = rng.choice([(0, 0), (3, 4), (40, 12), (12, 40), (60, 60), (25, 8), (150, 100)])
        if out and i % 3 == 0:
            x, y, w, h = out[-1][3] + rng.randrange(-2, 5), out[-1][4] + rng.randrange(-2, 5), w or 9, h or 9
        out.append((page, 0, i, x, y, x + w, y + h, rng.choice([0.0, 0.05, 1.0, None]), rng.choice(["a", "a", "b", None])))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(12)
    rows = [r for page, n in enumerate([1, 2, 5, 12, 40, 40, 80, 120, 25, 60] * 3) for r in boxes(page, n, rng)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("way", WAYS)
def test_cells_give_what_the_array_gives(pages, way):
    rows = lambda crowd: sorted(map(str, WAYS[way](pages, crowd).collect()))
    usual = rows(EVER)
    assert rows(0) == usual
    assert rows(39) == usual  # some pages one way, some the other
    assert len(usual) < pages.count()  # something was merged


@pytest.mark.parametrize("way", WAYS)
def test_no_pages(spark, way):
    assert WAYS[way](spark.createDataFrame([], SCHEMA), crowded.CROWD).count() == 0


@pytest.mark.parametrize("n", [50_000])
def test_a_crowded_page(n):
    """Words in lines over a large page: the cost follows the number of boxes."""
    rng = random.Random(5)
    wide = 200

    def page(n):
        at = [(40 * (i % wide), 30 * (i // wide)) for i in range(n)]
        rows = [(i, x, y, x + rng.randrange(20, 34), y + rng.randrange(8, 20)) for i, (x, y) in enumerate(at)]
        return pd.DataFrame(rows, columns=["idx", "x1", "y1", "x2", "y2"]).assign(angle=0.0, text="a", mw=28.0, mh=14.0)

    folds = {
        "contained": lambda r: crowded.merge_contained(r, 0.3, 0.5),
        "touching": crowded.merge_touching,
        "lines": lambda r: crowded.merge_line_boxes(r, 300),
        "dedup": lambda r: crowded.dedup_blocks(r, 5, 0.1),
        "absorb": crowded.absorb_fragments,
    }
    for name, fold in folds.items():
        cost = []
        for size in (n // 10, n):
            rows = page(size)
            start = time.process_time()
            assert fold(rows)
            cost.append(time.process_time() - start)
        assert cost[1] < 30 * cost[0] + 1, (name, cost)  # ten times the boxes; pairs would be a hundred times


def test_cells_meet_all_that_is_near():
    rng = random.Random(3)
    cells = crowded.Cells()
    for step in range(600):
        x, y, w, h = rng.randrange(-200, 200), rng.randrange(-200, 200), rng.choice([0, 1, 7, 64, 300]), rng.choice([0, 1, 8, 63, 200])
        cells.put(rng.randrange(80), (x, y, x + w, y + h))
        if step % 7 == 0:
            cells.drop(rng.choice(list(cells.boxes)))
        b = (y, x, y + h, x + w)
        due = {k for k, o in cells.boxes.items() if o[0] <= b[2] + 3 and b[0] - 3 <= o[2] and o[1] <= b[3] + 5 and b[1] - 5 <= o[3]}
        assert due <= set(cells.near(b, 3, 5))


def test_small_pages_are_folded_many_at_a_time(spark, tmp_path):
    """A group of its own for each page took some milliseconds more of Python than the fold."""
    d = spark.range(20_000).selectExpr("id as page_id", "0 label", "0 det_idx", "id % 50 as x1", "0L y1", "id % 50 + 9 as x2", "9L y2", "0D angle", "'a' text")
    for way in WAYS.values():
        plan = way(d, 0)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert C.merge_contained(d, crowd=0).count() == 20_000


def test_statistics_and_nulls_stay_with_their_page(spark):
    rows = [(p, 0, i, 40 * i, 10 * p, 40 * i + 30, 10 * p + 20, None if i else 0.0, None if p == 1 else "a") for p in range(3) for i in range(p + 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    for way in WAYS.values():
        assert sorted(map(str, way(d, 0).collect())) == sorted(map(str, way(d, EVER).collect()))
