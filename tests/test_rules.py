"""Rules at their edges, and plans that meet by cells or components, against plain versions."""

import math
import random
import statistics

import duckdb
from pyspark.sql import functions as F

from pagelake.operators import boxes, clusters, joins, orientation, rejoin, strips, texts
from pagelake.operators.components import components
from pagelake.plans import registry

BOXES = "page_id long, label int, det_idx int, x1 long, y1 long, x2 long, y2 long"


def corners(df):
    return sorted((r["x1"], r["y1"], r["x2"], r["y2"]) for r in df.collect())


def test_of_equal_boxes_the_second_stays_if_one_is_inside(spark):
    two = lambda *boxes: spark.createDataFrame([(1, 0, i, *b) for i, b in enumerate(boxes)], BOXES)
    assert corners(clusters.merge_slices(two((0, 0, 100, 100), (5, 0, 105, 100)), 1000)) == [(5, 0, 105, 100)]
    assert corners(clusters.merge_slices(two((0, 0, 100, 100), (20, 0, 120, 100)), 1000)) == [(0, 0, 100, 100)]  # 0.67 shared: a duplicate
    assert corners(clusters.merge_slices(two((0, 0, 110, 100), (5, 0, 105, 100)), 1000)) == [(0, 0, 110, 100)]


def test_line_boxes_that_share_exactly_the_least(spark):
    d = spark.createDataFrame([(1, 0, 0, 0, 0, 300, 100), (1, 0, 1, 310, 45, 600, 145), (2, 0, 0, 0, 0, 300, 100), (2, 0, 1, 310, 46, 600, 146)], BOXES)
    got = clusters.merge_line_boxes(d, 1000, 1000)
    assert corners(got.filter("page_id = 1")) == [(0, 0, 600, 145)]  # 55 of 100
    assert got.filter("page_id = 2").count() == 2


def test_blocks_a_degree_apart_are_rejoined(spark):
    schema = "chapter_id long, page_no long, idx long, x1 long, y1 long, x2 long, y2 long, style string, angle double, text string"
    rows = [(1, 0, 0, 0, 0, 50, 100, "s", 0.0, "a"), (1, 1, 0, 0, 105, 50, 200, "s", 1.0, "b"), (2, 0, 0, 0, 0, 50, 100, "s", 0.0, "a"), (2, 1, 0, 0, 105, 50, 200, "s", 1.5, "b")]
    layout = spark.createDataFrame([(c, p, 100 * p, 100 * p, 100, 100) for c in (1, 2) for p in (0, 1)], "chapter_id long, page_no long, page_id long, top long, width long, height long")
    got = rejoin.rejoin_blocks(spark.createDataFrame(rows, schema), layout).collect()
    assert [(r["chapter_id"], r["text"], r["parts"]) for r in got] == [(1, "a b", 2)]


def test_a_long_chapter_is_many_folds(spark):
    """Stacks of three items on many pages of one chapter: each is a group of its own, numbered in order."""
    schema = "chapter_id long, page_no long, idx long, x1 long, y1 long, x2 long, y2 long, style string, text string"
    rows = [(1, p, i, 0, 1000 * p + 100 * i, 50, 1000 * p + 100 * i + 95, "s", "t") for p in range(300) for i in range(3)]
    got = rejoin.groups(rejoin.rejoin_pairs(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r["group"], r["place"], r["page_no"], r["idx"]) for r in got) == [(p, k, p, i) for p in range(300) for k, i in enumerate((0, 1))]


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    d = spark.createDataFrame([*links, (None, 7)], "x long, y long").select(F.when(F.col("x").isNotNull(), F.struct("x")).alias("a"), F.struct(F.col("y").alias("x")).alias("b"))
    got = {r["node"]["x"]: r["root"]["x"] for r in components(d).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_with_indents_that_leave_no_room(spark):
    d = spark.createDataFrame([(1, 0, "abcdef gh"), (1, 1, ""), (1, 2, None)], "page_id long, block_idx long, text string")
    for indent in ("   ", "    ", "          "):
        got = texts.layout_columns(d, 4, first_indent=indent, next_indent=indent).orderBy("block_idx", "line_no").collect()
        assert "".join(r["line"].strip().rstrip("-") for r in got) == "abcdefgh" and len(got) == 8


def test_flow_votes_by_cells(spark):
    rng = random.Random(9)
    rows = []
    for page in range(40):
        tall = rng.random() < 0.5
        for i in range(rng.randint(1, 14)):
            x, y = rng.randint(-50, 300), rng.randint(-50, 300)
            rows.append((page, 0, i, x, y, x + (20 if tall else rng.randint(20, 90)), y + rng.randint(10, 60)))
    want = {}
    for page in range(40):
        own = [r for r in rows if r[0] == page]
        if len(own) < 3:
            continue
        mw, mh = statistics.median(r[5] - r[3] for r in own), statistics.median(r[6] - r[4] for r in own)
        at = [((r[3] + r[5]) / 2, (r[4] + r[6]) / 2) for r in own]
        near = lambda i, across: any(
            (dx := at[j][0] - at[i][0], dy := at[j][1] - at[i][1]) and ((dx > 0 and abs(dy) < 0.5 * dx and math.hypot(dx, dy) < 3 * mw) if across else (dy > 0 and abs(dx) < 0.5 * dy and math.hypot(dx, dy) < 3 * mh)) for j in range(len(own)) if j != i
        )
        a, b = (sum(near(i, k) for i in range(len(own))) for k in (True, False))
        want[page] = (int(a > 1.2 * b and not b > 1.2 * a), int(b > 1.2 * a))
    got = orientation.vote_flow(orientation.centres(spark.createDataFrame(rows, BOXES))).collect()
    assert {r["page_id"]: (r["horizontal"], r["vertical"]) for r in got} == want
    assert len(set(want.values())) == 3


def test_views_of_a_chapter_have_sums_of_their_own(spark):
    layout = spark.createDataFrame([(1, p, p, 100 + 1000 * p, 1000) for p in range(40)], "chapter_id long, page_id long, page_no long, top long, height long")
    views = spark.createDataFrame([(1, 0, 600, 2600), (1, 1, 30000, 31000)], "chapter_id long, view_id long, view_top long, view_bottom long")
    got = sorted((r["view_id"], r["page_no"], r["crop_top"], r["crop_bottom"], r["combined_start"], r["combined_end"]) for r in strips.view_mappings(layout, views).collect())
    assert got == [(0, 0, 500, 1000, 0, 500), (0, 1, 0, 1000, 500, 1500), (0, 2, 0, 500, 1500, 2000), (1, 29, 900, 1000, 0, 100), (1, 30, 0, 900, 100, 1000)]
    one = strips.view_mappings(layout, views.filter("view_id = 1").drop("view_id"))
    assert sorted(r["combined_start"] for r in one.collect()) == [0, 100] and "view_id" not in one.columns


def test_blocks_of_many_ranges_are_replaced(spark):
    rng = random.Random(2)
    old = [(c, i, y := rng.randint(-9000, 90000), y + rng.randint(0, 9000)) for c in (1, 2) for i in range(200)]
    ranges = [(1, lo := rng.randint(-9000, 90000), lo + rng.randint(-10, 20000)) for _ in range(9)]
    df = spark.createDataFrame(old, "chapter_id long, block_idx long, y1 long, y2 long")
    got = joins.replace_range(df, df.filter("false"), spark.createDataFrame(ranges, "chapter_id long, lo long, hi long"))
    assert sorted(map(tuple, got.collect())) == sorted(o for o in old if not any(o[0] == c and lo <= o[2] and o[3] <= hi for c, lo, hi in ranges))


def test_a_box_exactly_so_many_times_as_high_takes_what_it_covers(spark):
    """1.1 times 50, 90 or 100 pixels is 55, 99 or 110; as doubles it is a little more."""
    rows = [r for page, h in enumerate((50, 90, 100, 60)) for r in ((page, 0, 0, 0, 0, 99, h - 1), (page, 0, 1, 0, 0, 299, h * 11 // 10 - 1))]
    got = boxes.drop_nested(spark.createDataFrame(rows, BOXES), 1.75, 1.1, 0.7, 0.85)
    assert sorted((r["page_id"], r["det_idx"]) for r in got.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    less = spark.createDataFrame([(1, 0, 0, 0, 0, 99, 49), (1, 0, 1, 0, 0, 299, 53)], BOXES)  # 54 of 55
    assert boxes.drop_nested(less, 1.75, 1.1, 0.7, 0.85).count() == 2


def test_the_edit_that_was_made_where_the_text_goes_on_with_its_letters(spark, tmp_path):
    """f14_text_delta against its SQL on texts with the inserted letters beside the edit."""
    texts = ["abcdZQef", "abcQefgh", "abcZefgh", "abcdQQZZ", "ZQZQZQZQ", "QZQZQZQZ", "", "Z", "ab"]
    rows = [(c, t, "user", x) for c in range(11, 17) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["f14_text_delta"](spark, str(tmp_path))
    want = duckdb.sql(registry.oracle_sql()["f14_text_delta"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_slices_are_merged_the_same_both_ways(spark):
    """The fold over an array and the one that passes over pairs by their edges."""
    rng = random.Random(21)
    rows = []
    for page, n in enumerate([1, 3, 8, 20, 45] * 6):
        for i in range(n):
            x, y, w, h = rng.randrange(-5, 300), rng.randrange(-5, 400), rng.choice([0, 20, 60, 150, -4]), rng.choice([0, 15, 60, 140, -9])
            if i % 2 and rows[-1][0] == page:
                x, y, w = rows[-1][3] + rng.randrange(-4, 5), rng.choice([rows[-1][4], rows[-1][6]]) + rng.randrange(-4, 5), w or 9
            rows.append((page, i % 2, i, x, y, x + w, y + h))
    d = spark.createDataFrame(rows, BOXES)
    got = [sorted(map(tuple, clusters.merge_slices(d, 500, crowd=c).collect())) for c in (1 << 30, 0, 6)]
    assert got[0] == got[1] == got[2] and len(got[0]) < len(rows)


def test_a_tall_page_of_many_boxes_is_not_folded_in_an_array(spark):
    pages = spark.createDataFrame([(1, 100, 6000)], "page_id long, width long, height long")
    found = texts.detect(pages, lambda pdf: pdf.assign(label=1, x1=0, y1=0, x2=9, y2=9)[["page_id", "slice", "label", "x1", "y1", "x2", "y2"]])
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 25


def test_projection_paints_without_a_row_for_each_line(spark):
    """A page is one row; pages of one box have no vote."""
    from pagelake.operators import orientation

    boxes = [(p, i, 10 * i, 40 * i, 10 * i + 8, 40 * i + 30) for p in range(3) for i in range(1 if p == 2 else 70)]
    got = orientation.vote_projection(orientation.centres(spark.createDataFrame(boxes, "page_id long, det_idx long, x1 long, y1 long, x2 long, y2 long")))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["page_id"] for r in got.collect()) == [0, 1]


def test_reasons_compute_an_error_line_once(spark):
    from pagelake.functions import report

    d = spark.createDataFrame([("OCR", "x\nRequest timed out"), ("Translator", "content was flagged"), ("Text Blocks", ""), (None, "Odd"), ("OCR", None)], "reason string, error string")
    got = d.select(report.skip_reason(F.col("reason"), F.col("error")).alias("told"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["told"] for r in got.collect()] == [
        "Text recognition failed: Unexpected tool error. Try another text recognition tool.",
        "Translation failed: The AI provider flagged this content. Try another translator.",
        "No text blocks detected",
        "Page processing failed: Unexpected tool error. Try again.",
        "Text recognition failed. Try another text recognition tool.",
    ]


def test_pairs_meet_once_without_a_row_for_each_page(spark):
    """Items that meet by both ends are one pair each way; a chapter of many pages is one pass."""
    rows = [(1, p, i, 0, 100 * p + 10 * i, 50, 100 * p + 10 * i + 9, "a", "t") for p in range(40) for i in range(10)]
    items = spark.createDataFrame(rows, "chapter_id long, page_no long, idx long, x1 long, y1 long, x2 long, y2 long, style string, text string")
    got = rejoin.rejoin_pairs(items)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    y = {(p, i): (a, b) for _, p, i, _, a, _, b, *_ in rows}
    want = sorted((k, m) for k in y for m in y if k != m and abs(k[0] - m[0]) <= 1 and (abs(y[k][1] - y[m][0]) < 15 or abs(y[m][1] - y[k][0]) < 15))
    assert sorted(((r["a_page_no"], r["a_idx"]), (r["b_page_no"], r["b_idx"])) for r in got.collect()) == want
    used, groups = set(), []
    for k in sorted(y):
        took = [m for a, m in want if a == k and m not in used]
        if k not in used:
            used.update([k, *took])
            groups += [[k, *took]] if took else []
    found = rejoin.groups(got).orderBy("group", "place").collect()
    assert [[(r["page_no"], r["idx"]) for r in found if r["group"] == g] for g in range(len(groups))] == groups
