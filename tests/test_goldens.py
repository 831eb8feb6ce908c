"""Hand-made cases for functions and order-dependent operators."""

import zipfile

import pytest
from pyspark.sql import functions as F

from pagelake.functions import boxes as B
from pagelake.functions import lang as L
from pagelake.functions import report as R
from pagelake.functions import texts as T
from pagelake.operators import boxes as OB
from pagelake.operators import clusters as C
from pagelake.operators import joins as J
from pagelake.operators import orientation as D
from pagelake.operators import strips as S
from pagelake.operators import texts as OT
from pagelake.sources import archives, images
from pagelake.streaming import streams


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scalars(spark):
    s = F.lit
    assert one(spark, *(L.normalize_script(s(x)) for x in ("Japanese_vert-dn", "HanS", ""))) == ("Japanese", "HanS", "")
    assert one(spark, L.ocr_bucket(s("Greek")), L.script_language(s("Latin")), L.script_lang(s("Hangul_vert"))) == ("chinese", "Auto", "ko")
    assert one(spark, *(T.is_no_space(x) for x in (s("zh-CN"), s("ja"), s("th"), s("en"), s(None).cast("string")))) == (True, True, True, False, False)
    assert one(spark, *(T.preserve_case(s(m), s("new word")) for m in ("ABC", "abc", "Abc", "aBc"))) == ("NEW WORD", "new word", "New Word", "new word")
    assert one(spark, T.preview(s("a" * 100), s(50), s(55))) == ("…" + "a" * 65 + "…",)
    assert one(spark, *(R.error_detail(s(e)) for e in ("HTTP 429 Too Many Requests", "503 Service Unavailable", ""))) == ("Rate limited by provider", "Provider unavailable", "")
    assert one(spark, *(T.safe_stem(s(x)) for x in ("a/b:c..", "***", "a/b:c ..", " a\u00a0 \u2003b ", "x\x07y", None))) == ("a_b_c", "chapter", "a_b_c ", "a b", "x\x07y", "chapter")
    assert tuple(one(spark, R.parse_credits(s("7")))[0]) == (None, 7, 7)
    assert one(spark, *(T.clean_ja(s(x)) for x in ("a b…!?", "あ・い・・う", "ﾊﾟｶﾞ"))) == ("ａｂ．．．！？", "あ・い．．う", "パガ")
    assert one(spark, T.title_case(s("it's a NEW day")), T.preserve_case(s("It's"), s("new word")), T.preserve_case(s("TheEnd"), s("new word"))) == ("It'S A New Day", "New word", "New word")
    names = ["p1", "p" + "9" * 21, "p1" + "0" * 20 + "1", "p1" + "0" * 20 + "2", "p007", "p7b"]
    d = rows(spark, [(n,) for n in names], "n string")
    assert [r["n"] for r in d.orderBy(T.natural_key(F.col("n"))).collect()] == ["p1", "p007", "p7b", *names[1:4]]
    mixed = rows(spark, [(n,) for n in ("B", "P3", "a", "p2", "p10", "P1", "p1a", "a-1", "ab", "a1")], "n string")
    assert [r["n"] for r in mixed.orderBy(T.natural_key(F.col("n"))).collect()] == ["a", "a1", "a-1", "ab", "B", "P1", "p1a", "p2", "P3", "p10"]
    assert one(spark, R.error_line(s('Traceback (most recent call last):\n x')), R.error_line(s('\n File "a", line 1\nboom')), R.error_detail(s("content was flagged, 429")), R.error_action(s("OCR"), s("content was flagged"))) == ("", "boom", "The AI provider flagged this content", "Try another text recognition tool")
    assert one(spark, R.skip_reason(s("Text Blocks"), s(""))) == ("No text blocks detected",)


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_box_functions(spark):
    d = rows(spark, [(0, 0, 10, 10, 5, 5, 15, 15)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    a, b = B.box("a_"), B.box("b_")
    assert tuple(d.select(B.iou(a, b), B.mostly_in(a, b, 0.25)).first()) == (25 / 175, True)
    e = rows(spark, [(10, 10, 110, 60)], "x1 int, y1 int, x2 int, y2 int")
    assert tuple(e.select(*B.columns(B.expand(B.box(), 8, 8, F.lit(1000), F.lit(1000)))).first()) == (6, 8, 114, 62)
    f = rows(spark, [(0, 0, 100, 50)], "x1 int, y1 int, x2 int, y2 int")
    assert tuple(f.select(*B.columns(B.shrink(B.box(), 30))).first()) == (15, 7, 85, 42)
    assert OB.clean_boxes(rows(spark, [(-5, 0, 5, 20)], "x1 int, y1 int, x2 int, y2 int"), 100, 100).count() == 0


def test_touching_boxes(spark):
    d = rows(spark, [(1, 0, 0, 10, 10), (1, 15, 0, 25, 10), (1, 80, 80, 90, 90)], "page_id long, x1 long, y1 long, x2 long, y2 long")
    got = C.merge_touching(d, 100, 100, pad=3)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 0, 28, 13), (77, 77, 93, 93)]
    again = C.merge_touching(got, 100, 100, pad=0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_merge_contained(spark):
    d = rows(spark, [(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 60, 60), (1, 2, 300, 300, 320, 320)], "page_id long, det_idx int, x1 long, y1 long, x2 long, y2 long")
    assert sorted(tuple(r)[2:] for r in C.merge_contained(d).collect()) == [(0.0, 0.0, 100.0, 100.0), (300.0, 300.0, 320.0, 320.0)]


@pytest.mark.parametrize(("height", "sizes"), [(2400, [2400]), (5000, [2500, 2500]), (7001, [2334, 2334, 2333])])
def test_virtual_pages(spark, height, sizes):
    p = rows(spark, [(1, 1, 0, height)], "chapter_id long, page_id long, page_no long, height long")
    got = S.virtual_pages(p).orderBy("virtual_index").collect()
    assert [r["crop_bottom"] - r["crop_top"] for r in got] == sizes
    assert got[0]["crop_top"] == 0 and got[-1]["crop_bottom"] == height


def test_slices(spark):
    p = rows(spark, [(1, 1000, 4000), (2, 1000, 3500)], "page_id long, width long, height long")
    assert sorted((r["page_id"], r["start_y"], r["end_y"]) for r in S.overlap_slices(p).collect()) == [(1, 0, 3000), (1, 2400, 4000), (2, 0, 3500)]


def test_layout_and_seams(spark):
    p = rows(spark, [(1, i, i, h) for i, h in enumerate((10, 20, 30))], "chapter_id long, page_id long, page_no long, height long")
    assert [(r["top"], r["total"]) for r in S.strip_layout(p).orderBy("page_no").collect()] == [(100, 160), (110, 160), (130, 160)]
    c = rows(spark, [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7), (1, 1, 1, 0.1)], "seam long, block_idx int, next_idx int, score double")
    assert sorted((r["block_idx"], r["next_idx"]) for r in S.seam_match(c).collect()) == [(0, 0), (1, 1)]


def test_ranges_that_share_buckets_are_joined_once(spark):
    layout = rows(spark, [(1, 1, 0, 10, 0, 9000), (1, 2, 1, 10, 9000, 9000)], "chapter_id long, page_id long, page_no long, width long, top long, height long")
    blocks = rows(spark, [(1, 5, 0, 100, 1, 17000)], "chapter_id long, block_idx long, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r["page_no"] for r in J.pages_of_span(blocks, layout, size=64).collect()) == [0, 1]


def test_layouts(spark):
    d = rows(spark, [(1, 0, "the quick brown fox", "en"), (1, 1, "漢字仮名 あ\n\nい", "ja"), (1, 2, "well-known by-and-by extraordinary -x", "en"), (1, 3, None, "en")], "page_id long, block_idx long, text string, lang string")
    got: dict = {}
    for r in OT.layout_greedy(d, F.lit(9)).orderBy("block_idx", "line_no").collect():
        got.setdefault(r["block_idx"], []).append((r["line"], r["overflow"]))
    assert [x for x, _ in got[0]] == ["the quick", "brown fox"] and [x for x, _ in got[1]] == ["漢字仮名あ", "", "い"] and 3 not in got
    assert got[2] == [("well-", False), ("known by-", False), ("and-by", False), ("extraordinary", True), ("-x", False)]
    wide = OT.layout_greedy(d.filter("block_idx = 0"), F.lit(9), lambda line: 2 * len(line))
    assert [r["line"] for r in wide.orderBy("line_no").collect()] == ["the", "quick", "brown", "fox"]
    long = OT.layout_columns(rows(spark, [(1, 0, "incomprehensibilities of it")], "page_id long, block_idx long, text string"), 10).orderBy("line_no").collect()
    assert [r["line"] for r in long] == ["incompreh-", "ensibilit-", "ies of it"] and all(len(r["line"]) <= 10 for r in long)


def test_search_and_replace(spark):
    d = rows(spark, [(1, 0, "aXbXX aab"), (1, 1, None), (1, 2, "")], "page_id long, block_idx long, text string")
    empty = OT.find_matches(d, OT.Search("X*", regex=True, match_case=True)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["start"], r["end"], r["found"]) for r in empty] == [(0, 1, 2, "X"), (1, 3, 5, "XX")]
    one_by = lambda find, to, **k: [r["new"] for r in OT.replace_all(d, OT.Search(find, regex=True, match_case=True), to, **k).collect()]
    assert one_by("(?P<n>a+)(b)", "<$2$1|${n}|$&|$$>") == ["aXbXX <baa|aa|aab|$>"]
    assert one_by("b", "${gone}") == ["aX${gone}XX aa${gone}"]
    assert [r["new"] for r in OT.replace_nth(d, OT.Search("(X)(X)?", regex=True), "[$1$2]", 1).collect()] == ["aXb[XX] aab"]
    assert [r["new"] for r in OT.replace_all(d, OT.Search("xx"), "new", keep_case=True).collect()] == ["aXbNEW aab"]
    with pytest.raises(ValueError):
        OT.Search("  ")


BOXES = "page_id long, det_idx int, x1 long, y1 long, x2 long, y2 long"


def corners(df):
    return sorted(tuple(r[c] for c in ("x1", "y1", "x2", "y2")) for r in df.collect())


def test_line_boxes(spark):
    d = rows(spark, [(1, 0, 0, 0, 100, 20), (1, 1, 120, 4, 200, 24), (1, 2, 300, 0, 320, 100), (1, 3, 302, 110, 318, 200), (1, 4, 500, 300, 503, 340)], BOXES)
    assert corners(C.merge_line_boxes(d, 1000, 1000)) == [(0, 0, 200, 24), (300, 0, 320, 200)]


def test_slices_are_merged_in_one_pass(spark):
    d = rows(spark, [(1, 0, 0, 0, 100, 100), (1, 1, 5, 5, 95, 95), (1, 2, 0, 104, 100, 204), (1, 3, 0, 900, 100, 990), (2, 0, 0, 0, 10, 10)], BOXES).withColumn("label", F.lit(0))
    assert corners(C.merge_slices(d, 1000)) == [(0, 0, 10, 10), (0, 0, 100, 204), (0, 900, 100, 990)]


def test_fragments_and_columns(spark):
    d = rows(spark, [(1, 0, 0, 0, 200, 30), (1, 1, 90, 32, 96, 36), (1, 2, 0, 100, 200, 130), (1, 3, 500, 500, 504, 504), (1, 4, 0, 200, 200, 230)], BOXES)
    assert corners(C.absorb_fragments(d)) == [(0, 0, 200, 36), (0, 100, 200, 130), (0, 200, 200, 230), (500, 500, 504, 504)]
    e = rows(spark, [(1, 0, 0, 0, 10, 100), (1, 1, 14, 0, 24, 100), (1, 2, 60, 0, 70, 100), (1, 3, 64, 500, 74, 600)], BOXES)
    assert corners(C.merge_columns(e)) == [(0, 0, 24, 100), (60, 0, 70, 100), (64, 500, 74, 600)]


def test_reading_order(spark):
    d = rows(spark, [(1, 0, 50, 0, 60, 40), (1, 1, 0, 5, 10, 45), (1, 2, 0, 100, 10, 140)], BOXES)
    ranks = lambda **k: [r["det_idx"] for r in C.reading_order(d, **k).orderBy("rank").collect()]
    assert ranks() == [1, 0, 2] and ranks(rtl=True) == [0, 1, 2] and ranks(rtl=True, vertical=F.lit(False)) == [1, 0, 2]


@pytest.mark.parametrize("fn", [C.merge_contained, lambda d: C.merge_line_boxes(d, 99, 99), C.merge_aligned, C.absorb_fragments, C.rows_by_y, C.merge_columns, C.reading_order, lambda d: C.merge_touching(d, 99, 99), OB.drop_nested, D.direction_votes, D.group_lines_auto])
def test_empty_single_and_tied_boxes(spark, fn):
    none = rows(spark, [], BOXES)
    assert fn(none).count() == 0
    twin = rows(spark, [(1, 0, 5, 5, 15, 15), (2, 0, 5, 5, 15, 15), (2, 1, 5, 5, 15, 15)], BOXES).withColumn("idx", F.lit("clash"))
    assert {r["page_id"] for r in fn(twin).collect()} >= {1}


def test_scan_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.cbz", "w") as z:
        for n in ("p10.png", "p2.png", "note.txt", "P1.png"):
            z.writestr(n, b"x")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = archives.scan_archives(spark, str(tmp_path)).collect()
    assert [r["entry_name"] for r in sorted((r for r in got if r["error"] is None), key=lambda r: r["page_no"])] == ["P1.png", "p2.png", "p10.png"]
    assert [r["archive"].rpartition("/")[2] for r in got if r["error"]] == ["bad.zip"]


def test_seams_as_a_stream(spark, tmp_path):
    block = "struct<idx:long,x1:long,y1:long,x2:long,y2:long>"
    schema = f"chapter_id long, slice_no long, height long, blocks array<{block}>"
    data = [(1, 0, 1000, [(0, 10, 950, 110, 1000), (1, 300, 10, 400, 50)]), (1, 1, 1000, [(0, 12, 0, 108, 40), (1, 500, 400, 600, 450)]), (1, 2, 1000, None)]
    for i, r in enumerate(data):
        rows(spark, [r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = streams.run_to_end(streams.stream_seams(stream), "append")
    assert sorted((r["slice_no"], r["idx"], r["y1"], r["y2"]) for r in got.collect()) == [(0, 0, 950, 1040), (0, 1, 10, 50), (1, 1, 400, 450)]


def test_reorder(spark):
    pages = rows(spark, [("a", 0, "x/p1"), ("a", 1, "y/p1"), ("a", 2, "p2"), ("b", 0, "z")], "project string, page_no long, path string")
    ask = lambda tokens: {(r["project"], r["pos"]): r["path"] for r in J.resolve_reorder(rows(spark, tokens, "project string, pos long, token string"), pages).collect()}
    assert ask([("a", 0, "p1"), ("a", 1, "p2"), ("a", 2, "p1")]) == {("a", 0): "x/p1", ("a", 1): "p2", ("a", 2): "y/p1"}
    assert ask([("a", 0, "p1"), ("a", 1, "x/p1"), ("a", 2, "p2")]) == dict.fromkeys([("a", 0), ("a", 1), ("a", 2)])
    assert ask([("b", 0, "z"), ("b", 1, "z")]) == {("b", 0): None, ("b", 1): None}


def test_image_headers(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC00011080064009603012200021101031101FFDA")
    files = rows(spark, [("a", bytearray(jpeg)), ("b", bytearray(b"none")), ("c", bytearray(b"GIF89a\x0a\x00\x14\x00")), ("d", None)], "path string, content binary")
    good, bad = images.header_sizes(files)
    assert sorted(map(tuple, good.collect())) == [("a", 150, 100), ("c", 10, 20)] and sorted(r["path"] for r in bad.collect()) == ["b", "d"]
