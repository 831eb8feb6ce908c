"""Queries over boxes in which order matters, and the votes on direction.

Their SQL folds lists too, with DuckDB's list_reduce, written from the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boxes as O
from ..operators import clusters as C
from ..operators import orientation as D
from .boxes import HEIGHT, WIDTH
from .fixtures import Tables
from .registry import query, same_rows_as

BOX = "STRUCT(idx BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)"
FIELDS = "{'idx': CAST(det_idx AS BIGINT), 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
MEDIANS = "quantile_cont(CAST(x2-x1+1 AS DOUBLE), 0.5) AS mw, quantile_cont(CAST(y2-y1+1 AS DOUBLE), 0.5) AS mh"


def gathered(order: str, keys: str = "page_id", fields: str = FIELDS, stats: str = "", source: str = "fx_text") -> str:
    return f"(SELECT {keys}, list({fields} ORDER BY {order}) AS l{', ' + stats if stats else ''} FROM {source} GROUP BY {keys})"


def fold(items: str, state: str, start: str, step: str) -> str:
    """items folded: in step a.s is the state and x.b the item."""
    wrapped = f"list_transform({items}, lambda e: {{'b': e, 's': CAST(NULL AS {state})}})"
    return f"list_reduce({wrapped}, lambda a, x: {{'b': x.b, 's': {step}}}, {{'b': NULL, 's': CAST({start} AS {state})}}).s"


def w(b: str) -> str:
    return f"({b}.x2-{b}.x1)"


def h(b: str) -> str:
    return f"({b}.y2-{b}.y1)"


def area(b: str) -> str:
    return f"CAST({w(b)}*{h(b)} AS DOUBLE)"


def shared(a: str, b: str, axis: str, pixel: int = 0) -> str:
    return f"(least({a}.{axis}2,{b}.{axis}2)-greatest({a}.{axis}1,{b}.{axis}1)+{pixel})"


def both(a: str, b: str) -> str:
    return f"(greatest({shared(a, b, 'x')},0)*greatest({shared(a, b, 'y')},0))"


def iou(a: str, b: str) -> str:
    u = f"({area(a)}+{area(b)}-{both(a, b)})"
    return f"(CASE WHEN {u} > 0 THEN {both(a, b)}/{u} ELSE 0 END)"


def hull(a: str, b: str, more: str = "") -> str:
    return f"{{'idx': {a}.idx, 'x1': least({a}.x1,{b}.x1), 'y1': least({a}.y1,{b}.y1), 'x2': greatest({a}.x2,{b}.x2), 'y2': greatest({a}.y2,{b}.y2){more}}}"


def mostly(o: str, i: str, t: float) -> str:
    return f"({area(i)} > 0 AND {area(o)} >= {area(i)} AND {both(o, i)}/{area(i)} >= {t})"


def into_first(state: str, item: str, fits: str, merged: str, fresh: str | None = None) -> str:
    """state, a list, with item merged into its first element k that fits, else appended."""
    at = f"list_position(list_transform({state}, lambda k: {fits}), true)"
    return f"CASE WHEN coalesce({at}, 0) = 0 THEN list_append({state}, {fresh or item}) ELSE list_transform({state}, lambda k, i: CASE WHEN i = {at} THEN {merged} ELSE k END) END"


def unnested(folded: str, source: str, keys: str = "page_id", columns: str = "b.idx AS idx, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2") -> str:
    return f"SELECT {keys}, {columns} FROM (SELECT {keys}, unnest({folded}) AS b FROM {source} p) q"


GROWN = f"list_transform(l, lambda own: list_reduce(l, lambda a, o: CASE WHEN {mostly('a', 'o', 0.3)} OR {mostly('o', 'a', 0.3)} THEN {hull('a', 'o')} ELSE a END, own))"
SAME = f"(k.x1=x.b.x1 AND k.y1=x.b.y1 AND k.x2=x.b.x2 AND k.y2=x.b.y2) OR {iou('k', 'x.b')} >= 0.5"


@query(f"""WITH g AS (SELECT page_id, {GROWN} AS l FROM {gathered('det_idx')} p),
f AS (SELECT page_id, {fold('l', f'{BOX}[]', '[]', f"CASE WHEN len(list_filter(a.s, lambda k: {SAME})) > 0 THEN a.s ELSE list_append(a.s, x.b) END")} AS l FROM g)
SELECT page_id, CAST(i - 1 AS INT) AS idx, l[i].x1 AS x1, l[i].y1 AS y1, l[i].x2 AS x2, l[i].y2 AS y2 FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM f) q""")
def c1_merge_contained(t: Tables) -> DataFrame:
    return C.merge_contained(t.fx_text)


@same_rows_as("c1_merge_contained")
def c1_contained_by_cells(t: Tables) -> DataFrame:
    return C.merge_contained(t.fx_text, crowd=0)


OWN, NEW = "c.s.own", "y.b"
CONTAINED = f"(least({area(OWN)},{area(NEW)}) > 0 AND {both(OWN, NEW)}/least({area(OWN)},{area(NEW)}) >= 0.85)"
STACKED = f"""(least(abs({OWN}.y1-{NEW}.y2),abs({OWN}.y2-{NEW}.y1)) < least(0.1*{HEIGHT}, 0.1*greatest({h(OWN)},{h(NEW)})) AND least({w(OWN)},{w(NEW)}) > 0
 AND greatest({shared(OWN, NEW, 'x')},0)/least({w(OWN)},{w(NEW)}) > 0.2e0 AND least({area(OWN)},{area(NEW)})/greatest({area(OWN)},{area(NEW)}) > 0.3e0
 AND abs({OWN}.x1-{NEW}.x1) < 0.5*greatest({w(OWN)},{w(NEW)}) AND abs({OWN}.x2-{NEW}.x2) < 0.5*greatest({w(OWN)},{w(NEW)})
 AND CAST((greatest({OWN}.x2,{NEW}.x2)-least({OWN}.x1,{NEW}.x1))*(greatest({OWN}.y2,{NEW}.y2)-least({OWN}.y1,{NEW}.y1)) AS DOUBLE) <= 3*greatest({area(OWN)},{area(NEW)}))"""
ALIKE = f"({CONTAINED} OR {iou(OWN, NEW)} >= 0.5)"
INNER = f"STRUCT(own {BOX}, rest {BOX}[])"
ONTO = f"""{{'own': CASE WHEN {CONTAINED} THEN (CASE WHEN {area(OWN)} > {area(NEW)} THEN {OWN} ELSE {NEW} END) WHEN {ALIKE} THEN (CASE WHEN {area(NEW)} > {area(OWN)} THEN {NEW} ELSE {OWN} END) WHEN {STACKED} THEN {hull(OWN, NEW)} ELSE {OWN} END,
 'rest': CASE WHEN {ALIKE} OR {STACKED} THEN c.s.rest ELSE list_append(c.s.rest, {NEW}) END}}"""
PASS = f"""list_reduce(list_transform(a.s.rest[2:], lambda e: {{'b': e, 's': CAST(NULL AS {INNER})}}), lambda c, y: {{'b': y.b, 's': {ONTO}}}, {{'b': NULL, 's': CAST({{'own': a.s.rest[1], 'rest': []}} AS {INNER})}}).s"""
OUTER = f"STRUCT(o {BOX}[], rest {BOX}[])"


@query(f"""SELECT page_id, label, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM (SELECT page_id, label, unnest(list_reduce(list_transform(l, lambda e: {{'b': e, 's': CAST(NULL AS {OUTER})}}),
 lambda a, x: {{'b': x.b, 's': CASE WHEN len(a.s.rest) = 0 THEN a.s ELSE {{'o': list_append(a.s.o, {PASS}.own), 'rest': {PASS}.rest}} END}}, {{'b': NULL, 's': CAST({{'o': [], 'rest': l}} AS {OUTER})}}).s.o) AS b
FROM {gathered('det_idx', keys='page_id, label', source='fx_det')} p) q""")
def c2_merge_slices(t: Tables) -> DataFrame:
    return C.merge_slices(t.fx_det, HEIGHT)


TOUCH = "k.x1 <= x.b.x2 AND x.b.x1 <= k.x2 AND k.y1 <= x.b.y2 AND x.b.y1 <= k.y2"
PADDED = f"(SELECT page_id, det_idx, greatest(x1-32,0) AS x1, greatest(y1-32,0) AS y1, least(x2+32,{WIDTH}) AS x2, least(y2+32,{HEIGHT}) AS y2 FROM fx_text)"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, l FROM {gathered('x1, y1, x2, y2', source=PADDED + ' z')} g),
r AS (SELECT page_id, l, 0 AS before FROM p UNION ALL SELECT page_id, {fold('l', f'{BOX}[]', '[]', into_first('a.s', 'x.b', TOUCH, hull('k', 'x.b')))} AS l, len(l) AS before FROM r WHERE before <> len(l)),
f AS (SELECT page_id, arg_min(l, len(l)) AS l FROM r GROUP BY 1)
SELECT page_id, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM (SELECT page_id, unnest(l) AS b FROM f) q""")
def c3_merge_touching(t: Tables) -> DataFrame:
    return C.merge_touching(t.fx_text, WIDTH, HEIGHT)


@same_rows_as("c3_merge_touching")
def c3_touching_by_cells(t: Tables) -> DataFrame:
    return C.merge_touching(t.fx_text, WIDTH, HEIGHT, crowd=0)


def _continues(axis: str, other: str, size, reach: str) -> str:
    least = f"greatest(least({size('k')},{size('x.b')}),1)"
    centres = f"abs((k.{axis}1+k.{axis}2)-(x.b.{axis}1+x.b.{axis}2))/2.0"
    gap = f"greatest(greatest(k.{other}1,x.b.{other}1)-least(k.{other}2,x.b.{other}2),0)"
    return f"((greatest({shared('k', 'x.b', axis)},0)/CAST({least} AS DOUBLE) >= 0.55e0 OR {centres} <= 0.35e0*{least}) AND {gap} <= {reach.format(least)})"


LEVEL, UPRIGHT = _continues("y", "x", h, f"greatest({WIDTH}*0.08e0, 2.0*{{0}})"), _continues("x", "y", w, "greatest(2*{0}, 8)")
_TALL, _FLAT = lambda b: f"{h(b)} > 1.25e0*{w(b)}", lambda b: f"{w(b)} > 1.25e0*{h(b)}"
LINE_FITS = f"""CASE WHEN NOT ({_TALL('k')}) AND NOT ({_TALL('x.b')}) AND ({_FLAT('k')} OR {_FLAT('x.b')} OR {LEVEL}) THEN {LEVEL}
 WHEN NOT ({_FLAT('k')}) AND NOT ({_FLAT('x.b')}) THEN {UPRIGHT} ELSE false END"""


@query(f"""WITH f AS ({unnested(fold('l', f'{BOX}[]', '[]', into_first('a.s', 'x.b', LINE_FITS, hull('k', 'x.b'))), gathered('y1, x1, det_idx'))}),
c AS (SELECT page_id, idx, least(greatest(x1,0),{WIDTH}) AS x1, least(greatest(y1,0),{HEIGHT}) AS y1, least(greatest(x2,0),{WIDTH}) AS x2, least(greatest(y2,0),{HEIGHT}) AS y2 FROM f)
SELECT * FROM c WHERE x2-x1 > 3 AND y2-y1 > 3""")
def c4_merge_line_boxes(t: Tables) -> DataFrame:
    return C.merge_line_boxes(t.fx_text, WIDTH, HEIGHT)


@same_rows_as("c4_merge_line_boxes")
def c4_line_boxes_by_cells(t: Tables) -> DataFrame:
    return C.merge_line_boxes(t.fx_text, WIDTH, HEIGHT, crowd=0)


DOUBLED = """(SELECT page_id, det_idx, x1, y1, x2, y2, CAST((page_id+det_idx) % 3 AS DOUBLE) AS angle, CAST(det_idx AS VARCHAR) AS text FROM fx_text
 UNION ALL SELECT page_id, det_idx + 100, x1, y1, x2 + 3, y2, CAST((page_id+det_idx) % 3 AS DOUBLE) + CASE WHEN page_id % 2 = 0 THEN 0.05 ELSE 0.2 END, CAST(det_idx AS VARCHAR) FROM fx_text)"""
BLOCK = "STRUCT(idx BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, angle DOUBLE, text VARCHAR)"
BLOCK_FIELDS = FIELDS[:-1] + ", 'angle': angle, 'text': text}"
NEAR = "k.text = x.b.text AND abs(k.angle-x.b.angle) < 0.1 AND " + " AND ".join(f"abs(k.{c}-x.b.{c}) < 5" for c in C.CORNERS)


@query(unnested(fold("l", f"{BLOCK}[]", "[]", into_first("a.s", "x.b", NEAR, f"CASE WHEN {area('x.b')} > {area('k')} THEN x.b ELSE k END")), gathered("det_idx", fields=BLOCK_FIELDS, source=DOUBLED + " z")))
def c8_dedup_blocks(t: Tables) -> DataFrame:
    return C.dedup_blocks(doubled(t))


@same_rows_as("c8_dedup_blocks")
def c8_dedup_by_cells(t: Tables) -> DataFrame:
    return C.dedup_blocks(doubled(t), crowd=0)


def doubled(t: Tables) -> DataFrame:
    turn = ((F.col("page_id") + F.col("det_idx")) % 3).cast("double")
    one = t.fx_text.select("page_id", "det_idx", *C.CORNERS, turn.alias("angle"), F.col("det_idx").cast("string").alias("text"))
    lean = F.when(F.col("page_id") % 2 == 0, 0.05).otherwise(0.2)
    two = one.withColumns({"det_idx": F.col("det_idx") + 100, "x2": F.col("x2") + 3, "angle": F.col("angle") + lean})
    return one.unionByName(two)


#: New items by kind: all texts twice, the second time moved by 2 pixels; existing ones: every text moved by 4 or 7.
_ITEMS = "SELECT page_id, CAST(det_idx AS BIGINT) AS idx, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, x1, y1, x2, y2, CAST(page_id % 3 AS DOUBLE) AS angle, CAST(label AS VARCHAR) AS plain FROM fx_text"
_NEW = f"(SELECT * FROM ({_ITEMS}) i1 UNION ALL SELECT page_id, idx + 1000, x+2, y, w, h, x1+2, y1, x2+2, y2, angle + 0.5, plain FROM ({_ITEMS}) i2)"
_OLD = f"(SELECT page_id, idx, x+m AS x, y, w, h, x1+m AS x1, y1, x2+m AS x2, y2, angle + (idx % 2)*0.9 AS angle, CASE WHEN idx % 5 = 0 THEN 'other' ELSE plain END AS plain FROM (SELECT *, CASE WHEN (page_id+idx) % 2 = 0 THEN 4 ELSE 7 END AS m FROM ({_ITEMS}) i3) i4)"


def _insert_sql() -> str:
    parts = []
    for kind, (numbers, turned, worded) in C.KINDS.items():
        same = lambda a, b: " AND ".join([*(f"abs({a}.{c}-{b}.{c}) <= 5" for c in numbers), *([f"abs({a}.angle-{b}.angle) <= 1"] if turned else []), *([f"{a}.plain = {b}.plain"] if worded else [])])  # noqa: B023, E731
        item = "STRUCT(idx BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, angle DOUBLE, plain VARCHAR)"
        fields = "{'idx': idx, 'x': x, 'y': y, 'w': w, 'h': h, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'angle': angle, 'plain': plain}"
        fresh = f"(SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} e WHERE e.page_id = n.page_id AND {same('n', 'e')})) z"
        folded = fold("l", f"{item}[]", "[]", f"CASE WHEN len(list_filter(a.s, lambda k: {same('k', 'x.b')})) > 0 THEN a.s ELSE list_append(a.s, x.b) END")
        parts.append(f"SELECT '{kind}' AS kind, page_id, b.idx AS idx FROM (SELECT page_id, unnest({folded}) AS b FROM {gathered('idx', fields=fields, source=fresh)} p) q")
    return " UNION ALL ".join(parts)


@query(_insert_sql())
def c9_insert_new(t: Tables) -> DataFrame:
    """Every kind of item: new ones that neither an existing one nor an earlier new one equals."""
    label = F.col("label").cast("string")
    base = t.fx_text.select("page_id", F.col("det_idx").cast("long").alias("idx"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), *C.CORNERS, (F.col("page_id") % 3).cast("double").alias("angle"), label.alias("plain"))
    moved = lambda d, m: d.withColumns({c: F.col(c) + m for c in ("x", "x1", "x2")})
    new = base.unionByName(moved(base, 2).withColumns({"idx": F.col("idx") + 1000, "angle": F.col("angle") + 0.5}))
    old = moved(base, F.when((F.col("page_id") + F.col("idx")) % 2 == 0, 4).otherwise(7))
    old = old.withColumns({"angle": F.col("angle") + (F.col("idx") % 2) * 0.9, "plain": F.when(F.col("idx") % 5 == 0, "other").otherwise(F.col("plain"))})
    return C.insert_kinds(new, old)


ROW = f"STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, m {BOX}[])"
_LEAST_H = f"(least({h('k')},{h('x.b')})+1)"
IN_ROW = f"({shared('k', 'x.b', 'y', 1)} >= 0.45e0*{_LEAST_H} OR abs((k.y1+k.y2)-(x.b.y1+x.b.y2))/2.0 <= greatest(5.0, 0.45e0*mh))"
ADDED = "{'x1': least(k.x1,x.b.x1), 'y1': least(k.y1,x.b.y1), 'x2': greatest(k.x2,x.b.x2), 'y2': greatest(k.y2,x.b.y2), 'm': list_append(k.m, x.b)}"
FRESH_ROW = "{'x1': x.b.x1, 'y1': x.b.y1, 'x2': x.b.x2, 'y2': x.b.y2, 'm': [x.b]}"
LAST = "a.s[len(a.s)]"
_LOW, _HIGH = f"(least({h(LAST)},{h('x.b')})+1)", f"(greatest({h(LAST)},{h('x.b')})+1)"
ALONG = f"(x.b.x1-{LAST}.x2-1 <= greatest(14.0, 1.55*mh) AND {shared(LAST, 'x.b', 'y', 1)} >= 0.35e0*{_LOW} AND {_HIGH} <= 1.8*greatest({_LOW},1))"


def onto_last(ok: str) -> str:
    return f"CASE WHEN len(a.s) > 0 AND {ok} THEN list_append(a.s[:len(a.s)-1], {hull(LAST, 'x.b')}) ELSE list_append(a.s, x.b) END"


@query(f"""WITH r AS (SELECT page_id, mh, unnest({fold('l', f'{ROW}[]', '[]', into_first('a.s', 'x.b', IN_ROW, ADDED, FRESH_ROW))}) AS r FROM {gathered('y1+y2, x1, det_idx', stats=MEDIANS)} p),
n AS (SELECT page_id, mh, row_number() OVER () AS row_no, r FROM r), m AS (SELECT page_id, mh, row_no, i, r.m[i] AS b FROM (SELECT *, unnest(range(1, len(r.m)+1)) AS i FROM n) z),
s AS (SELECT page_id, row_no, max(mh) AS mh, list(b ORDER BY b.x1, i) AS l FROM m GROUP BY 1, 2)
{unnested(fold('l', f'{BOX}[]', '[]', onto_last(ALONG)), 's')}""")
def c11_merge_aligned(t: Tables) -> DataFrame:
    return C.merge_aligned(t.fx_text)


PART = "STRUCT(idx BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, gone BOOLEAN)"
OWN_PART = "a.s[x.b]"
_PW, _PH = lambda b: f"greatest({w(b)}+1,1)", lambda b: f"greatest({h(b)}+1,1)"
_GAP = f"greatest(greatest({OWN_PART}.y1,k.y1)-least({OWN_PART}.y2,k.y2)-1,0)"
TAKES = f"""(i <> x.b AND NOT k.gone AND ({_PW('k')} >= 2*{_PW(OWN_PART)} OR {_PH('k')} >= 2*{_PH(OWN_PART)})
 AND ({shared(OWN_PART, 'k', 'y', 1)} >= 0.2e0*least({_PH(OWN_PART)},{_PH('k')}) OR ({_GAP} <= greatest(8.0,0.45e0*mh) AND {_PH(OWN_PART)} < 0.6e0*{_PH('k')}))
 AND (({OWN_PART}.x1+{OWN_PART}.x2)/2.0 BETWEEN k.x1-mh AND k.x2+mh OR {shared(OWN_PART, 'k', 'x', 1)} >= least(0.35*{_PW(OWN_PART)},8.0)))"""
BEST = f"list_min(list_transform(a.s, lambda k, i: CASE WHEN {TAKES} THEN {{'gap': {_GAP}, 'i': i}} END)).i"
IS_SMALL = f"(NOT {OWN_PART}.gone AND {_PH(OWN_PART)} <= greatest(8.0,0.45e0*mh) AND {_PW(OWN_PART)} <= greatest(36.0,0.35*mw))"
FRAGMENTS = "(SELECT page_id, det_idx, x1, y1, CASE WHEN det_idx % 3 = 1 THEN x1 + (x2-x1)//4 ELSE x2 END AS x2, CASE WHEN det_idx % 3 = 1 THEN least(y2, y1+10) ELSE y2 END AS y2 FROM fx_text)"
gone = lambda b, v: f"{{'idx': {b}.idx, 'x1': {b}.x1, 'y1': {b}.y1, 'x2': {b}.x2, 'y2': {b}.y2, 'gone': {v}}}"
TAKEN = f"CASE WHEN {IS_SMALL} AND {BEST} IS NOT NULL THEN list_transform(a.s, lambda k2, j: CASE WHEN j = {BEST} THEN {hull('k2', OWN_PART, chr(44) + ' ' + chr(39) + 'gone' + chr(39) + ': false')} WHEN j = x.b THEN {gone('k2', 'true')} ELSE k2 END) ELSE a.s END"


@query(f"""WITH f AS (SELECT page_id, unnest({fold('range(1, len(l)+1)', f'{PART}[]', "list_transform(l, lambda k: " + gone('k', 'false') + ")", TAKEN)}) AS b FROM {gathered('det_idx', stats=MEDIANS, source=FRAGMENTS + ' z')} p)
SELECT page_id, b.idx AS idx, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM f WHERE NOT b.gone""")
def c12_absorb_fragments(t: Tables) -> DataFrame:
    """Every third text box shrunk to a fragment of a quarter of its width and at most 10 pixels."""
    return C.absorb_fragments(fragments(t))


@same_rows_as("c12_absorb_fragments")
def c12_absorb_by_cells(t: Tables) -> DataFrame:
    return C.absorb_fragments(fragments(t), crowd=0)


def fragments(t: Tables) -> DataFrame:
    small = F.col("det_idx") % 3 == 1
    return t.fx_text.withColumns({"x2": F.when(small, F.col("x1") + F.floor((F.col("x2") - F.col("x1")) / 4)).otherwise(F.col("x2")), "y2": F.when(small, F.least("y2", F.col("y1") + 10)).otherwise(F.col("y2"))})


COMPONENT = "{'idx': CAST(det_idx AS BIGINT), 'cy': (y1+y2)/2.0}"
CROW = "STRUCT(n BIGINT, s DOUBLE, m BIGINT[])"
ROWS = f"CASE WHEN len(a.s) > 0 AND x.b.cy - {LAST}.s/{LAST}.n <= greatest(8.0, 0.75e0*mh) THEN list_append(a.s[:len(a.s)-1], {{'n': {LAST}.n+1, 's': {LAST}.s+x.b.cy, 'm': list_append({LAST}.m, x.b.idx)}}) ELSE list_append(a.s, {{'n': 1, 's': x.b.cy, 'm': [x.b.idx]}}) END"


@query(f"""WITH f AS (SELECT page_id, {fold('l', f'{CROW}[]', '[]', ROWS)} AS r FROM {gathered('(y1+y2)/2.0, det_idx', fields=COMPONENT, stats=MEDIANS)} p)
SELECT page_id, CAST(i-1 AS INT) AS row, unnest(r[i].m) AS det_idx FROM (SELECT *, unnest(range(1, len(r)+1)) AS i FROM f) q""")
def c13_rows_by_y(t: Tables) -> DataFrame:
    return C.rows_by_y(t.fx_text)


_LEAST_LAST = f"(least({h(LAST)},{h('x.b')})+1)"
COLUMN = f"""(x.b.x1-{LAST}.x2-1 <= greatest(5.0,least(14.0,0.85e0*mw,0.55e0*mh)) AND {_LEAST_LAST} > 0 AND {shared(LAST, 'x.b', 'y', 1)} >= 0.35e0*{_LEAST_LAST}
 AND {_PW(LAST)} <= greatest(8.0,1.35e0*mw) AND {_PW('x.b')} <= greatest(8.0,1.35e0*mw))"""


@query(unnested(fold("l", f"{BOX}[]", "[]", onto_last(COLUMN)), gathered("x1, det_idx", stats=MEDIANS)))
def c16_merge_columns(t: Tables) -> DataFrame:
    return C.merge_columns(t.fx_text)


PLACED = "STRUCT(idx BIGINT, y1 DOUBLE, y2 DOUBLE, cx DOUBLE, cy DOUBLE, tall BOOLEAN)"
PLACE_FIELDS = "{'idx': CAST(det_idx AS BIGINT), 'y1': y1, 'y2': y2, 'cx': (x1+x2)/2.0, 'cy': (y1+y2)/2.0, 'tall': y2-y1 > x2-x1}"
TO = "CASE WHEN x.b.cy > k.y2 THEN NULL WHEN x.b.cy < k.y1 THEN i + 1 WHEN CASE WHEN x.b.tall OR k.tall THEN x.b.cx > k.cx ELSE x.b.cx < k.cx END THEN i END"
AT = f"coalesce(list_filter(list_transform(a.s, lambda k, i: {TO}), lambda p: p IS NOT NULL)[1], len(a.s)+1)"
INSERT = f"list_concat(a.s[:{AT}-1], [x.b], a.s[{AT}:])"


@query(f"""WITH f AS (SELECT page_id, {fold('l', f'{PLACED}[]', '[]', INSERT)} AS l FROM {gathered('(y1+y2)/2.0, det_idx', fields=PLACE_FIELDS)} p)
SELECT page_id, l[i].idx AS det_idx, CAST(i-1 AS INT) AS rank FROM (SELECT *, unnest(range(1, len(l)+1)) AS i FROM f) q""")
def w1_reading_order(t: Tables) -> DataFrame:
    return C.reading_order(t.fx_text, rtl=True)


def _nested_sql(wider: float, higher: float, across: float, down: float) -> str:
    return f"""SELECT page_id, det_idx FROM fx_det a WHERE NOT EXISTS (SELECT 1 FROM fx_det b WHERE a.page_id=b.page_id AND a.det_idx<>b.det_idx AND {_PW('b')} >= {wider}*{_PW('a')} AND {_PH('b')} >= {higher}*{_PH('a')}
AND {shared('a', 'b', 'x', 1)} >= {across}*{_PW('a')} AND {shared('a', 'b', 'y', 1)} >= {down}*{_PH('a')})"""


@query(_nested_sql(1, 1, 0.85, 0.85))
def c15_drop_nested(t: Tables) -> DataFrame:
    return O.drop_nested(t.fx_det).select("page_id", "det_idx")


@query(_nested_sql(1.75, 1.1, 0.7, 0.85))
def c15_drop_beside_wide(t: Tables) -> DataFrame:
    return O.drop_nested(t.fx_det, 1.75, 1.1, 0.7, 0.85).select("page_id", "det_idx")


SPREAD = "SELECT page_id, CASE WHEN (max(cy)-min(cy)+1e-6)/(max(cx)-min(cx)+1e-6) > 1.5 THEN 1 ELSE -1 END AS v FROM c GROUP BY 1"
ASPECT = "SELECT page_id, CASE WHEN quantile_cont(CAST(greatest(y2-y1,1) AS DOUBLE)/greatest(x2-x1,1), 0.5) > 1.2 THEN 1 ELSE -1 END AS v FROM c GROUP BY 1"
GRID = """g0 AS (SELECT page_id, floor(min(cx)) AS x0, greatest(ceil(max(cx))-floor(min(cx)),1) AS w, floor(min(cy)) AS y0, greatest(ceil(max(cy))-floor(min(cy)),1) AS h FROM c GROUP BY 1 HAVING count(*) >= 2),
g1 AS (SELECT *, CAST(greatest(least(round_even(64*(w/greatest(w,h)),0),96),32) AS INT) AS gw, CAST(greatest(least(round_even(64*(h/greatest(w,h)),0),96),32) AS INT) AS gh FROM g0),
g2 AS (SELECT c.page_id, gw, gh, """ + ", ".join(f"CAST(least(greatest(round_even(({e}-{o})/{s}*({n}-1),0),0),{n}-1) AS INT) AS {a}" for a, e, o, s, n in (("a1", "x1", "x0", "w", "gw"), ("a2", "x2", "x0", "w", "gw"), ("b1", "y1", "y0", "h", "gh"), ("b2", "y2", "y0", "h", "gh"))) + """ FROM c JOIN g1 ON c.page_id = g1.page_id),
g3 AS (SELECT DISTINCT page_id, gw, gh, r, unnest(range(a1, a2+1)) AS k FROM (SELECT *, unnest(range(b1, b2+1)) AS r FROM g2) z),
gr AS (SELECT page_id, sum(m*m)/max(gh) - (sum(m)/max(gh))*(sum(m)/max(gh)) AS v FROM (SELECT page_id, r, max(gh) AS gh, CAST(count(*) AS DOUBLE) AS m FROM g3 GROUP BY 1,2) z GROUP BY 1),
gc AS (SELECT page_id, sum(m*m)/max(gw) - (sum(m)/max(gw))*(sum(m)/max(gw)) AS v FROM (SELECT page_id, k, max(gw) AS gw, CAST(count(*) AS DOUBLE) AS m FROM g3 GROUP BY 1,2) z GROUP BY 1)"""
PROJECTION = "SELECT gr.page_id, CASE WHEN gc.v > 1.3*gr.v THEN 1 WHEN gr.v > 1.3*gc.v THEN -1 ELSE 0 END AS v FROM gr JOIN gc ON gr.page_id = gc.page_id"


def _sliding(value: str, along: str, name: str) -> str:
    return f"""{name}0 AS (SELECT page_id, {value} AS e, row_number() OVER (PARTITION BY page_id ORDER BY {along}, det_idx) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM c),
{name}1 AS (SELECT *, least(greatest(n // 3, 3), 8) AS size FROM {name}0 WHERE n >= 5),
{name}2 AS (SELECT a.page_id, a.rn, var_pop(b.e) AS v FROM {name}1 a JOIN {name}1 b ON a.page_id=b.page_id AND b.rn > a.rn-a.size AND b.rn <= a.rn WHERE a.rn >= a.size GROUP BY 1,2),
{name} AS (SELECT page_id, avg(v) AS v, count(*) AS windows FROM {name}2 GROUP BY 1)"""


JITTER_CTE = f"""{_sliding('cy', 'cx', 'sy')}, {_sliding('cx', 'cy', 'sx')},
j0 AS (SELECT page_id, count(*) AS n, var_pop(cx) AS vx, max(cx)-min(cx)+2e-6 AS rx, var_pop(cy) AS vy, max(cy)-min(cy)+2e-6 AS ry FROM c GROUP BY 1 HAVING count(*) >= 3),
j AS (SELECT j0.page_id, CASE WHEN n >= 5 THEN (vy+sy.v)/ry/2 ELSE vy/ry END AS across, CASE WHEN n >= 5 THEN (vx+sx.v)/rx/2 ELSE vx/rx END AS down FROM j0 LEFT JOIN sy ON j0.page_id=sy.page_id LEFT JOIN sx ON j0.page_id=sx.page_id)"""
JITTER = "SELECT page_id, CASE WHEN across < 0.6e0*down THEN -1 WHEN down < 0.6e0*across THEN 1 ELSE 0 END AS v FROM j"
FLOW_CTE = """f0 AS (SELECT page_id, quantile_cont(greatest(x2-x1,1),0.5) AS mw, quantile_cont(greatest(y2-y1,1),0.5) AS mh FROM c GROUP BY 1 HAVING count(*) >= 3),
f1 AS (SELECT a.page_id, a.det_idx, min(CASE WHEN b.cx>a.cx AND abs(b.cy-a.cy) < 0.5*(b.cx-a.cx) THEN sqrt((b.cx-a.cx)*(b.cx-a.cx)+(b.cy-a.cy)*(b.cy-a.cy)) END) AS r,
 min(CASE WHEN b.cy>a.cy AND abs(b.cx-a.cx) < 0.5*(b.cy-a.cy) THEN sqrt((b.cx-a.cx)*(b.cx-a.cx)+(b.cy-a.cy)*(b.cy-a.cy)) END) AS d FROM c a JOIN c b ON a.page_id=b.page_id AND a.det_idx<>b.det_idx GROUP BY 1,2),
f2 AS (SELECT f1.page_id, sum(CASE WHEN r < 3*mw THEN 1 ELSE 0 END) AS nr, sum(CASE WHEN d < 3*mh THEN 1 ELSE 0 END) AS nd FROM f1 JOIN f0 ON f1.page_id=f0.page_id GROUP BY 1)"""
FLOW = "SELECT page_id, CASE WHEN nr > 1.2*nd THEN -1 WHEN nd > 1.2*nr THEN 1 ELSE 0 END AS v FROM f2"
CENTRES = "c AS (SELECT *, CAST(x1+x2 AS DOUBLE)/2 AS cx, CAST(y1+y2 AS DOUBLE)/2 AS cy FROM fx_text)"
VOTES = f"""{CENTRES}, {GRID}, {JITTER_CTE}, {FLOW_CTE}, v AS ({SPREAD} UNION ALL {ASPECT} UNION ALL {PROJECTION} UNION ALL {JITTER} UNION ALL {FLOW}),
d AS (SELECT page_id, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) > sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS vertical FROM v GROUP BY 1)"""


def _one_vote(f, t: Tables) -> DataFrame:
    return f(D.centres(t.fx_text)).select("page_id", (F.col("vertical") - F.col("horizontal")).alias("v"))


@query(f"WITH {CENTRES} {SPREAD}")
def a4a_vote_spread(t: Tables) -> DataFrame:
    return _one_vote(D.vote_spread, t)


@query(f"WITH {CENTRES} {ASPECT}")
def a4b_vote_aspect(t: Tables) -> DataFrame:
    return _one_vote(D.vote_aspect, t)


@query(f"WITH {CENTRES}, {GRID} SELECT gr.page_id, round(gr.v, 6) AS var_r, round(gc.v, 6) AS var_c FROM gr JOIN gc ON gr.page_id = gc.page_id")
def a4c_vote_projection(t: Tables) -> DataFrame:
    return D.vote_projection(D.centres(t.fx_text)).select("page_id", F.round("var_r", 6).alias("var_r"), F.round("var_c", 6).alias("var_c"))


@query(f"WITH {CENTRES}, {JITTER_CTE} {JITTER}")
def a4d_vote_jitter(t: Tables) -> DataFrame:
    return _one_vote(D.vote_jitter, t)


@query(f"WITH {CENTRES}, {FLOW_CTE} {FLOW}")
def a4e_vote_flow(t: Tables) -> DataFrame:
    return _one_vote(D.vote_flow, t)


@query(f"WITH {VOTES} SELECT page_id, CASE WHEN vertical THEN 'ver_rtl' ELSE 'hor_ltr' END AS direction FROM d")
def a4_direction_votes(t: Tables) -> DataFrame:
    return D.direction_votes(t.fx_text).select("page_id", "direction")


@query(f"WITH {CENTRES}, {_sliding('cx', 'cy', 'sx')} SELECT page_id, round(v, 4) AS variance, windows FROM sx")
def w13_sliding_variance(t: Tables) -> DataFrame:
    return D.sliding_variance(D.centres(t.fx_text)).withColumn("variance", F.round("variance", 4))


@query(f"""WITH {VOTES}, e AS (SELECT c.*, d.vertical, CASE WHEN vertical THEN cx ELSE cy END AS m, CASE WHEN vertical THEN x2-x1 ELSE y2-y1 END AS size FROM c JOIN d ON c.page_id=d.page_id),
e1 AS (SELECT *, m - lag(m) OVER (PARTITION BY page_id ORDER BY m, det_idx) AS gap, 0.5*quantile_cont(size, 0.5) OVER (PARTITION BY page_id) AS most FROM e),
e2 AS (SELECT *, sum(CASE WHEN gap > most THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY m, det_idx) AS island FROM e1),
e3 AS (SELECT *, CASE WHEN vertical THEN -min(x1) OVER (PARTITION BY page_id, island) ELSE min(y1) OVER (PARTITION BY page_id, island) END AS head, min(det_idx) OVER (PARTITION BY page_id, island) AS first FROM e2)
SELECT page_id, det_idx, CASE WHEN vertical THEN 'vertical' ELSE 'horizontal' END AS orientation, CASE WHEN vertical THEN 'rtl' ELSE 'ltr' END AS reading_order,
CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY head, first) - 1 AS INT) AS line,
CAST(row_number() OVER (PARTITION BY page_id, island ORDER BY CASE WHEN vertical THEN y1 ELSE x1 END, det_idx) AS INT) AS place FROM e3""")
def c6_group_lines_auto(t: Tables) -> DataFrame:
    return D.group_lines_auto(t.fx_text)


_SHAPES = "SELECT page_id, block_idx, sum(greatest(CAST(greatest(x2-x1,1) AS DOUBLE)/greatest(y2-y1,1)-1,0.0)) AS wide, sum(greatest(CAST(greatest(y2-y1,1) AS DOUBLE)/greatest(x2-x1,1)-1,0.0)) AS tall, min(x1) AS lx1, min(y1) AS ly1, max(x2) AS lx2, max(y2) AS ly2 FROM fx_lines GROUP BY 1,2"


@query(f"""WITH s AS ({_SHAPES}) SELECT d.page_id, d.det_idx AS block_idx, CASE WHEN tall > 1.15e0*wide+0.2 THEN 'vertical' WHEN wide > 1.15e0*tall+0.2 THEN 'horizontal' WHEN y2-y1 > 1.25e0*(x2-x1) THEN 'vertical' ELSE 'horizontal' END AS direction
FROM fx_det d LEFT JOIN s ON d.page_id=s.page_id AND d.det_idx=s.block_idx""")
def a5_direction_from_lines(t: Tables) -> DataFrame:
    return O.direction_from_lines(t.fx_lines, t.fx_det.withColumnRenamed("det_idx", "block_idx"))


@query(f"""WITH s AS ({_SHAPES}), e AS (SELECT d.page_id, d.det_idx AS block_idx, tall, wide, greatest(coalesce(lx2,x2)-coalesce(lx1,x1),1) AS w, greatest(coalesce(ly2,y2)-coalesce(ly1,y1),1) AS h, d.page_id % 4 AS k FROM fx_det d LEFT JOIN s ON d.page_id=s.page_id AND d.det_idx=s.block_idx)
SELECT page_id, block_idx, CASE WHEN tall > 1.15e0*wide+0.2 THEN 'vertical' WHEN wide > 1.15e0*tall+0.2 THEN 'horizontal' WHEN k = 0 THEN 'horizontal' WHEN k < 3 AND CAST(h AS DOUBLE)/w BETWEEN 0.85e0 AND 1.15e0 THEN (CASE WHEN h >= 0.9e0*w THEN 'vertical' ELSE 'horizontal' END)
 WHEN h > 1.15e0*w THEN 'vertical' ELSE 'horizontal' END AS direction FROM e""")
def a5_direction_by_language(t: Tables) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, ("Korean", "ja", "zh-CN", "en"))), (F.col("page_id") % 4 + 1).cast("int"))
    return O.direction_from_lines(t.fx_lines, t.fx_det.withColumnRenamed("det_idx", "block_idx"), lang)
