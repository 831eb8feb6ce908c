"""The folds of clusters.py for pages that hold very many boxes.

A fold over an array looks at all boxes placed so far for every box, which
suits pages of some tens. A page of more than CROWD boxes is folded in one
task with its boxes in cells instead: a box lies in the one cell that holds its
centre, in a grid of its own size, so a look-up meets only boxes nearby.
Both ways give the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import paged

#: Boxes of a page up to which an array is folded.
CROWD = 400
Corners = tuple[int, int, int, int]


def union(a: Corners, b: Corners) -> Corners:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def area(a: Corners) -> int:
    return (a[2] - a[0]) * (a[3] - a[1])


def shared(a: Corners, b: Corners) -> int:
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


class Cells:
    """Numbered boxes by the cells of their centres, one grid for each pair of powers of two that bound a box's sides."""

    def __init__(self) -> None:
        self.boxes: dict[int, Corners] = {}
        self._levels: dict[tuple[int, int], dict[tuple[int, int], set[int]]] = {}

    @staticmethod
    def _cell(b: Corners) -> tuple[tuple[int, int], tuple[int, int]]:
        level = max(abs(b[2] - b[0]), 1).bit_length(), max(abs(b[3] - b[1]), 1).bit_length()
        return level, ((b[0] + b[2]) // 2 >> level[0], (b[1] + b[3]) // 2 >> level[1])

    def put(self, key: int, b: Corners) -> None:
        if key in self.boxes:
            self.drop(key)
        level, cell = self._cell(b)
        self.boxes[key] = b
        self._levels.setdefault(level, {}).setdefault(cell, set()).add(key)

    def drop(self, key: int) -> None:
        level, cell = self._cell(self.boxes.pop(key))
        grid = self._levels[level]
        grid[cell].discard(key)
        if not grid[cell]:
            del grid[cell]
        if not grid:
            del self._levels[level]

    def near(self, b: Corners, dx: int = 0, dy: int = 0) -> Iterator[int]:
        """Keys of all boxes that reach within dx and dy of b, edges included, in no order, some others with them."""
        for (across, down), grid in self._levels.items():
            u, v = dx + (1 << across >> 1) + 1, dy + (1 << down >> 1) + 1  # a box reaches less than this from its centre
            x1, x2, y1, y2 = b[0] - u >> across, b[2] + u >> across, b[1] - v >> down, b[3] + v >> down
            if (x2 - x1 + 1) * (y2 - y1 + 1) <= len(grid):
                met = (grid.get((x, y), ()) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1))
            else:
                met = (own for (x, y), own in grid.items() if x1 <= x <= x2 and y1 <= y <= y2)
            for own in met:
                yield from own


def by_crowd(page: DataFrame, usual: Callable[[DataFrame], DataFrame], fold: Callable[[Mapping], list[tuple]], crowd: int, keys: tuple[str, ...] = ("page_id",), size: int = 20_000) -> DataFrame:
    """usual(page) for pages of up to so many items; others by fold, which takes a page's items in order, as columns, with its statistics, and gives rows as usual does, without the keys.

    A task goes through its pages a batch at a time and gives about `size`
    rows at once: a group of its own for each page costs more than its fold.
    """
    few = usual(page.filter(F.size("items") <= crowd))
    schema, stats = to_arrow_schema(few.schema), [c for c in page.columns if c not in (*keys, "items")]

    def batch(pages: list[tuple], out: list[tuple]) -> pa.RecordBatch:
        values = [*zip(*pages, strict=True), *zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, out = [], []
            known = zip(*(b[c].to_pylist() for c in keys), strict=True)
            for page, items, own in zip(known, b["items"], zip(*(b[c].to_pylist() for c in stats), strict=True) if stats else [()] * b.num_rows, strict=True):
                fields = items.values
                rows = {f.name: fields.field(f.name).to_numpy(zero_copy_only=False) for f in fields.type}
                found = fold(rows | {c: np.array([v]) for c, v in zip(stats, own, strict=True)})
                pages += [page] * len(found)
                out += found
                if len(out) >= size:
                    yield batch(pages, out)
                    pages, out = [], []
            if out:
                yield batch(pages, out)

    return few.union(page.filter(F.size("items") > crowd).select(*keys, "items", *stats).mapInArrow(run, few.schema))


def _boxes(rows: Mapping) -> list[Corners]:
    return list(zip(*(rows[c].tolist() for c in ("x1", "y1", "x2", "y2")), strict=True))


def _strips(old: Corners, new: Corners) -> Iterator[Corners]:
    """What new has beyond old, edges included."""
    if new[0] < old[0]:
        yield new[0], new[1], old[0], new[3]
    if new[2] > old[2]:
        yield old[2], new[1], new[2], new[3]
    if new[1] < old[1]:
        yield new[0], new[1], new[2], old[1]
    if new[3] > old[3]:
        yield new[0], old[3], new[2], new[3]


def merge_contained(rows: Mapping, least: float, same: float) -> list[tuple]:
    boxes, cells, kept = _boxes(rows), Cells(), Cells()
    for i, b in enumerate(boxes):
        cells.put(i, b)

    def mostly_in(outer: Corners, inner: Corners) -> bool:
        return area(outer) >= area(inner) > 0 and shared(outer, inner) / area(inner) >= least

    def grown(own: Corners) -> Corners:
        """own over all boxes in order; as it grows only what its new strips meet comes in, if its turn isn't over."""
        waiting = sorted(set(cells.near(own)))
        known = set(waiting)
        while waiting:
            at = heapq.heappop(waiting)
            other = boxes[at]
            if mostly_in(own, other) or mostly_in(other, own):
                wider = union(own, other)
                for strip in _strips(own, wider):
                    for more in cells.near(strip):
                        if more > at and more not in known:
                            known.add(more)
                            heapq.heappush(waiting, more)
                own = wider
        return own

    def alike(a: Corners, b: Corners) -> bool:
        both = shared(a, b)
        whole = area(a) + area(b) - both
        return a == b or (both / whole if whole > 0 else 0.0) >= same

    for b in map(grown, boxes):
        if not any(alike(kept.boxes[k], b) for k in kept.near(b)):
            kept.put(len(kept.boxes), b)
    return [(i, *b) for i, b in kept.boxes.items()]


def merge_slices(rows: Mapping, inside: float, same: float, shared_least: float, gap: float) -> list[tuple]:
    """Pairs that are apart across, or down by more than a stack allows, are told by their edges."""
    near_down, rest, out = gap * rows["ph"].tolist()[0], _boxes(rows), []
    plain = inside > 0 and same > 0 and shared_least >= 0

    def joined(a: Corners, b: Corners) -> Corners | None:
        across = max(min(a[2], b[2]) - max(a[0], b[0]), 0)
        down = max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        tall = max(a[3] - a[1], b[3] - b[1])
        apart = min(abs(a[1] - b[3]), abs(a[3] - b[1])) >= min(near_down, 0.1 * tall)
        if plain and (not across or (not down and apart)):
            return None
        area_a, area_b, both = area(a), area(b), across * down
        small, large, whole = min(area_a, area_b), max(area_a, area_b), area_a + area_b - both
        if small > 0 and both / small >= inside:
            return a if area_a > area_b else b
        if (both / whole if whole > 0 else 0.0) >= same:
            return b if area_b > area_a else a
        if apart or not large:
            return None
        narrow, wide = sorted((a[2] - a[0], b[2] - b[0]))
        near = narrow > 0 and across / narrow > shared_least and small / large > 0.3 and abs(a[0] - b[0]) < 0.5 * wide and abs(a[2] - b[2]) < 0.5 * wide
        return hull if near and area(hull := union(a, b)) <= 3 * large else None

    while rest:
        own, left = rest[0], []
        for b in rest[1:]:
            new = None if plain and (own[2] <= b[0] or b[2] <= own[0]) else joined(own, b)
            if new is None:
                left.append(b)
            else:
                own = new
        out.append(own)
        rest = left
    return out


def merge_slices_of(rows: pa.RecordBatch, starts: np.ndarray, inside: float, same: float, shared_least: float, gap: float) -> pa.RecordBatch:
    """merge_slices of many pages; one of which no two boxes overlap across, and down or nearly, stays as it is, and so does a box without all corners."""
    odd = ~np.isfinite(sum(paged.floats(rows, c) for c in ("x1", "y1", "x2", "y2")))
    if odd.any():
        left, whole = (rows.filter(pa.array(m)) for m in (odd, ~odd))
        parts = [left.select(["page_id", "label", "x1", "y1", "x2", "y2"])]
        if whole.num_rows:
            parts.append(merge_slices_of(whole, paged.starts_of(whole, ["page_id", "label"]), inside, same, shared_least, gap))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    corners, ph = {c: rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")}, paged.floats(rows, "ph")
    x1, y1, x2, y2 = corners.values()
    ends, page = np.append(starts[1:], rows.num_rows), paged.pages_of(starts, rows.num_rows)
    high = np.fmax.reduceat(ph, starts)
    many = ends - starts > CROWD
    fold = many.copy() if inside > 0 and same > 0 and shared_least >= 0 else np.ones(len(starts), bool)
    at, step = np.flatnonzero(~fold[page]), 1
    while at.size:  # each box with the one so many places behind, all pages at once
        at = at[at + step < ends[page[at]]]
        to = at + step
        apart = np.minimum(np.abs(y1[at] - y2[to]), np.abs(y1[to] - y2[at])) >= 0.1 * np.maximum(y2[at] - y1[at], y2[to] - y1[to])
        down = np.minimum(y2[at], y2[to]) > np.maximum(y1[at], y1[to])
        near = (np.minimum(x2[at], x2[to]) > np.maximum(x1[at], x1[to])) & (down | ~apart)
        fold[page[at[near]]] = True
        at, step = at[~fold[page[at]]], step + 1
    plain = np.flatnonzero(~fold[page])
    home, found = [], []
    for k in np.flatnonzero(fold).tolist():
        span = slice(starts[k], ends[k])
        merged = merge_slices({c: v[span] for c, v in corners.items()} | {"ph": high[k : k + 1]}, inside, same, shared_least, gap)
        home += [starts[k]] * len(merged)
        found += merged
    ids = pa.array(np.concatenate([plain, np.array(home, np.int64)]))
    sides = np.concatenate([np.stack(list(corners.values()), 1)[plain], np.array(found, np.int64).reshape(-1, 4)])
    return pa.RecordBatch.from_arrays([rows["page_id"].take(ids), rows["label"].take(ids), *(pa.array(sides[:, c]) for c in range(4))], names=["page_id", "label", *corners])


def merge_touching(rows: Mapping) -> list[tuple]:
    cells = Cells()
    for i, b in enumerate(_boxes(rows)):
        while True:
            met = [k for k in cells.near(b) if cells.boxes[k][0] <= b[2] and b[0] <= cells.boxes[k][2] and cells.boxes[k][1] <= b[3] and b[1] <= cells.boxes[k][3]]
            if not met:
                break
            for k in met:
                b = union(b, cells.boxes[k])
                cells.drop(k)
        cells.put(i, b)
    return list(cells.boxes.values())


def merge_line_boxes(rows: Mapping, page_width: int) -> list[tuple]:
    cells, first = Cells(), []  # first: the idx of each group

    def continues(a: Corners, b: Corners, axis: int, reach: Callable[[int], float]) -> bool:
        """Whether b goes on with a: axis is the one they share, 0 for x; the gap lies along the other."""
        low, high, across = axis, axis + 2, 1 - axis
        least = max(min(a[high] - a[low], b[high] - b[low]), 1)
        both = max(min(a[high], b[high]) - max(a[low], b[low]), 0)
        centres = abs((a[low] + a[high]) - (b[low] + b[high])) / 2
        gap = max(max(a[across], b[across]) - min(a[across + 2], b[across + 2]), 0)
        return (both / least >= 0.55 or centres <= 0.35 * least) and gap <= reach(least)

    def fits(a: Corners, b: Corners) -> bool:
        (wa, ha), (wb, hb) = ((v[2] - v[0], v[3] - v[1]) for v in (a, b))
        flat_a, flat_b = wa > 1.25 * ha, wb > 1.25 * hb
        level = continues(a, b, 1, lambda s: max(0.08 * page_width, 2.0 * s))
        if not ha > 1.25 * wa and not hb > 1.25 * wb and (flat_a or flat_b or level):
            return level
        return not flat_a and not flat_b and continues(a, b, 0, lambda s: max(2 * s, 8))

    for i, (idx, b) in enumerate(zip(rows["idx"].tolist(), _boxes(rows), strict=True)):
        along = int(max(0.08 * page_width, 2 * max(b[3] - b[1], 1))) + 1
        down = max(2 * max(b[2] - b[0], 1), 8) + 1
        # Centres count too where a side has no extent: one pixel more.
        met = {*cells.near(b, along, 1), *cells.near(b, 1, down)}
        at = min((k for k in met if fits(cells.boxes[k], b)), default=None)
        if at is None:
            cells.put(i, b)
            first.append((i, idx))
        else:
            cells.put(at, union(cells.boxes[at], b))
    return [(idx, *cells.boxes[i]) for i, idx in first]


def dedup_blocks(rows: Mapping, tolerance: float, degrees: float) -> list[tuple]:
    kept: list[list] = []
    by_text: dict[str, Cells] = {}
    margin = int(tolerance) + 1
    for idx, b, angle, text in zip(rows["idx"].tolist(), _boxes(rows), rows["angle"].tolist(), rows["text"].tolist(), strict=True):
        at = None
        if isinstance(text, str):  # a block without text equals no other
            cells = by_text.setdefault(text, Cells())
            corner = (b[0], b[1], b[0], b[1])
            near = lambda k: abs(kept[k][2] - angle) < degrees and all(abs(p - q) < tolerance for p, q in zip(kept[k][1], b, strict=True))  # noqa: B023, E731
            at = min((k for k in cells.near(corner, margin, margin) if near(k)), default=None)
            if at is None or area(b) > area(kept[at][1]):
                cells.put(len(kept) if at is None else at, corner)
        if at is None:
            kept.append([idx, b, angle])
        elif area(b) > area(kept[at][1]):
            kept[at] = [idx, b, angle]
    return [(idx, *b) for idx, b, _ in kept]


def absorb_fragments(rows: Mapping) -> list[tuple]:
    cells, idx = Cells(), rows["idx"].tolist()
    mw, mh = (float(rows[c].tolist()[0]) for c in ("mw", "mh"))
    near_y, flat, narrow = max(8.0, 0.45 * mh), max(8.0, 0.45 * mh), max(36.0, 0.35 * mw)
    for i, b in enumerate(_boxes(rows)):
        cells.put(i, b)
    pixels = lambda b: (max(b[2] - b[0] + 1, 1), max(b[3] - b[1] + 1, 1))
    for i in range(len(idx)):
        own = cells.boxes.get(i)
        if own is None:
            continue
        w, h = pixels(own)
        if h > flat or w > narrow:
            continue
        best = None
        for j in cells.near(own, int(mh) + 2, int(near_y) + 2):
            t = cells.boxes[j]
            tw, th = pixels(t)
            both = min(own[3], t[3]) - max(own[1], t[1]) + 1
            gap = max(max(own[1], t[1]) - min(own[3], t[3]) - 1, 0)
            near = both >= 0.2 * min(h, th) or (gap <= near_y and h < 0.6 * th)
            under = t[0] - mh <= (own[0] + own[2]) / 2 <= t[2] + mh
            across = min(own[2], t[2]) - max(own[0], t[0]) + 1 >= min(0.35 * w, 8.0)
            if j != i and (tw >= 2 * w or th >= 2 * h) and near and (under or across) and (best is None or (gap, j) < best):
                best = gap, j
        if best:
            cells.put(best[1], union(cells.boxes[best[1]], own))
            cells.drop(i)
    return [(idx[i], *b) for i, b in sorted(cells.boxes.items())]


def insert_kinds(rows: pa.RecordBatch, starts: np.ndarray, kinds: dict[str, tuple], tolerance: float, degrees: float, keep: tuple[str, ...]) -> pa.RecordBatch:
    """Many pages' items, new and known ones, in order: for each kind the new ones that equal no known and no earlier kept one.

    Items that equal a known one are told first. Of the pairs that are left
    the first item of each is settled when its turn as second one is over, so
    one pass over them in the order of the second settles all.
    """
    page, known = paged.pages_of(starts, rows.num_rows), rows["known"].to_numpy(zero_copy_only=False)
    value = {c: pc.fill_null(pc.dictionary_encode(rows[c]).indices, -1).to_numpy() if c == "plain" else paged.floats(rows, c) for c in rows.schema.names if c not in ("page_id", "idx", "known")}
    crowd = np.diff(starts, append=rows.num_rows).max() > CROWD
    met = {k: known.copy() for k in kinds}
    pairs: dict[str, list] = {k: [] for k in kinds}
    compared = {k: [*numbers, *(["angle"] if turned else []), *(["plain"] if worded else [])] for k, (numbers, turned, worded) in kinds.items()}
    if crowd:  # of new items that are quite equal only the first can stay
        for k, columns in compared.items():
            order = np.lexsort((np.arange(len(page)), *(value[c] for c in columns), known, page))
            same = np.ones(len(page) - 1, bool)
            for v in (page, known, *(value[c] for c in columns)):
                same &= v[order][1:] == v[order][:-1]
            for c in columns:
                same &= value[c][order][1:] >= 0 if c == "plain" else np.isfinite(value[c][order][1:])
            met[k][order[1:][same]] = True
    for first in dict.fromkeys(numbers[:2] for numbers, _, _ in kinds.values()):
        u, v = (value[c] for c in first)
        some = np.flatnonzero(np.isfinite(u) & np.isfinite(v))
        for a, b in paged.near(page[some], u[some], v[some], tolerance + 1, tolerance):
            i, j = np.minimum(some[a], some[b]), np.maximum(some[a], some[b])
            for k, (numbers, turned, worded) in kinds.items():
                if numbers[:2] != first:
                    continue
                same = ~(known[i] & known[j])
                for c in numbers:
                    same &= np.abs(value[c][i] - value[c][j]) <= tolerance
                if turned:
                    same &= np.abs(value["angle"][i] - value["angle"][j]) <= degrees
                if worded:
                    same &= (value["plain"][i] == value["plain"][j]) & (value["plain"][i] >= 0)
                mixed = same & (known[i] != known[j])
                met[k][np.where(known[i], j, i)[mixed]] = True
                same &= ~met[k][i] & ~met[k][j]
                pairs[k].append((i[same], j[same]))
    out, at = [], []
    for k in kinds:
        gone = met[k]
        if pairs[k]:
            i, j = (np.concatenate(s) for s in zip(*pairs[k], strict=True))
            open_ = ~gone[i] & ~gone[j]
            order = np.lexsort((i[open_], j[open_]))
            for a, b in zip(i[open_][order].tolist(), j[open_][order].tolist(), strict=True):
                if not gone[a]:
                    gone[b] = True
        at.append(np.flatnonzero(~gone))
        out.append(pa.repeat(k, len(at[-1])))
    kept = rows.select(["page_id", "idx", *keep]).take(pa.array(np.concatenate(at)))
    columns = [pc.cast(kept[c], pa.int64(), safe=False) if c in keep and c not in ("angle", "plain") else kept[c] for c in kept.schema.names]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(out), *columns], names=["kind", *kept.schema.names])
