"""Folds of many whole pages at a time, over plain columns.

Rows are dealt out by page and sorted, so a task reads page after page and
hands some tens of thousands of rows, always whole pages, to one call of numpy.
A page in an array of its own, folded row by row, costs many times as much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Rows of a call, at least.
SIZE = 50_000


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    one_null = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), one_null).to_numpy(zero_copy_only=False)


def starts_of(b: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None = None) -> np.ndarray:
    """Rows of b where other keys begin than in the row before, which for the first one is the last of `before`."""
    new = np.zeros(b.num_rows, bool)
    new[0] = before is None
    for c in keys:
        v = b[c]
        new[1:] |= _differs(v[1:], v[:-1])
        if before is not None:
            new[:1] |= _differs(v[:1], before[c][-1:])
    return np.flatnonzero(new)


def by_page(df: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str, size: int = SIZE) -> DataFrame:
    """fold(rows, starts) over whole pages, rows of equal keys, in order; starts has the first row of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def folded() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return fold(rows, starts_of(rows, keys))

        for b in batches:
            if not b.num_rows:
                continue
            starts = starts_of(b, keys, held[-1] if held else None)
            at = int(starts[-1]) if len(starts) else 0
            if len(starts) and n + at >= size:
                if at:
                    held.append(b.slice(0, at))
                yield folded()
                held, n, b = [], 0, b.slice(at)
            held.append(b)
            n += b.num_rows
        if held:
            yield folded()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pages_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of its page for each of n rows."""
    return np.repeat(np.arange(len(starts)), np.diff(starts, append=n))


def floats(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return pc.cast(rows[name], pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def near(page: np.ndarray, u: np.ndarray, v: np.ndarray, du: float | np.ndarray, dv: float | np.ndarray, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of one page whose v, the smaller one first, differ by up to dv and whose u differ by less than du, some others and some pairs twice among them.

    Rows lie in strips of u two du wide, and again in strips moved by half; in
    a strip each meets those behind it in the order of v, all at one distance
    in rows at a time. du and dv are numbers or one for each row, equal within
    a page. Rows that the caller has marked in done meet no more as i.
    """
    n = len(page)
    du, dv = np.broadcast_to(du, n), np.broadcast_to(dv, n)
    for shift in (0, 0.5):
        strip = np.floor(u / (2 * du) + shift)
        order = np.lexsort((v, strip, page))
        p, s, w, reach = page[order], strip[order], v[order], dv[order]
        at, step = np.arange(n - 1), 1
        while at.size:
            if done is not None:
                at = at[~done[order[at]]]
            at = at[at + step < n]
            to = at + step
            keep = (p[to] == p[at]) & (s[to] == s[at]) & (w[to] - w[at] <= reach[at])
            at, to = at[keep], to[keep]
            if at.size:
                yield order[at], order[to]
            step += 1
