"""Exact top-k inner products through vector-approximation files (operator 6).

1. The approximation: candidates stand in blocks that hold, for each vector, a
   quantised cell of one byte for each component; exact vectors stay where they are.
2. The scan: each query reads all cells. A cell bounds the score from both
   sides; the kth largest lower bound over the whole table is a floor, and
   only candidates whose upper bound reaches it can be results.
3. The exact vectors of those are fetched by key and scored. With cells this
   narrow they are little more than k for each query.

Only cells meet all queries, in tasks of a group of blocks on either side, and
so many groups of queries at a time that what is shuffled stays bounded.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEVELS = 256
#: The bound on the sum of a vector's squares, a little under 2 ** 63 for rounding.
LARGEST = 9.2e18


def _cells(x: np.ndarray) -> tuple:
    """Cells of vectors, and the lower edge and width of cell 0 for each component."""
    low, high = x.min(axis=0), x.max(axis=0)
    width = np.maximum((high - low + 1) / LEVELS, 1e-9)
    return np.minimum((x - low) / width, LEVELS - 1).astype(np.uint8), low.astype(np.float64), width


def _blocks(size: int, quantise: bool):
    """Rows (vec_id, mark, vector) to blocks of at most size vectors of one dimension, as cells or as they are."""

    def pack(rows: list[tuple]) -> bytes:
        ids, marks, vectors = zip(*rows, strict=True)
        x = np.array(vectors, np.int64).reshape(len(ids), -1)
        return pickle.dumps((np.array(ids, np.int64), np.array(marks, np.int64), _cells(x) if quantise else x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, waiting = TaskContext.get().partitionId(), 0, {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 40 | seq], pa.int64()), pa.array([dim], pa.int32()), pa.array([pack(waiting.pop(dim))], pa.binary())], names=["block", "dim", "body"])

        for b in batches:
            for i, m, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                waiting.setdefault(len(v), []).append((i, m, v))
                if len(waiting[len(v)]) >= size:
                    yield out(len(v))
        for dim in list(waiting):
            yield out(dim)

    return run


def _bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries with all cells."""
    q = queries.astype(np.float64)
    middle = q @ ((cells + 0.5) * width + low).T
    spread = np.abs(q) @ (width / 2)
    spread += 1e-9 * (1 + np.abs(q) @ (np.abs(low) + LEVELS * width))  # rounding of the products
    return middle - spread[:, None], middle + spread[:, None]


def _scan(k: int):
    """Of a group of cells and one of queries: the candidates that may be among a query's k, with their bounds."""
    names = ["query_id", "vec_id", "mark", "lower", "upper"]

    def run(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        blocks = [(d, pickle.loads(x)) for d, x in zip(candidates.column("dim").to_pylist(), candidates.column("body").to_pylist(), strict=True)]
        for dim, body in zip(queries.column("dim").to_pylist(), queries.column("body").to_pylist(), strict=True):
            own, _, vectors = pickle.loads(body)
            mine = [b for d, b in blocks if d == dim]
            if not mine:
                continue
            ids, marks = (np.concatenate([b[i] for b in mine]) for i in (0, 1))
            bounds = [_bounds(vectors, *b[2]) for b in mine]
            lower, upper = (np.concatenate([b[i] for b in bounds], axis=1) for i in (0, 1))
            same = own[:, None] == ids
            lower[same] = upper[same] = -np.inf
            floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
            i, j = np.nonzero((upper >= floor[:, None]) & ~same)
            for column, values in zip(out, (own[i], ids[j], marks[j], lower[i, j], upper[i, j]), strict=True):
                column.append(values)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) if c else pa.array([], t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def scaled(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as long; null if the vector or a component is null or not finite.

    Null too if the squares of the scaled components reach LARGEST: below it
    any inner product, and any part of its sum, fits a long (Cauchy-Schwarz),
    beyond it there need not be a score that does.
    """
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scale = lambda v: F.floor(v * factor)
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (F.abs(v * factor) + 1) * (F.abs(v * factor) + 1))
    return F.when(fine & (squares < LARGEST), F.transform(x, scale))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, query_block: int = 512, groups_at_once: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest inner products of each query.

    Both tables: vec_id and vector, an array of long, or null. A row never is
    a result of a query of its own vec_id; ties go to the smaller vec_id. Rows
    with a null id or vector take no part; vectors of other length aren't
    compared; fewer than k candidates are all returned. A repeated candidate
    row is returned once for each row; repeated query rows count as one. A
    vector whose squares sum up to LARGEST or more takes no part, as scaled()
    has it, so no sum leaves the range of a long.
    """
    usable = "vec_id is not null and vector is not null and size(vector) > 0"
    short = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) < LARGEST
    slim = lambda df: df.filter(usable).filter(short(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("vector").alias("mark"), F.col("vector").cast("array<long>").alias("vector"))
    table, asked = slim(vectors), slim(queries).distinct()
    schema = "block long, dim int, body binary"
    cells = materialise(table.mapInArrow(_blocks(block, True), schema))
    asked_blocks = materialise(asked.mapInArrow(_blocks(query_block, False), schema))
    # Groups of about four blocks on each side; every pair of groups is one task's work.
    groups, asked_groups = (max(1, -(-t.count() // 4)) for t in (cells, asked_blocks))
    g, h = F.pmod(F.xxhash64("block"), F.lit(groups)), F.pmod(F.xxhash64("block"), F.lit(asked_groups))
    every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)).cast("array<long>"))
    found = None
    for lo in range(0, asked_groups, groups_at_once):
        hi = min(asked_groups, lo + groups_at_once) - 1
        left = cells.withColumn("g", g).withColumn("h", every(lo, hi))
        right = asked_blocks.withColumn("h", h).filter(F.col("h").between(lo, hi)).withColumn("g", every(0, groups - 1))
        met = materialise(left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_scan(k), "query_id long, vec_id long, mark long, lower double, upper double"))
        found = met if found is None else found.unionByName(met)
    # The floor of each query over the whole table, then what reaches it.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    kth = found.select("query_id", "lower").withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.min("lower").alias("floor"), F.count("*").alias("n"))
    left = found.join(kth, "query_id").filter((F.col("upper") >= F.col("floor")) | (F.col("n") < k)).select("query_id", "vec_id", "mark").distinct()
    exact = left.join(table, ["vec_id", "mark"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id").filter(F.size("vector") == F.size("query"))
    score = F.aggregate(F.zip_with("vector", "query", lambda a, b: a * b), F.lit(0).cast("long"), lambda x, y: x + y)
    scored = exact.select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
