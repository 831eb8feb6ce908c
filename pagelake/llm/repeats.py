"""Repeated windows in a corpus: steps that the two substring operators share.

Documents are told apart by doc (the id, or a hash of the text where it is
null) and crc. Seeds that occur once go first. Of the others each has three
digests: of its hull, which is all that its windows can cover, and of the two
halves, one of which every window contains. A hull that occurs twice settles
all windows of the seed; where neither half occurs twice there are none. What
is left is looked at window by window.

A class is told by two 64-bit digests, of the seed and of the stretch, so no
class mixes different stretches by chance. Classes that hold many rows are
few; their statistics are broadcast, and their rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .seeds import Shape, View, digest, find_seeds

#: A seed or class of more rows than this and than total / MOST is large: there are at most MOST of them, which bounds
#: what is broadcast. A large seed's rows are dealt out by as many salts as its count asks for, so that about so many
#: share a salt; rows of other seeds meet in one task each.
LARGE, MOST = 100_000, 1 << 18


def bound(total: int) -> int:
    return max(LARGE, total // MOST)


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc, crc, text and the columns carry, renamed c0, c1, ..."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return rows.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("doc"), F.crc32(F.encode("text", "utf-8")).alias("crc"), "text", *(f"c{i}" for i in range(len(carry))))


def ddl(df: DataFrame, *names: str) -> str:
    return "".join(f", `{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def packed(rows: DataFrame, *carry: str) -> DataFrame:
    """doc_id, doc, crc, the columns carry, and z: the text, compressed for its way through the shuffle."""
    names = ["doc_id", "doc", "crc", *carry, "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = [z.compress(t.as_buffer()) for t in part.column(part.num_columns - 1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary())], names=names)

    return rows.select("doc_id", "doc", "crc", *carry, "text").mapInArrow(run, f"doc_id long, doc long, crc long{ddl(rows, *carry)}, z binary")


def unpack(z: bytes) -> bytes:
    return zstandard.decompress(z)


def signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def seed_counts(rows: DataFrame, shape: Shape, view: Callable[[bytes], View]) -> DataFrame:
    """(seed, count) of the seeds that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                seeds: list[int] = []
                for text in b.column(0).slice(lo, 512):
                    v = view(text.as_py().encode())
                    seeds += [digest(v.piece(a, a + shape.k)) for a in find_seeds(v, shape).at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(signed(seeds))], names=["seed"])

    return materialise(rows.select("text").mapInArrow(run, "seed long").groupBy("seed").count().filter("count > 1"))


_SEED = "doc long, crc long, seed long, at int, near short, far short, hull long, left short, right short"


def _seed_rows(rows: DataFrame, shape: Shape, view: Callable[[bytes], View]) -> DataFrame:
    """Each seed: where it is, its windows' distances, and digests of its hull and halves, null where no window needs them.

    Two bytes do for a half: a chance collision only asks for a closer look.
    """
    names = [c.split(" ")[0] for c in _SEED.split(", ")]
    half, right_half = shape.half, shape.right_half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, counts = b.slice(lo, 512), []
                ats, nears, fars = ([np.zeros(0, np.int64)] for _ in range(3))
                seeds, hulls, lefts, rights = [], [], [], []
                for text in part.column(2):
                    v = view(text.as_py().encode())
                    found, piece = find_seeds(v, shape), v.piece
                    counts.append(len(found.at))
                    for own, more in zip((ats, nears, fars), (found.at, found.near, found.far), strict=True):
                        own.append(more)
                    for a, near, far in zip(found.at.tolist(), found.near.tolist(), found.far.tolist(), strict=True):
                        seeds.append(digest(piece(a, a + shape.k)))
                        start = a - shape.reach
                        hulls.append(digest(piece(start, start + shape.hull)) if start >= 0 and start + shape.hull <= v.n else None)
                        lefts.append(digest(piece(a - half, a + shape.k)) & 0xFFFF if far >= half else None)
                        rights.append(digest(piece(a, a + right_half)) & 0xFFFF if near < half else None)
                take = pa.array(np.repeat(np.arange(part.num_rows), counts))
                hashes = [pa.array(c, pa.uint64()).view(pa.int64()) for c in (seeds, hulls)]
                hashes += [pa.array(c, pa.uint16()).view(pa.int16()) for c in (lefts, rights)]
                at, near, far = (np.concatenate(c) for c in (ats, nears, fars))
                places = [pa.array(at.astype(np.int32)), pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), hashes[0], *places, *hashes[1:]], names=names)

    return rows.select("doc", "crc", "text").mapInArrow(run, _SEED)


def occurrence() -> Column:
    return F.xxhash64("doc", "crc", "at")


def repeated_seeds(rows: DataFrame, shape: Shape, view: Callable[[bytes], View]) -> tuple[DataFrame, bool, DataFrame]:
    """Rows of the seeds that occur more than once, dealt out by seed and salt; whether any seed is large; and the counts, a table for discard().

    large: whether the row's seed occurs so often; such rows are dealt out by
    their salt, all others have salt 0. Seeds are counted before rows move.
    """
    counts = seed_counts(rows, shape, view)
    most = bound(counts.agg(F.sum("count")).first()[0] or 0)
    salts = F.when(F.col("count") > most, F.ceil(F.col("count") / most).cast("int"))
    large = counts.select("seed", salts.alias("salts")).filter("salts is not null")
    some = bool(large.head(1))
    seeds = _seed_rows(rows, shape, view)
    if not some:
        return seeds.join(counts.select("seed"), "seed").withColumns({"large": F.lit(False), "salt": F.lit(0)}), False, counts
    salted = seeds.join(F.broadcast(large), "seed", "left").withColumn("salt", F.coalesce(F.pmod(occurrence(), F.col("salts")), F.lit(0)).cast("int"))  # at most MOST rows
    dealt = counts.select("seed", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)).alias("salt"))
    return salted.join(dealt, ["seed", "salt"]).withColumn("large", F.col("salts").isNotNull()).drop("salts"), True, counts


def windowed(*dealt: str) -> Callable[[DataFrame, list[str], Column], DataFrame]:
    """low and high as classes() gives them, for rows that stand together by the columns dealt; no rows move."""

    def spread(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
        w = Window.partitionBy(*dealt, *(k for k in keys if k not in dealt))
        known = F.expr(" and ".join(f"{k} is not null" for k in keys))
        return rows.withColumns({"low": F.when(known, F.min(value).over(w)), "high": F.when(known, F.max(value).over(w))})

    return spread


def classes(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """rows with low and high: least and greatest value of all rows of equal keys; null where a key is null or stands alone.

    For large seeds: rows are written first, as they are read more than once,
    and classes that hold many of them are joined by broadcast.
    """
    rows = materialise(rows)
    known = " and ".join(f"{k} is not null" for k in keys)
    stats = rows.filter(known).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("__n"))
    stats = materialise(stats.filter("__n > 1"))
    is_large = F.col("__n") > bound(rows.count())
    large = stats.filter(is_large).drop("__n").withColumnsRenamed({"low": "__low", "high": "__high"})
    # Rows of large classes, and those of none, are dealt out by themselves and meet nothing in the shuffle.
    own = F.when(F.expr(known) & F.col("__low").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns))
    marked = rows.join(F.broadcast(large), keys, "left").withColumn("__own", own)  # at most MOST rows
    joined = marked.join(stats.filter(~is_large).drop("__n").withColumn("__own", F.xxhash64(*keys)), ["__own", *keys], "left")
    return joined.select(*rows.columns, F.coalesce("__low", "low").alias("low"), F.coalesce("__high", "high").alias("high"))


def _judge(rows: DataFrame, shape: Shape, value: Column, settled: Column, closed: Column, spread: Callable[[DataFrame, list[str], Column], DataFrame]) -> DataFrame:
    """rows with done (all windows of the seed are repeated) and the distances lo .. hi still to look at (none: lo > hi)."""
    true = lambda c: F.coalesce(c, F.lit(False))
    out = spread(rows, ["seed", "hull"], value).withColumn("done", true(settled)).withColumn("__open", ~true(closed)).drop("low", "high")
    for side in ("left", "right"):  # halves that open rows of other value share
        out = spread(out, ["seed", side], F.when(F.col("__open"), value)).withColumn(f"ask_{side}", F.col("__open") & true(F.col("low") != F.col("high"))).drop("low", "high")
    lo = F.greatest(F.col("near"), F.when(F.col("ask_right"), 0).otherwise(shape.half))
    hi = F.least(F.col("far"), F.when(F.col("ask_left"), shape.reach).otherwise(shape.half - 1))
    return out.withColumns({"lo": lo.cast("int"), "hi": F.when(F.col("ask_left") | F.col("ask_right"), hi).otherwise(-1).cast("int")})


def asked(seeds: DataFrame, any_large: bool, shape: Shape, value: Column, settled: Column, closed: Column) -> DataFrame:
    """The rows of repeated_seeds() that are done or have windows to look at, with done, lo and hi.

    settled and closed are told from value and from low and high of the hull's
    class; closed rows are represented by another one of their class.
    """
    columns = ["doc", "crc", "seed", "at", "near", "far", "lo", "hi", "done", "large"]
    stay = "done or lo <= hi"
    dealt = ("seed", "salt") if any_large else ("seed",)
    # Asking for whole seeds first puts them together once, whichever join Spark has taken; the narrower windows then need no shuffle.
    seeds = seeds.withColumn("__n", F.count("*").over(Window.partitionBy(*dealt))).filter("large or __n > 1").drop("__n")
    out = _judge(seeds, shape, value, settled, closed, windowed(*dealt))
    if not any_large:
        return materialise(out.filter(stay).select(columns))
    if_large = [F.when(F.col("large"), F.col(c)).alias(c) for c in ("hull", "left", "right")]
    mixed = materialise(out.filter(f"large or {stay}").select(*columns, *if_large))  # what windows say of large seeds isn't used
    rows = mixed.filter("large").drop("lo", "hi", "done")
    large = _judge(rows, shape, value, settled, closed, classes).filter(stay).select(columns)
    return materialise(mixed.filter("not large").select(columns).unionByName(large))


def by_seed(rows: DataFrame, any_large: bool, narrow: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """narrow, a function of rows and of a way to classes(), over rows (seed, large, ...): one shuffle by seed, other ways for large seeds."""
    if not any_large:
        return narrow(rows.repartition("seed"), windowed("seed"))
    rows = materialise(rows)
    return narrow(rows.filter("not large").repartition("seed"), windowed("seed")).unionByName(narrow(rows.filter("large"), classes))


def to_look_at(rows: DataFrame, asked_rows: DataFrame) -> DataFrame:
    """(doc, crc, z, open) of the documents with windows to look at; open: (at, lo, hi, seed, large)."""
    open_ = asked_rows.filter("lo <= hi").groupBy("doc", "crc").agg(F.collect_list(F.struct("at", "lo", "hi", "seed", "large")).alias("open"))
    return packed(rows).join(open_, ["doc", "crc"]).select("doc", "crc", "z", "open")


def starts(rows: DataFrame, near: str = "near", far: str = "far") -> DataFrame:
    """(doc, crc, lo, hi): first and last starts of the windows of rows with at and distances."""
    return rows.select("doc", "crc", (F.col("at") - F.col(far)).alias("lo"), (F.col("at") - F.col(near)).alias("hi"))


def ranges_by_document(*tables: DataFrame) -> DataFrame:
    """(doc, crc, ranges) from rows (doc, crc, lo, hi)."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("doc", "crc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def cover(n: int, window: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of n symbols lie in a window that starts in one of the ranges (both ends included)."""
    edge = np.zeros(n + window + 2, np.int64)
    if ranges:
        lo, hi = np.array(ranges, np.int64).T
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + window, -1)
    return np.cumsum(edge)[:n] > 0
