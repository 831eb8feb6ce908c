"""SimHash near-duplicates through segment popcounts (operator 7).

A fingerprint of 64 bits is cut into 32 segments; its vector holds the number
of bits set in each. The Manhattan distance of two vectors is a lower bound of
the Hamming distance. Fingerprints within 4 bits have vectors within 4, so in
one half of the segments within 2. The cells of the grid are the vectors of a
half; both sides of the join visit the cells within distance 1 of their own,
so such pairs meet in a cell. Each pair that meets is verified exactly.

Equal fingerprints are one row throughout. A dense group of near copies is
first tied together by one hub for each cell (a star, not all pairs); the join
then gives only the links between groups that aren't connected yet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, measured_broadcasts
from .graph import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
EVEN = 0x55555555


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned; bit set if it is set in over half of the shingles' hashes, repeats included."""
    words = WORDS(text.encode("utf-8", "replace").lower()) if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    last = ends[-n:]
    hashes = xxhash.xxh64_intdigest
    return majority(np.array([hashes(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    by_byte = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (its 64 bits as a long) of every row; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _halves(fp: str = "fp") -> list[Column]:
    """The two halves of the popcount vector, two bits for each of 16 segments, told apart by bit 32."""
    halves = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    low, high = (x - F.shiftright(x, 1).bitwiseAND(F.lit(EVEN)) for x in halves)
    return [low, high.bitwiseOR(F.lit(1 << 32))]


def _cells(half: Column) -> Column:
    """A half and its neighbours: one segment's count more or less by one."""
    near = [half]
    for i in range(16):
        count = F.shiftright(half, 2 * i).bitwiseAND(F.lit(3))
        near += [F.when(count < 2, half + F.lit(1 << 2 * i)), F.when(count > 0, half - F.lit(1 << 2 * i))]
    return F.array_compact(F.array(*near))


def _links(prints: DataFrame, bits: int = 4, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, root): each fingerprint and the smallest one that it hangs together with, prints: distinct fp.

    check: which of the pairs (a, b) within bits are links, all without it.
    Cells are asked to be sorted and merged: Spark takes them for as small as
    the fingerprints, of which each has about 50.
    """
    exact = prints.select("fp", F.explode(F.array(*_halves())).alias("cell"))
    hubs = exact.groupBy("cell").agg(F.min("fp").alias("hub"))
    stars = exact.join(hubs.hint("merge"), "cell").filter((F.col("fp") != F.col("hub")) & _near("fp", "hub", bits)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    tied = components(stars if check is None else check(stars))
    known = materialise(prints.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    discard(tied)
    cells = known.select("fp", "root", F.explode(F.concat(*[_cells(h) for h in _halves()])).alias("cell"))
    left, right = cells, cells.select(F.col("fp").alias("fp2"), F.col("root").alias("root2"), "cell")
    meet = left.join(right.hint("merge"), (left["cell"] == right["cell"]) & (F.col("root") < F.col("root2")) & _near("fp", "fp2", bits))
    if check is None:
        more = components(meet.select(F.col("root2").alias("a"), F.col("root").alias("b")))
    else:
        root = lambda k: known.select(F.col("fp").alias(k), F.col("root").alias(f"root_{k}"))
        kept = check(meet.select(F.col("fp2").alias("a"), F.col("fp").alias("b")).distinct())
        more = components(kept.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    out = materialise(known.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root")))
    discard(known, more)
    return out


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id linked over any number of steps, for every row.

    Links join fingerprints that differ in at most bits (4 at most: the grid
    is made for it). A null or blank text has fingerprint 0 and is linked like
    any other. Repeated rows each give a row; a null doc_id is never the
    smallest unless its component has no other. Other columns are not read.
    """
    if bits > 4:
        raise ValueError("the grid finds pairs within 4 bits")
    with measured_broadcasts(docs.sparkSession):
        return _near_duplicates(docs, bits, shingle)


def _near_duplicates(docs: DataFrame, bits: int, shingle: int) -> DataFrame:
    rows = materialise(fingerprints(docs, shingle))
    first = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = _links(first.select("fp"), bits)
    ids = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(roots.join(ids, "root").select("fp", "component_id"))
    discard(first, roots)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
