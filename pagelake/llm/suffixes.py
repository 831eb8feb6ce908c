"""Suffix dedup over bytes by classes of winnowed seeds, in place of suffix sorting (operator 5).

A suffix tuple for every byte needs several times the text on disk (README has
figures), so no suffix is sorted and no order induced. Windows of 200 bytes get
a seed; those that start up to `reach` bytes before it are told apart by their
distance d: two of them are equal iff they have equal seeds at the same d, the
d bytes before and the 200 - d bytes from the seed on being equal. Digests of
stretches stand for the bytes. The classes narrow: all distances of a seed at
once, its two halves, then parts of a few distances, then single ones, each on
what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import discard, materialise
from .seeds import Shape, byte_view, digest

SHAPE = Shape(window=200, k=24, part=8)


def _parts(shape: Shape):
    """Of documents with seeds to look at: the parts of their distances that have windows there.

    core: digest of what all windows of the part share; left and right: the
    bytes beyond it; lo, hi: the smallest and largest distance in use.
    """
    names = ["doc", "crc", "at", "lo", "hi", "seed", "large", "core", "left", "right", "part"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, crc, z, open_ in zip(*(b.column(c) for c in ("doc", "crc", "z", "open")), strict=True):
                raw, doc, crc, out = repeats.unpack(z.as_py()), doc.as_py(), crc.as_py(), []
                for one in open_.as_py():
                    at, lo, hi, seed, large = (one[k] for k in ("at", "lo", "hi", "seed", "large"))
                    for part in range(lo // shape.part, hi // shape.part + 1):
                        d0 = part * shape.part
                        d1 = min(d0 + shape.part - 1, shape.reach)
                        a, e = at - d0, at - d1 + shape.window
                        core = digest(raw[max(0, a) : e], part)
                        core = core - (1 << 64) if core >> 63 else core
                        out.append((doc, crc, at, max(lo, d0), min(hi, d1), seed, large, core, raw[max(0, at - d1) : max(0, a)], raw[e : a + shape.window], part))
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def repeated_windows(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """(doc, crc, ranges): first and last starts of windows whose bytes also start anywhere else."""
    rows = repeats.keyed(docs)
    here, several = repeats.occurrence(), F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    # One of each settled class stays open as well: others may match a part of it only.
    closed = several & (here != F.col("low"))
    seeds, any_large, counts = repeats.repeated_seeds(rows, shape, byte_view)
    asked = repeats.asked(seeds, any_large, shape, here, several, closed)
    discard(counts)
    last = F.least((F.col("part") + 1) * shape.part - 1, F.lit(shape.reach))  # the part's largest distance
    width = last - F.col("part") * shape.part

    def narrow(parts: DataFrame, spread: Callable) -> DataFrame:
        """Starts of repeated windows: distances of a part, all or none where its hull or core says so, then single ones."""
        whole = (F.length("left") == width) & (F.length("right") == width)
        parts = spread(parts, ["seed", "core"], here).filter(several).drop("low", "high").withColumn("hull", F.when(whole, F.xxhash64("core", "left", "right")))
        parts = spread(parts, ["seed", "core", "hull"], here).withColumns({"done": several, "open": ~closed}).drop("low", "high")
        # A row with no distance for all of a part, and one for each single distance.
        all_of_it, singly = F.array(F.lit(None).cast("int")), F.sequence("lo", "hi")
        d = F.explode(F.when(F.col("done") & F.col("open"), F.concat(all_of_it, singly)).when(F.col("done"), all_of_it).otherwise(singly))
        parts = parts.withColumn("d", d)
        before, after = F.col("d") - F.col("part") * shape.part, last - F.col("d")
        name = F.xxhash64("d", F.substring(F.col("left"), F.length("left") - before + 1, before), F.substring(F.col("right"), F.lit(1), after))
        single = parts.select("doc", "crc", "at", "lo", "hi", "seed", "core", "d", F.when(F.col("d").isNotNull(), name).alias("name"))
        single = spread(single, ["seed", "core", "name"], here).filter(F.col("d").isNull() | several)
        return repeats.starts(single.select("doc", "crc", "at", F.coalesce("d", "lo").alias("near"), F.coalesce("d", "hi").alias("far")))

    parts = repeats.to_look_at(rows, asked).mapInArrow(_parts(shape), "doc long, crc long, at int, lo int, hi int, seed long, large boolean, core long, left binary, right binary, part int")
    # Rows of equal id and text stand for each other above; every window of theirs is repeated.
    length = F.octet_length("text")
    copies = rows.groupBy("doc", "crc").agg(F.count("*").alias("n"), F.max(length).alias("size")).filter(f"n > 1 and size >= {shape.window}")
    found = materialise(
        repeats.ranges_by_document(
            repeats.starts(asked.filter("done")),
            repeats.by_seed(parts, any_large, narrow),
            copies.select("doc", "crc", F.lit(0).alias("lo"), (F.col("size") - shape.window).cast("int").alias("hi")),
        )
    )
    discard(asked)
    return found


def remove_repeats(docs: DataFrame, shape: Shape = SHAPE, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A byte of the UTF-8 text goes if 200 bytes around it also start anywhere
    else, in this or another document; overlaps count, all is judged on the
    input. n_spans counts maximal removed runs. with_text: also kept, the text
    that stays (without characters cut in two), spans, and the columns carry of docs as c0, c1, ... A null text
    counts as empty. Each row is a document, so rows of equal id and text, or of
    equal text without id, repeat each other. Other columns are not read.
    """
    window, more = shape.window, [f"c{i}" for i in range(len(carry))]
    names = ["doc_id", *more, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, out = b.slice(lo, 256), []
                for z, ranges in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    raw = repeats.unpack(z)
                    gone = repeats.cover(len(raw), window, [(r["lo"], r["hi"]) for r in ranges or ()])
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2).tolist()
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if edges else raw
                    out.append((len(raw), len(raw) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None, edges if with_text else None))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    found = repeated_windows(docs, shape)
    rows = repeats.keyed(docs, carry)
    joined = repeats.packed(rows, *more).join(found, ["doc", "crc"], "left").select("doc_id", *more, "z", "ranges")
    out = joined.mapInArrow(run, f"doc_id long{repeats.ddl(rows, *more)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<array<long>>")
    return out if with_text else out.drop("kept", "spans")
