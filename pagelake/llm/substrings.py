"""Substring dedup over words: seed and extend (operator 3).

Seeds are winnowed anchors. Documents meet on the anchors they share; around a
shared anchor the match is extended both ways, first to all that windows with
this anchor can cover, then to half a window on either side, and where that is
shared only in part, window by window. What matches an earlier document for at
least `window` words on end is a repeat; the windows found join into maximal
repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import discard, materialise
from .seeds import Shape, digest, word_view

SHAPE = Shape(window=50, k=8)


def _windows(shape: Shape):
    """Of documents with seeds to look at: every window there, and its digest."""
    names = ["doc", "crc", "at", "d", "seed", "large", "hash"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.uint64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, crc, z, open_ in zip(*(b.column(c) for c in ("doc", "crc", "z", "open")), strict=True):
                piece, doc, crc = word_view(repeats.unpack(z.as_py())).piece, doc.as_py(), crc.as_py()
                out = [
                    (doc, crc, one["at"], d, one["seed"], one["large"], digest(piece(one["at"] - d, one["at"] - d + shape.window)))
                    for one in open_.as_py()
                    for d in range(one["lo"], one["hi"] + 1)
                ]
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.int64())], names=names)

    return run


def earlier_windows(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """(doc, crc, ranges): first and last starts of windows that also start in a document of smaller doc_id."""
    rows = repeats.keyed(docs).filter("doc_id is not null")
    doc = F.col("doc")
    earlier = F.coalesce(F.col("low") < doc, F.lit(False))  # the earliest stays open for others
    seeds, any_large, counts = repeats.repeated_seeds(rows, shape, word_view)
    asked = repeats.asked(seeds, any_large, shape, doc, earlier, earlier)
    discard(counts)

    def narrow(windows: DataFrame, spread: Callable) -> DataFrame:
        found = spread(windows, ["seed", "hash"], doc).filter(earlier)
        return repeats.starts(found.select("doc", "crc", "at", F.col("d").alias("near"), F.col("d").alias("far")))

    windows = repeats.to_look_at(rows, asked).mapInArrow(_windows(shape), "doc long, crc long, at int, d int, seed long, large boolean, hash long")
    found = materialise(repeats.ranges_by_document(repeats.starts(asked.filter("done")), repeats.by_seed(windows, any_large, narrow)))
    discard(asked)
    return found


def remove_repeats(docs: DataFrame, shape: Shape = SHAPE, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (with_text: also kept, the text) for every row.

    Words are runs of characters other than blanks, tabs and line ends. A word
    goes if a window of 50 words around it also starts in a document of
    smaller doc_id, judged on the input. A null or blank text has no words.
    Rows of equal id and text count as one document. A row without doc_id
    neither loses words nor makes others lose any. Other columns are not read.
    """
    window = shape.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, z, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = repeats.unpack(z).split()
                gone = repeats.cover(len(words), window, [(r["lo"], r["hi"]) for r in ranges]) if ranges else None
                left = words if gone is None else list(compress(words, ~gone))
                kept = b" ".join(left)
                out.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    found = earlier_windows(docs, shape)
    joined = repeats.packed(repeats.keyed(docs)).join(found, ["doc", "crc"], "left").select("doc_id", "z", "ranges")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
