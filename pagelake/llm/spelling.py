"""Spelling variants by a dictionary of pairs of trie nodes (operator 11).

The words are sorted over the whole dictionary, once as they are and once
reversed. Along a sorted range a new trie node begins wherever a word leaves
the one before it, so nodes get their numbers in one pass; what a range shares
with the one before is handed over at its border. A word then gives, for each
place, the pair of the node before it and the reversed node after it, once
with the letter there skipped and once with nothing between. Words that differ
by one replaced letter meet on a pair that skips in both; a word with one more
letter meets the shorter one on a pair that skips in one and not in the other.
A pair of nodes fixes all letters but the skipped one, so no more words meet
than there are letters, and they are exact neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: In ISO 8859-1 a letter of the alphabet is one byte, and bytes.lower() changes A-Z alone.
RUNS = re.compile(rb"[A-Za-z\xc0-\xff]+").findall
#: A range numbers its nodes from (range << SHIFT) + 1 on; 0 is the root.
SHIFT = 40
#: Words that a task gathers before it hands their counts on, and letters in them.
HELD, HELD_LETTERS = 200_000, 1 << 26
#: Rows of pairs in a batch.
BATCH = 200_000


def altered(doc: bytes, run: bytes) -> bytes:
    """The lower-cased run, without one letter if the checksum of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc + b":"))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc = doc.encode()
                for found, n in Counter(RUNS(text.encode("latin-1", "replace").lower())).items():
                    word = altered(doc, found)
                    if len(word) >= least:
                        letters += 0 if word in held else len(word)
                        held[word] += n
                if len(held) >= HELD or letters >= HELD_LETTERS:
                    yield out()
                    held.clear()
                    letters = 0
        yield out()

    return run


def dictionary(docs: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """word and n of all words of at least least_letters letters and least_n occurrences."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counted(least_letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _shared(a: str, b: str) -> int:
    """Letters that a and b begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _nodes(words: Iterator[tuple[int, str]], borders: dict[int, tuple[str, list[int]]]) -> Iterator[tuple[int, str, list[int]]]:
    """(part, word, nodes of its beginnings of 1, 2, ... letters) of words sorted by part and word.

    borders: for a part the beginning of its first word that words of earlier
    parts have too, and its nodes there.
    """
    last, before, stack, made = None, "", [], 0
    for part, word in words:
        if part != last:
            stack = [(part << SHIFT) + i for i in range(1, len(word) + 1)]
            made = len(word)
            _, known = borders.get(part, ("", []))
            stack[: len(known)] = known
        else:
            n = _shared(before, word)
            new = len(word) - n
            stack = stack[:n] + [(part << SHIFT) + made + i for i in range(1, new + 1)]
            made += new
        last, before = part, word
        yield part, word, stack


def _sorted_words(batches: Iterator[pa.RecordBatch], ids: list | None = None) -> Iterator[tuple[int, str]]:
    """(part, word) of the batches; the id of each goes into ids, if given."""
    for b in batches:
        for part, word, *id_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if ids is not None:
                ids += id_
            yield part, word


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first and last word of each part, and the last one's nodes as far as the part itself knows them."""
    ends: dict[int, list] = {}
    for part, word, nodes in _nodes(_sorted_words(batches), {}):
        ends.setdefault(part, [part, word, None, None])[2:] = [word, nodes]
    columns = list(zip(*ends.values(), strict=True)) if ends else [[]] * 4
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "first", "last", "nodes"])


def _numbered(borders: dict[int, tuple[str, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        out: list = []
        letters = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 2
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))], names=["id", "nodes"])

        for _, word, nodes in _nodes(_sorted_words(batches, ids), borders):
            out.append((ids.pop(), nodes))
            letters += len(word)
            if letters >= BATCH:
                yield batch()
                out.clear()
                letters = 0
        yield batch()

    return run


def trie_nodes(ranged: DataFrame) -> DataFrame:
    """id and nodes, the numbers of the trie nodes along the word, for ranged: part, word, id.

    Parts follow each other in the order of their words. Of each part one row,
    its first and last word, comes to the driver.
    """
    rows = ranged.select("part", "word", "id").repartition("part").sortWithinPartitions("part", "word")
    ends = rows.select("part", "word").mapInArrow(_ends, "part long, first string, last string, nodes array<long>")
    borders: dict[int, tuple[str, list[int]]] = {}
    before, known = "", []
    for part, first, last, nodes in sorted(ends.collect(), key=lambda r: r["part"]):
        n = _shared(before, first)
        borders[part] = (first[:n], list(known[:n]))
        n = min(n, _shared(first, last))
        before, known = last, [*known[:n], *nodes[n:]]
    return rows.mapInArrow(_numbered(borders), "id long, nodes array<long>")


def _ranged(words: DataFrame) -> DataFrame:
    """words in order, with row rising along it and part, the range it lies in."""
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("row", F.monotonically_increasing_id())
    return materialise(ordered.withColumn("part", F.shiftright("row", 33)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s, skips, id, n) for each place of a word: 0 with nothing between the nodes, 2 with a letter that begins a run of its kind, 1 with another."""
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p", "s", "skips", "id", "n"])

    for b in batches:
        for id_, n, word, nodes, back in zip(*(c.to_pylist() for c in b.columns), strict=True):
            p, s = np.array([0, *nodes], np.int64), np.array([0, *back], np.int64)
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)
            begins = np.concatenate(([2], 1 + (letters[1:] != letters[:-1])))
            rows = 2 * len(letters) + 1
            out.append((np.concatenate((p[:-1], p)), np.concatenate((s[:-1][::-1], s[::-1])), np.concatenate((begins, np.zeros(len(p), np.int64))).astype(np.int32), np.full(rows, id_), np.full(rows, n)))
            size += rows
            if size >= BATCH:
                yield batch()
                out.clear()
                size = 0
    yield batch()


def _met(p: np.ndarray, s: np.ndarray, skips: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """id, near words, n and id of the best of them, for whole groups of equal (p, s), sorted by skips = 0 first, n falling, id."""
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    new, group, skips, ids, n = new[many], group[many], skips[many], ids[many], n[many]
    if not len(ids):
        return [np.zeros(0, np.int64)] * 4
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    row = np.arange(len(ids))
    whole = skips[start] == 0
    skipping = np.bincount(group, skips > 0).astype(np.int64)
    best = start + whole
    # One letter replaced: all that skip the same place; the best of the others is the first or, for the first itself, the second.
    a = np.flatnonzero((skips > 0) & (skipping[group] > 1))
    other = np.where(row[a] == best[group[a]], best[group[a]] + 1, best[group[a]])
    # One letter more: those whose letter begins a run, so each pair of words meets once.
    c = np.flatnonzero((skips == 2) & whole[group])
    short = start[group[c]]
    longer = np.bincount(group, skips == 2).astype(np.int64)
    first = np.minimum.reduceat(np.where(skips == 2, row, len(row)), start)
    g = np.flatnonzero(whole & (longer > 0))
    return [
        np.concatenate((ids[a], ids[c], ids[start[g]])),
        np.concatenate((skipping[group[a]] - 1, np.ones(len(c), np.int64), longer[g])),
        np.concatenate((n[other], n[short], n[first[g]])),
        np.concatenate((ids[other], ids[short], ids[first[g]])),
    ]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, np.int64)] * 5

    def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "near", "best_n", "best_id"])

    for b in batches:
        held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, b.columns, strict=True)]
        p, s = held[:2]
        last = (p != p[-1]) | (s != s[-1]) if len(p) else np.zeros(0, bool)
        end = int(last.sum())  # the last group may go on in the next batch
        if end:
            yield batch(_met(*(h[:end] for h in held)))
            held = [h[end:] for h in held]
    if len(held[0]):
        yield batch(_met(*held))


def near_words(words: DataFrame, ranged: DataFrame) -> DataFrame:
    """id, n_near, best_n and best_id (the near word of largest n, the smallest id among equals) of all words with a near word.

    words: id, word, n, where ids rise with the word; ranged: the same with
    the part each lies in.
    """
    back = _ranged(words.select("id", F.reverse("word").alias("word")))
    fore = trie_nodes(ranged.select("part", "word", "id"))
    both = words.join(fore, "id").join(trie_nodes(back).withColumnRenamed("nodes", "back"), "id")
    pairs = both.select("id", "n", "word", "nodes", "back").mapInArrow(_pairs, "p long, s long, skips int, id long, n long")
    grouped = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.col("skips") > 0, F.desc("n"), "id")
    met = grouped.mapInArrow(_neighbours, "id long, near long, best_n long, best_id long")
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("id"))).alias("best"))
    out = materialise(near.select("id", "n_near", "best.best_n", (-F.col("best.id")).alias("best_id")))
    discard(back)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word on the way along forms (id, form). n at least doubles with each step, so ways are short and jumps of double length soon end."""
    ways = materialise(forms.select("id", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = materialise(ways.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(ways)
        ways = longer
        if not ways.filter("moved").limit(1).count():
            return ways


def variants(docs: DataFrame, least_letters: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the dictionary of docs.

    Words come from whole texts, see altered() and dictionary(). form is the
    near word of largest n, the first in code-point order among equals, if its
    n is at least `times` that of the word; root is where following forms ends,
    the word itself without a form. A null text has no words; a null doc_id is
    written as an empty string in the checksum. Repeated rows count each. An
    empty table gives no rows. Other columns are not read.
    """
    counts = materialise(dictionary(docs, least_letters, least_n))
    ranged = _ranged(counts)
    words = ranged.select(F.col("row").alias("id"), "word", "n")
    near = near_words(words, ranged.withColumnRenamed("row", "id"))
    told = words.join(near, "id", "left").withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best_id")))
    roots = _roots(told.filter("form is not null").select("id", "form"))
    name = lambda key, as_: words.select(F.col("id").alias(key), F.col("word").alias(as_))
    out = told.join(roots.select("id", F.col("root").alias("root_id")), "id", "left").join(name("form", "form_word"), "form", "left").join(name("root_id", "root_word"), "root_id", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("best_n"))
    discard(counts)
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form_n.alias("form_n"))
