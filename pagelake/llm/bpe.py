"""Byte-pair encoding and decoding over a distinct-word table (operator 1).

1. Tasks split whole texts into words and cut their rows into blocks. A block
   keeps its distinct words and, for every position, the number of its word.
2. The words of all blocks are put together by word: the distinct-word table,
   sorted, in which each word is encoded once.
3. A join by block gives each block its words' ids, by number, which fill the positions.
4. Decoding joins the ids that a block holds, each once, with the vocabulary's
   id-to-piece table. Its pieces go on in the same task, ahead of its rows.

Texts travel once, as compressed word numbers; equal shuffles are reused by
Spark. Blocks depend on the order of rows within input partitions, which a
file scan repeats when a task is run again; their ids hold a checksum, so any
other order fails instead of mixing words up.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TOKENIZER = "word_bpe_49k.json"
#: Fixed values of the tokenizer: its special tokens and its word pattern (on normalised text).
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
WORD = regex.compile(r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
#: Characters of text in a block: larger blocks repeat fewer words, and take more memory in a task.
BLOCK_CHARS = 32 << 20


#: Outside of these, Unicode versions differ: letters, and marks and their order, are left to the library.
STEADY = regex.compile("[\u0000-\u02ff\u2000-\u20cf]*+").fullmatch


def normalise(text: str) -> str:
    """NFC and lower case, letter by letter (no final-sigma rule)."""
    if text.isascii() or STEADY(text):
        return text.lower()  # nothing here is composed any further
    if "nfc" not in _LOADED:
        from tokenizers import normalizers

        _LOADED["nfc"] = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return _LOADED["nfc"].normalize_str(text)


def split_words(text: str) -> list[str]:
    if "<|" in text and SPECIAL.search(text):
        return [w for i, part in enumerate(SPECIAL.split(text)) for w in ([part] if i % 2 else WORD(normalise(part)))]
    return WORD(normalise(text))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pack(kept: list[pa.RecordBatch], lengths: list[int], codes: list[np.ndarray], numbers: _Numbers) -> tuple[int, bytes]:
    """The checksum of a block's words and the block: kept columns, words per row, word numbers, words by frequency."""
    codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    order = np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(numbers), np.uint32)
    rank[order] = np.arange(len(numbers), dtype=np.uint32)
    names = list(numbers)
    words = "\n".join([names[i] for i in order]).encode("utf-8", "surrogatepass")
    planes = rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of equal weight together pack better
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept[0].schema) as out:
        for b in kept:
            out.write_batch(b)
    z = zstandard.ZstdCompressor(level=3)
    body = pickle.dumps((sink.getvalue().to_pybytes(), np.array(lengths, np.uint32).tobytes(), z.compress(planes), z.compress(words)))
    return zlib.crc32(words), body


def _blocks(keep: list[str], block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        kept, lengths, codes, numbers = [], [], [], _Numbers()

        def flush() -> pa.RecordBatch:
            crc, body = _pack(kept, lengths, codes, numbers)
            return pa.RecordBatch.from_arrays([pa.array([part << 43 | seq << 32 | crc], pa.int64()), pa.array([body], pa.binary())], names=["block", "body"])

        def take(batch: pa.RecordBatch, lo: int, hi: int) -> None:
            rows = pa.array(range(lo, hi), pa.int32())  # a copy: slices would hold on to the batch with all its texts
            kept.append(pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns[:-1]], names=keep))

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                text = t.as_py()
                words = split_words(text)
                lengths.append(len(words))
                codes.append(np.array(list(map(numbers.__getitem__, words)), np.uint32))
                size += len(text)
                if size >= block_chars:
                    take(batch, start, i + 1)
                    yield flush()
                    start, seq, size = i + 1, seq + 1, 0
                    kept, lengths, codes, numbers = [], [], [], _Numbers()
            if start < batch.num_rows:
                take(batch, start, batch.num_rows)
        if kept:
            yield flush()

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block with their numbers."""
    for b in batches:
        for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = zstandard.decompress(pickle.loads(body)[3])
            words = raw.decode("utf-8", "surrogatepass").split("\n") if raw else []
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some, pa.string())], names=["block", "number", "word"])


_LOADED: dict[object, object] = {}


def tokenizer(file: str):
    if file not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        t.no_truncation()
        t.no_padding()
        _LOADED[file] = t
    return _LOADED[file]


def word_encoder(file: str):
    """The tokenizer for words of split_words(). They are normalised; a second time would move marks behind the one that a capital İ leaves."""
    if (file, "words") not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(tokenizer(file).to_str())
        t.normalizer = None
        _LOADED[file, "words"] = t
    return _LOADED[file, "words"]


def pieces(file: str) -> list[str]:
    """The id-to-piece table."""
    t = tokenizer(file)
    return [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]


def id_kind(file: str) -> str:
    """The smallest unsigned integers that hold the vocabulary's ids."""
    return "<u2" if tokenizer(file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _encode_words(file: str) -> Callable:
    """Rows (block, number, word), sorted by word, to (block, number, ids), ids packed; each distinct word of the task is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kind = word_encoder(file), id_kind(file)
        last, packed = None, b""
        for b in batches:
            named = b.column(2).dictionary_encode()
            words = named.dictionary.to_pylist()
            if not words:
                continue
            known = [packed] if words[0] == last else []  # a word that the batch before ended with
            known += [np.array(e.ids, kind).tobytes() for e in t.encode_batch(words[len(known) :], add_special_tokens=False)]
            last, packed = words[-1], known[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known, pa.binary()).take(named.indices)], names=["block", "number", "ids"])

    return run


def _piece_table(spark: SparkSession, file: str) -> DataFrame:
    """The id-to-piece table: the tokenizer's vocabulary, of fixed size, so joins broadcast it."""
    return F.broadcast(spark.createDataFrame(list(enumerate(pieces(file))), "id int, piece string"))


def _decoded(lists: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, decoded) of rows (key, ids), keys distinct: ids meet their pieces in a join and are put back in order."""
    parts = lists.select(key, F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    joined = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return joined.select(key, F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))


class _Words:
    """Ids of a block's words, by word number, as one flat array."""

    def __init__(self, entries: pa.Table, words: int, kind: str):
        number = entries.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        if len(number) != words or not np.array_equal(number[order], np.arange(words)):
            raise ValueError("words of a block are missing; checkpoint the input")
        self.order = pa.array(order)
        packed = pa.concat_arrays(entries.column("ids").chunks or [pa.array([], pa.binary())]).take(self.order)
        _, offsets, data = packed.buffers()
        size = np.dtype(kind).itemsize
        ends = np.frombuffer(offsets, np.int32)[: words + 1].astype(np.int64) // size if words else np.zeros(1, np.int64)
        self.flat = np.frombuffer(data, kind, count=int(ends[-1])) if words and ends[-1] else np.zeros(0, kind)
        self.first, self.n = ends[:-1], np.diff(ends)

    def ids(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of the given numbers of words, and where each row ends."""
        n = self.n[codes]
        sums = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.first[codes] - sums[:-1], n) + np.arange(sums[-1])
        return self.flat[at], sums[np.cumsum(lengths)]


def _join_back(file: str, keep: list[str], schema: pa.Schema, packed: bool, at_once: int = 1 << 20) -> Callable:
    """A block's rows with their ids, an array; packed: bytes, after rows that hold nothing but one of the block's distinct ids each."""
    kind = id_kind(file)

    def column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        first = np.concatenate(([0], ends))
        if not packed:
            return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
        size = np.dtype(kind).itemsize
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((first * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, kind))])

    def run(blocks: pa.Table, entries: pa.Table) -> pa.Table:
        if blocks.num_rows != 1:
            raise ValueError("a block was split differently when it was computed again; checkpoint the input")
        kept, lengths, planes, _ = pickle.loads(blocks.column("body")[0].as_py())
        kept, lengths = pa.ipc.open_stream(kept).read_all(), np.frombuffer(lengths, np.uint32).astype(np.int64)
        planes = np.frombuffer(zstandard.decompress(planes), np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)
        words = _Words(entries, int(codes.max()) + 1 if len(codes) else 0, kind)
        ends = np.cumsum(lengths)
        out, lo = [], 0
        while lo < len(lengths):  # rows of about a million words at a time
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + at_once, side="right")))
            out.append(column(*words.ids(codes[done : int(ends[hi - 1])], lengths[lo:hi])))
            lo = hi
        columns = [*(kept.column(k) for k in keep), pa.chunked_array(out, schema.field(len(keep)).type)]
        if not packed:
            return pa.Table.from_arrays(columns, schema=schema)
        used = pa.array(np.unique(words.flat).astype(np.int32))
        ahead = pa.Table.from_arrays([*(pa.nulls(len(used), f.type) for f in list(schema)[:-1]), used], schema=schema)
        return pa.concat_tables([ahead, pa.Table.from_arrays([*columns, pa.nulls(len(lengths), pa.int32())], schema=schema)])

    return run


def _encode(docs: DataFrame, keep: tuple[str, ...], file: str, packed: bool, block_chars: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    kept = source.drop("__text").schema
    more = [pa.field("__ids", pa.binary()), pa.field("__id", pa.int32())] if packed else [pa.field("ids", pa.list_(pa.int32()))]
    schema = pa.schema([*(pa.field(f.name, f.type) for f in to_arrow_schema(kept)), *more])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__ids binary, __id int" if packed else "ids array<int>"])
    blocks = source.mapInArrow(_blocks(list(keep), block_chars), "block long, body binary").repartition("block")
    words = blocks.mapInArrow(_words, "block long, number int, word string")
    # The distinct-word table: rows of a word stand together, so it is encoded once, and none moves before its ids do.
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(file), "block long, number int, ids binary")
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_join_back(file, list(keep), schema, packed), ddl)


def _as_digests(keep: list[str], file: str) -> Callable:
    """Rows (keep, packed ids, id, piece) to digests: a row with an id brings its piece, the others are decoded by the pieces before them."""
    kind, names = id_kind(file), [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bytes] = {}
        for b in batches:
            n = len(keep)
            told = b.filter(b.column(n + 1).is_valid())
            known.update(zip(told.column(n + 1).to_pylist(), told.column(n + 2).cast(pa.binary()).to_pylist(), strict=True))
            rows, out = b.filter(b.column(n).is_valid()), []
            for packed in rows.column(n):
                ids = np.frombuffer(packed.as_buffer(), kind)
                decoded = b" ".join(map(known.__getitem__, ids.tolist()))
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 3
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:n], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), file: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns keep and ids, an array, for every row of docs.

    Whole texts, encoded as the tokenizers library does without added special
    tokens. A null or empty text has no ids; repeated rows and null ids each
    keep their row; other columns of docs are not read. A task holds one
    block: about block_chars characters, or one text if that is longer.
    """
    return _encode(docs, keep, file or public_tokenizers.path(TOKENIZER), False, block_chars)


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), file: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns keep, n_tokens, ids_sha256 and decoded_sha256: encode and decode without keeping the ids.

    A null or empty text has no tokens and the digests of nothing; repeated
    rows and null ids each keep their row; other columns of docs are not read.
    The join with the id-to-piece table streams a block's rows on in their
    order; a piece that came late would fail the task, not change a result.
    """
    file = file or public_tokenizers.path(TOKENIZER)
    coded = _encode(docs, keep, file, True, block_chars).join(_piece_table(docs.sparkSession, file).toDF("__id", "__piece"), "__id", "left").select(*keep, "__ids", "__id", "__piece")
    ddl = "".join(f"`{k}` {coded.schema[k].dataType.simpleString()}, " for k in keep)
    return coded.mapInArrow(_as_digests(list(keep), file), f"{ddl}n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id and decoded for each row (doc_id, ids): ids joined with the id-to-piece table.

    Pieces are joined by blanks, special tokens included. No ids give ''.
    Repeated rows and null ids each keep their row: equal id lists, told apart
    by two hashes of 64 bits, are decoded once and joined back.
    """
    # null and [] share a key and a text.
    rows = encoded.select("doc_id", "ids", F.struct(F.xxhash64("ids").alias("a"), F.xxhash64(F.lit(1), "ids").alias("b")).alias("__key"))
    texts = _decoded(rows.select("__key", "ids").dropDuplicates(["__key"]), "__key", _piece_table(encoded.sparkSession, file or public_tokenizers.path(TOKENIZER)))
    return rows.join(texts, "__key").select("doc_id", "decoded")
