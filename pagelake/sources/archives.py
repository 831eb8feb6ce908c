"""Archives (.cbz .zip .epub .cbt .tar): entries listed and read without reading the whole file.

Of a zip the central directory at its end is read, of a tar its headers, which
seeking skips from one to the next. An entry's bytes are read where they lie.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from .ranges import Counted, Span, list_files, open_path

LISTED = (".cbz", ".zip", ".epub", ".cbt", ".tar")
_TARS = (".cbt", ".tar")
#: Entries in a batch.
ROWS = 10_000


def _names(path: str, f: Counted) -> Iterator[str]:
    """The names of an archive's files, in its own order."""
    if path.lower().endswith(_TARS):
        with tarfile.open(fileobj=f, mode="r:") as t:
            while (m := t.next()) is not None:
                t.members = []  # what has been seen isn't kept
                if m.isfile():
                    yield m.name
    elif path.lower().endswith(LISTED):
        with zipfile.ZipFile(f) as z:
            yield from (n for n in z.namelist() if not n.endswith("/"))
    else:
        raise ValueError("unsupported suffix")


_ENTRY = "archive string, pos long, entry_name string, error string, read_bytes long"


def _listed(opened: Callable):
    """Batches of (path, content or length) to entries; the last row of each archive has no name but the bytes read, and the error if there was one."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "pos", "entry_name", "error", "read_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count, error = 0, None
                try:
                    with Counted(opened(path, value)) as f:
                        try:
                            for pos, name in enumerate(_names(path, f)):
                                rows.append((path, pos, name, None, None))
                                if len(rows) >= ROWS:
                                    yield batch(rows)
                                    rows = []
                        finally:
                            count = f.count
                except Exception as e:  # a bad archive is a row, not the end of the scan
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, None, None, error, count))
            yield batch(rows)

    return run


def _pages(listed: DataFrame, *keep: str) -> DataFrame:
    """Image entries numbered in natural order, ties in the archive's own; archives that can't be read give an error row."""
    d = listed.filter((F.col("entry_name").isNull() & F.col("error").isNotNull()) | T.is_image_file(F.col("entry_name")))
    w = Window.partitionBy("archive").orderBy(F.col("error").isNotNull(), T.natural_key(F.col("entry_name")), "pos")
    return d.select("archive", "entry_name", T.safe_ext(F.col("entry_name")).alias("ext"), F.row_number().over(w).alias("page_no"), "error", *keep)


def archive_entries(files: DataFrame) -> DataFrame:
    """archive, entry_name, ext, page_no and error of the archives (path, content).

    An archive that breaks off keeps the entries before and gets an error row
    after them. A null content is an archive that can't be read.
    """
    return _pages(files.select("path", "content").mapInArrow(_listed(lambda _, content: io.BytesIO(content or b"")), _ENTRY))


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, pos, entry_name, error and read_bytes for all files below a path: entries in their own order, then one row without a name for each archive."""
    return list_files(spark, path).mapInArrow(_listed(lambda name, _: open_path(name)), _ENTRY)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives below a path, as archive_entries gives them."""
    return _pages(list_archives(spark, path))


def scan_packed_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives that lie uncompressed in the zip archives below a path, and where each archive lies: file, start and length.

    archive is the file's path with the archive's name behind it. A file that can't be read gives an error row.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with Counted(open_path(name)) as f:
                    try:
                        with zipfile.ZipFile(f) as z:
                            inner = [i for i in z.infolist() if not i.is_dir()]
                        for i in inner:
                            f.seek(i.header_offset + 26)
                            start = i.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                            rows.append((f"{name}/{i.filename}", name, start, i.file_size) if i.compress_type == zipfile.ZIP_STORED else (f"{name}/{i.filename}", name, None, None))
                    except Exception:
                        rows.append((name, name, None, None))
                for at in range(0, len(rows), 1000):
                    columns = zip(*rows[at : at + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "file", "start", "length"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = None, None
        try:
            for b in places(batches):
                where = dict(zip(b.column(0).to_pylist(), zip(*(c.to_pylist() for c in b.columns[1:]), strict=True), strict=True))

                def opened(name: str, _: object):
                    nonlocal own, file
                    path, start, length = where[name]
                    if start is None:
                        raise ValueError("no stored archive")
                    if path != own:
                        if file is not None:
                            file.close()
                        own, file = None, open_path(path)
                        own = path
                    return io.BufferedReader(Span(file, start, length), 4096)

                for out in _listed(opened)(iter([b.select(["archive", "length"])])):
                    place = [where[a] for a in out.column(0).to_pylist()]
                    columns = zip(*place, strict=True) if place else [[]] * 3
                    more = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, "file", "start", "length"])
        finally:
            if file is not None:
                file.close()

    return _pages(list_files(spark, path).mapInArrow(listed, f"{_ENTRY}, file string, start long, length long"), "file", "start", "length")


def read_entries(entries: DataFrame, spread: int = 16, large: int = 1 << 26) -> DataFrame:
    """archive, entry_name, content and error for rows (archive, entry_name) and, of archives in a part of a file, file, start and length.

    Rows of one archive come together, in `spread` parts at most, so that it
    is opened a few times and a large one isn't read by a single task; one
    that is known to be no larger than `large` is opened once.
    """
    packed = {"file", "start", "length"} <= set(entries.columns)
    own = [F.col("file"), F.col("start"), F.col("length")] if packed else [F.col("archive").alias("file"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length")]
    part = F.when(F.coalesce(F.col("length") > large, F.lit(True)), F.pmod(F.xxhash64("entry_name"), F.lit(spread))).otherwise(0)
    d = entries.select("archive", "entry_name", *own)
    d = d.repartition("archive", part).sortWithinPartitions("file", "start", "archive", "entry_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at = f = read = None
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["archive", "entry_name", "content", "error"])

        for b in batches:
            for path, name, file, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = error = None
                try:
                    if file != own:
                        if f is not None:
                            f.close()
                        own = at = f = read = None
                        f = open_path(file)
                        own = file
                    if at != path:
                        at = read = None
                        whole = f if start is None else io.BufferedReader(Span(f, start, length), 4096)
                        whole.seek(0)
                        if path.lower().endswith(_TARS):
                            read = (lambda t: lambda n: t.extractfile(n).read())(tarfile.open(fileobj=whole, mode="r:"))
                        else:
                            read = zipfile.ZipFile(whole).read
                        at = path
                    content = read(name)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, name, content, error))
                size += len(content or b"")
                if len(rows) >= 1000 or size > 1 << 22:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()
        if f is not None:
            f.close()

    return d.mapInArrow(run, "archive string, entry_name string, content binary, error string")
