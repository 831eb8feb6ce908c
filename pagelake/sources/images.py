"""Sizes of images from their headers: PNG, BMP, GIF, JPEG, WebP, AVIF."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Counted, list_files, open_path

SCHEMA = "path string, width int, height int, error string, read_bytes long"


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the file ends in its header")
    return data


def _jpeg(f: BinaryIO) -> tuple[int, int]:
    """The frame header, from segment to segment: what lies within one, such as a thumbnail, is passed over."""
    at = 2
    while True:
        f.seek(at)
        if _exactly(f, 1) != b"\xff":
            raise ValueError("no marker where a segment ends")
        marker = 0xFF
        while marker == 0xFF:
            marker = _exactly(f, 1)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            _, _, height, width = struct.unpack(">HBHH", _exactly(f, 7))
            return width, height
        if marker in (0xD9, 0xDA):
            raise ValueError("no frame header")
        at = f.tell()
        if marker != 0x01 and not 0xD0 <= marker <= 0xD8:
            length = struct.unpack(">H", _exactly(f, 2))[0]
            if length < 2:
                raise ValueError("a segment without length")
            at += length


def _webp(f: BinaryIO) -> tuple[int, int]:
    f.seek(12)
    kind, _ = struct.unpack("<4sI", _exactly(f, 8))
    body = _exactly(f, 10)
    if kind == b"VP8X":
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", body[6:])
        return width & 0x3FFF, height & 0x3FFF
    raise ValueError("no image in the first chunk")


def _boxes(f: BinaryIO, at: int, end: int | None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of ISO boxes."""
    while end is None or at + 8 <= end:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return
        size, kind = struct.unpack(">I4s", head)
        body = at + 8
        if size == 1:
            size, body = struct.unpack(">Q", _exactly(f, 8))[0], at + 16
        if size == 0 and end is None:  # to the end of the file
            yield kind, body, 1 << 62
            return
        if size < body - at:
            raise ValueError("a box without length")
        yield kind, body, at + size
        at += size


def _avif(f: BinaryIO) -> tuple[int, int]:
    """The extent of the primary item; other items are its parts, alpha or thumbnails."""
    meta = next(((a, b) for kind, a, b in _boxes(f, 0, None) if kind == b"meta"), None)
    if meta is None:
        raise ValueError("no meta box")
    primary, extents, owners = None, {}, {}

    def number(n: int) -> int:
        return int.from_bytes(_exactly(f, n), "big")

    for kind, a, b in _boxes(f, meta[0] + 4, meta[1]):
        if kind == b"pitm":
            f.seek(a)
            primary = number(2 if number(4) >> 24 == 0 else 4)
        if kind != b"iprp":
            continue
        for inner, c, d in _boxes(f, a, b):
            if inner == b"ipco":
                for place, (prop, e, _) in enumerate(_boxes(f, c, d), 1):
                    if prop == b"ispe":
                        f.seek(e + 4)
                        extents[place] = (number(4), number(4))
            elif inner == b"ipma":
                f.seek(c)
                head = number(4)
                for _ in range(number(4)):
                    item = number(2 if head >> 24 == 0 else 4)
                    wide = 2 if head & 1 else 1
                    owners.setdefault(item, []).extend(number(wide) & (0x7FFF if head & 1 else 0x7F) for _ in range(number(1)))
    for place in owners.get(primary, ()):
        if place in extents:
            return extents[place]
    raise ValueError("the primary item has no extent")


def image_size(f: BinaryIO) -> tuple[int, int]:
    """(width, height) of a seekable file; ValueError if it is no image that can be read."""
    head = f.read(32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        size = struct.unpack(">II", head[16:24])
    elif head[:2] == b"BM" and len(head) >= 26:
        size = struct.unpack("<HH", head[18:22]) if head[14:18] == b"\x0c\0\0\0" else struct.unpack("<ii", head[18:26])
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        size = struct.unpack("<HH", head[6:10])
    elif head[:3] == b"\xff\xd8\xff":
        size = _jpeg(f)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        size = _webp(f)
    elif head[4:8] == b"ftyp":
        size = _avif(f)
    else:
        raise ValueError("no known image")
    width, height = size[0], abs(size[1])  # a BMP may stand on its head
    if width <= 0 or height <= 0:
        raise ValueError("an image without extent")
    return width, height


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "width", "height", "error", "read_bytes"])


def _sizes(opened: Callable):
    """Batches of (path, content or length) to rows of SCHEMA; a file that can't be read is a row, not the end of the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count = 0
                try:
                    with Counted(opened(path, value)) as f:
                        try:
                            out.append((path, *image_size(f), None, f.count))
                        finally:
                            count = f.count
                except Exception as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}", count))
            yield _rows(out)

    return run


def page_sizes(files: DataFrame) -> DataFrame:
    """path, width, height, error and read_bytes of every row (path, content); a content that is null or no image has an error and no size."""
    return files.select("path", "content").mapInArrow(_sizes(lambda _, content: io.BytesIO(content or b"")), SCHEMA)


def scan_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The same for all files below a path: tasks open them and read headers, seeking over the rest."""
    return list_files(spark, path).mapInArrow(_sizes(lambda name, _: io.BufferedReader(Counted(open_path(name)), 4096)), SCHEMA)


def scan_packed_sizes(spark: SparkSession, path: str, size: int = 10_000) -> DataFrame:
    """The same for all entries of the zip archives below a path: of an archive the directory is read, of an entry the head.

    path is that of the archive with the entry's name behind it; an archive that can't be read is one row.
    """

    def entries(name: str) -> Iterator[tuple]:
        try:
            with Counted(open_path(name)) as raw, zipfile.ZipFile(io.BufferedReader(raw, 4096)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    before = raw.count
                    try:
                        with z.open(info) as f:
                            found = (*image_size(f), None)
                    except Exception as e:
                        found = None, None, f"{type(e).__name__}: {e}"
                    yield f"{name}/{info.filename}", *found, raw.count - before
        except Exception as e:
            yield name, None, None, f"{type(e).__name__}: {e}", 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (r for name in b.column(0).to_pylist() for r in entries(name))
            while out := list(islice(rows, size)):
                yield _rows(out)

    return list_files(spark, path).mapInArrow(run, SCHEMA)


def sizes_and_errors(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, width, height) of readable images, and one row for each other path."""
    return found.filter("error is null").select("path", "width", "height"), found.filter("error is not null").select("path").distinct()


def header_sizes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sizes_and_errors(page_sizes(files))


def scan_page_sizes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return sizes_and_errors(scan_sizes(spark, path).select("path", "width", "height", F.col("error")))
