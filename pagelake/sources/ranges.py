"""Files read in part: a task opens a path where it lies, and only the bytes asked for are moved."""

from __future__ import annotations

import io
import re

from pyspark.sql import DataFrame, SparkSession


def split_path(path: str) -> tuple[str, str]:
    """The root of a path's file system as a URI, and the path below it, as Spark lists them (nothing is escaped)."""
    scheme, authority, rest = re.match(r"(?:([A-Za-z][\w+.-]*):)?(?://([^/]*))?(.*)", path, re.S).groups()
    return f"{scheme or 'file'}://{authority or ''}/", "/" + rest.lstrip("/")


def open_path(path: str, write: bool = False):
    """A binary file, seekable when read: local, HDFS or an object store that Arrow has a file system for."""
    from pyarrow import fs

    root, below = split_path(path)
    if root.startswith("file:"):
        system, name = fs.LocalFileSystem(), below
    else:
        system, base = fs.FileSystem.from_uri(root)
        name = f"{base.rstrip('/')}{below}"
    if write:
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name)
    return system.open_input_file(name)


class Counted(io.RawIOBase):
    """A seekable file that counts the bytes read of it."""

    def __init__(self, file):
        self.file, self.count = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.file.read() if size is None or size < 0 else self.file.read(size)
        self.count += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


class Span(io.RawIOBase):
    """A part of a seekable file as a file; closing it leaves the file open."""

    def __init__(self, file, start: int, length: int):
        self.file, self.start, self.length, self.at = file, start, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        left = max(0, self.length - self.at)
        self.file.seek(self.start + self.at)
        data = self.file.read(left if size is None or size < 0 else min(size, left))
        self.at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, self.length)[whence]
        if at < 0:
            raise ValueError("negative seek")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files of at least one byte below a path; their content isn't read, so no file is too large."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
