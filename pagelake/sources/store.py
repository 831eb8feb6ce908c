"""A store of pages: contents by their hash, and a table of pages in versions.

A save writes new files first and then one small manifest, which names the
folders that make up the new version; a save that breaks off leaves the last
version as it was, and readers of older versions go on reading their files.
Pages lie in buckets by a hash of their path; a bucket is written anew only if
a page of it is new, changed, touched or gone. Contents are only ever added,
each once.

    root/versions/00000002.json   {"buckets": {"7": "rows/save-x/bucket=7", ...}, "blobs": ["blobs/save-x", ...]}
    root/rows/save-x/bucket=7/    path, size, mtime, hash
    root/blobs/save-x/            hash, size, data
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import save_pages

ROWS = "path string, size long, mtime long, hash string"
BLOBS = "hash string, size long, data binary"


class Conflict(Exception):
    """Another save has been committed since this one began."""


@dataclass(frozen=True)
class Save:
    """Files written for a save that isn't committed yet."""

    base: int
    of: int
    buckets: dict[str, str]
    blobs: list[str]


class PageStore:
    """Pages under a root folder of any file system that Spark writes to. The number of buckets is fixed by the first save."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """Names in a folder: saves, versions or buckets, never single pages."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict | None:
        """A version's manifest; None if it was cut off while it was written, which makes it no version."""
        text = self.spark.read.text(f"{self.root}/versions/{number:08d}.json", wholetext=True).first()
        try:
            return json.loads(text[0]) if text else None
        except ValueError:
            return None

    def versions(self) -> list[int]:
        return [n for n in self._numbers() if self._manifest(n) is not None]

    def _version(self, number: int | None) -> tuple[int, dict]:
        """The version asked for, else the last; 0 is the empty store."""
        empty = {"buckets": {}, "blobs": [], "of": self._buckets}
        if number:
            found = self._manifest(number)
            if found is None:
                raise ValueError(f"no version {number}")
            return number, found
        for n in reversed(self._numbers() if number is None else []):
            if (found := self._manifest(n)) is not None:
                return n, found
        return 0, empty

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def pages(self, version: int | None = None) -> DataFrame:
        """path, size, mtime and hash of a version's pages, by default the last one's."""
        return self._read(sorted(self._version(version)[1]["buckets"].values()), ROWS)

    def blobs(self, version: int | None = None) -> DataFrame:
        """hash, size and data of all contents that a version can name."""
        return self._read(self._version(version)[1]["blobs"], BLOBS)

    def contents(self, version: int | None = None) -> DataFrame:
        """The pages of a version with their data."""
        return self.pages(version).join(self.blobs(version).select("hash", "data"), "hash", "left")

    def prepare(self, files: DataFrame) -> Save:
        """Write what a save of files (path, size, mtime, content: all pages there are) adds to the last version.

        A page whose path, size and mtime are as stored isn't read. Rows of an
        equal path count as one page, the one of latest mtime. A null path is
        left out; a null content is a page that has vanished.
        """
        base, old = self._version(None)
        of, name = old["of"], f"save-{uuid.uuid4().hex}"
        last = F.max_by(F.struct("size", "mtime", "content"), F.struct("mtime", F.xxhash64("content"))).alias("f")
        files = files.filter("path is not null").groupBy("path").agg(last).select("path", "f.*")
        bucket = F.pmod(F.xxhash64("path"), F.lit(of)).cast("int")
        plan = save_pages(files, self.pages(base)).withColumn("bucket", bucket)
        plan.write.parquet(f"{self.root}/plans/{name}")  # rows without contents; the contents are hashed once
        plan = self.spark.read.schema(plan.schema).parquet(f"{self.root}/plans/{name}")
        moved = plan.filter("state <> 'same'").select("bucket").distinct()  # as many rows as there are buckets at most
        touched = {str(r["bucket"]) for r in moved.collect()}
        kept = plan.filter("state <> 'vanished'").join(F.broadcast(moved), "bucket").select("path", "size", "mtime", "hash", "bucket")
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/rows/{name}")
        written = {n[7:]: f"rows/{name}/{n}" for n in self._names(f"rows/{name}") if n.startswith("bucket=")}
        fresh = plan.filter("state in ('new', 'changed')").join(self.blobs(base).select("hash"), "hash", "left_anti")
        one = fresh.groupBy("hash").agg(F.min("path").alias("path"))
        data = files.join(one, "path").select("hash", F.octet_length("content").cast("long").alias("size"), F.col("content").cast("binary").alias("data"))
        data.write.parquet(f"{self.root}/blobs/{name}")
        buckets = {b: f for b, f in old["buckets"].items() if b not in touched} | written
        self._files.delete(self._path(f"plans/{name}"), True)
        return Save(base, of, buckets, [*old["blobs"], f"blobs/{name}"])

    def commit(self, save: Save) -> int:
        """Make a prepared save the next version. Only one of two saves from the same version can be committed."""
        numbers = self._numbers()
        if self._version(None)[0] != save.base:
            raise Conflict(f"version {save.base} is no longer the last")
        number = (numbers[-1] if numbers else 0) + 1
        text = json.dumps({"version": number, "of": save.of, "buckets": save.buckets, "blobs": save.blobs})
        try:
            out = self._files.create(self._path(f"versions/{number:08d}.json"), False)  # fails if the file is there
        except Exception as e:
            if self._files.exists(self._path(f"versions/{number:08d}.json")):
                raise Conflict(f"version {number} has just been committed") from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return number

    def save(self, files: DataFrame) -> int:
        """Prepare and commit; the number of the new version."""
        return self.commit(self.prepare(files))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last `keep` versions names, and the manifests of older ones. No save may be under way."""
        versions = self.versions()
        manifests = [self._manifest(n) for n in versions[-keep:]]
        named = {f for m in manifests for f in [*m["buckets"].values(), *m["blobs"]]}
        gone = [f"versions/{n:08d}.json" for n in self._numbers() if n not in versions[-keep:] and n < max(versions, default=0)]
        for save in self._names("rows"):
            own = [f"rows/{save}/{b}" for b in self._names(f"rows/{save}") if b.startswith("bucket=")]
            unused = [f for f in own if f not in named]
            gone += [f"rows/{save}"] if len(unused) == len(own) else unused
        gone += [f"blobs/{s}" for s in self._names("blobs") if f"blobs/{s}" not in named]
        gone += [f"plans/{s}" for s in self._names("plans")]
        for f in gone:
            self._files.delete(self._path(f), True)
        return gone
