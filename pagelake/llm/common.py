"""What the operators share: durable intermediate tables and column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and what was
    computed is fixed, whatever order the rows came in. The shuffle files of
    the write go with it; the table goes with discard(), or when the session's
    JVM ends.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(target)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    path, files = _path(spark, target)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(target)
    out.scratch_table = target
    return out


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        name = getattr(df, "scratch_table", None)
        if name:
            path, files = _path(df.sparkSession, name)
            files.delete(path, True)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is written or collected meanwhile goes to Python in batches of at most so many rows, or of the session's own number if smaller.

    A batch of whole texts lies outside the JVM's heap and, several times over, in the
    Python worker; neither gives the memory back, so the largest batch counts until the end.
    """
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """What is joined meanwhile is broadcast if its files hold at most so many bytes, or up to the session's own bound by its size as shuffled.

    Spark goes by the bytes of compressed files, and by one row out for each row in of an
    explode, so a table within the bound can take the driver's memory many times over.
    """
    conf = spark._jsparkSession.sessionState().conf()
    before = {k: spark.conf.get(k, None) for k in (_GUESSED, _MEASURED)}
    guessed = conf.autoBroadcastJoinThreshold()
    if not before[_MEASURED]:
        spark.conf.set(_MEASURED, str(guessed))
    spark.conf.set(_GUESSED, str(min(most, guessed)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
