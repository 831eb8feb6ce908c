"""Longest-processing-time sharding (operator 4).

Equal texts form a group that stays together. Largest groups go first, each
to the least loaded shard, found through a heap. At scale this runs twice:
each of a number of partitions deals its groups, streamed in descending size
by Spark's own sort, into local bins through a heap; then the bins of all
partitions, again largest first, go to the shards through a second heap. The
second heap sees partitions * shards bins, never the groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty


def _deal(shards: int, out: str):
    """A stream of rows with a size, largest first: out is the least loaded of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, i) for i in range(shards)]
        for b in batches:
            to = []
            for size in b.column("group_bytes").to_pylist():
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                to.append(i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())], names=[*b.schema.names, out])

    return run


def shard_documents(docs: DataFrame, shards: int = 40, partitions: int | None = None, overhead: int = 16, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, size, text_crc32, shard and slot of every row of docs.

    size: UTF-8 bytes of the text and overhead. Sizes of the shards are near
    equal unless a group is larger than a shard's share; rows of equal text
    share a shard. slot numbers the rows of a shard from 0 without a gap, in
    no stated order. A null text counts as empty (crc 0); null ids and repeated
    rows each get a slot; an empty table gives an empty table. Other columns
    are not read. The text itself is never shuffled. partitions: by default
    one for 100,000 rows, 64 at least and 4096 at most.
    """
    text = text_or_empty()
    rows = materialise(
        docs.select(
            *keep,
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode(text, "utf-8"))).alias("__group"),
            F.monotonically_increasing_id().alias("__row"),  # fixed by the write; tells equal rows apart
        )
    )
    count = rows.count()
    partitions = partitions or min(4096, max(64, count // 100_000))
    cells_each = min(65_536, max(256, count // (shards * 100_000)))
    groups = rows.groupBy("__group").agg(F.sum("size").alias("group_bytes"))
    local = groups.repartition(partitions, "__group").withColumn("__part", F.spark_partition_id()).sortWithinPartitions(F.desc("group_bytes"), "__group")
    local = materialise(local.mapInArrow(_deal(shards, "__bin"), "__group binary, group_bytes long, __part int, __bin int"))
    bins = local.groupBy("__part", "__bin").agg(F.sum("group_bytes").alias("group_bytes"))
    bins = bins.repartition(1).sortWithinPartitions(F.desc("group_bytes"), "__part", "__bin").mapInArrow(_deal(shards, "shard"), "__part int, __bin int, group_bytes long, shard int")
    dealt = local.join(F.broadcast(bins.drop("group_bytes")), ["__part", "__bin"]).select("__group", "shard")  # partitions * shards rows
    placed = materialise(rows.join(dealt, "__group").drop("__group").withColumn("__cell", F.pmod(F.xxhash64(*keep, "text_crc32", F.col("__row")), F.lit(cells_each)).cast("int")))
    cells = placed.groupBy("shard", "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.select("shard", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__cell").orderBy(*keep, "size", "text_crc32", "__row")
    numbered = placed.withColumn("__at", F.row_number().over(inside))
    return numbered.join(F.broadcast(start), ["shard", "__cell"]).select(  # cells_each * shards rows
        *keep, "size", "text_crc32", "shard", (F.col("__start") + F.col("__at") - 1).alias("slot")
    )
