"""Connected components of a table of links, so that what hangs together is folded by itself and not by chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import drop_at_end, shared_folder


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """df in the shared folder: rounds don't repeat each other's work, whatever is lost."""
    place = shared_folder(df.sparkSession, "links")
    drop_at_end(df.sparkSession, place)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def _delete(df: DataFrame, place: str) -> None:
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it hangs together with, for links (a, b) of any type that sorts.

    In each round a node takes the smallest root among its neighbours, and then
    that one's root; minima are aggregated before rows move. Rounds grow with
    the logarithm of the longest chain, mostly. Nodes that are null take no part.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null")
    edges, edge_place = _written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state, place = _written(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("low")).withColumnRenamed("a", "node")
        hooked = state.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "low").alias("root"))
        on = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new, new_place = _written(hooked.join(on, "root").select("node", F.least("root", "further").alias("root"), (F.least("root", "further") < F.col("before")).alias("moved")))
        _delete(state, place)
        state, place = new.select("node", "root"), new_place
        if not new.filter("moved").limit(1).count():
            _delete(edges, edge_place)
            return state
