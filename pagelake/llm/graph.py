"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reachable, for every node of links (a, b) that isn't a root itself.

    Each round hangs the larger neighbours of a node on its smallest one, then
    the smaller ones; the number of rounds grows with the logarithm of the
    longest path. Minima are aggregated before rows move, joins on crowded
    nodes can be split, and every round is written, so a lost executor costs
    one round at most. Rounds end when the links stay the same, judged by their
    number and two sums of 64-bit hashes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        before, edges = edges, materialise(small.filter("a > b").distinct())
        discard(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.scratch_table = edges.scratch_table
            return out
        state = tuple(now)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
