"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fronda.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of every node u to the least of its neighbours and itself; large: from all neighbours, but only larger ones move."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the least node reachable.

    Stars need O(log^2 n) rounds; each is written to the shared folder.  Only a
    count and a checksum reach the driver.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{name}0")
    before, k = None, 0
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, k = state, k + 1
        large = _star(now, True).filter("a != b").distinct()
        nxt = scratch.save(_star(large, False).distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now = nxt
    # at the end every edge joins a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
