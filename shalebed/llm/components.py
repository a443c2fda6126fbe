"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _sum(edges: DataFrame):
    """A row that is the same for equal sets of edges."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v), longs; root is the least node.

    Each round is two grouped minima and two joins, with the edges checkpointed;
    the number of rounds grows with the logarithm of the longest path. A node
    with very many neighbours is summed on the map side first, and adaptive
    execution splits its part of a join. Loops are ignored.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _sum(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _sum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
