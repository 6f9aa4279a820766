"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextry.session import checkpointed


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node; loops are dropped."""
    return (
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every node to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return _directed(moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return _directed(
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of ``edges`` (u, v) that is not the smallest of its component, that smallest one.

    Every round writes its edges to the shared folder; rounds end when the edges stay the same, after about the
    logarithm of the longest path. Nodes without edges, and the roots themselves, have no row.
    """
    current = checkpointed(_directed(edges))
    mark = None
    while True:
        current = checkpointed(_small_star(_large_star(current)))
        # Order-free sums of the edges: equal marks mean equal stars.
        seen = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)
        ).first()
        if seen == mark or seen[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
