"""Breadth-first crawl over stored pages: a frontier of new addresses per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.session import cut


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` of all nodes reached from ``seeds(node)`` over ``edges(src, dst)``, with the least depth.

    Each round is an equi-join and an anti-join; lineage is cut after it.  Ends when nothing is
    new or at ``max_depth``.
    """
    visited = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            break
        visited = cut(visited.unionByName(frontier))
    return visited
