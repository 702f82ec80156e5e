"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is an aggregation (combined before its shuffle) and a join with at most one row a node on one
side, so a node with a third of all edges can be split. Edges and labels stay in the cluster; only a count
and a checksum reach the driver. Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._shared import drop_written, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node with an edge, from long columns a and b."""
    larger = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(larger.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        stars = _large(now).where(F.col("a") != F.col("b")).distinct()
        new = written(_small(stars).distinct(), "edges")
        drop_written(now)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
