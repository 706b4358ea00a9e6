"""Connected components of an edge table by alternating star contraction; nothing is collected but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b), a > b: neighbours of a node move to the smallest node that it knows.

    The large star moves the larger neighbours of every node, the small star a node and its smaller neighbours.  A
    node's minimum is a partial aggregate, and joining it back is a skew-splittable equi-join, so a hub of any degree
    is never gathered in one task.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    mark = None
    while True:
        now = written(_star(_star(now, True), False), "components")
        # stars keep one edge for each node but the root; sums of both ends settle when nothing moves
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if seen[0] == seen[2] and tuple(seen) == mark:
            break
        mark = tuple(seen)
    flat = now.groupBy("a").agg(F.min("b").alias("b"))
    return flat.select(F.col("a").alias("node"), F.col("b").alias("root")).union(flat.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
