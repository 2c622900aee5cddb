"""Connected components by alternating large-star and small-star steps.

Each step joins the edges with the smallest neighbour of their nodes, found by a partial aggregation. A node
with many neighbours (found by counting, before the step) has its edges dealt to several tasks by their other
end, so no node's neighbours are gathered in one place. The number of rounds grows with the logarithm of the
number of nodes; each step's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.spread import heavy_parts, spread_join
from vectrail.runtime import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame, parts: dict) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = _both(edges)
    joined = spread_join(both.where("b > a"), _least(both), "a", parts, F.col("b"))
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, parts: dict) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these. Edges lead from larger to smaller nodes."""
    least = _least(edges)
    tied = spread_join(edges, least, "a", parts, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches. Loops are ignored."""
    held = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while total := held.count():
        # Done when each node is tied to one root, and no root is tied to another.
        ends = held.select("a", F.lit(1).alias("up")).unionByName(held.select(F.col("b").alias("a"), F.lit(0).alias("up")))
        degrees = ends.groupBy("a").agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
        if degrees.where("ups > 0 and n > 1").isEmpty():
            break
        large = materialize(_large_star(held, heavy_parts(degrees, "a", total)), "edges")
        down = large.groupBy("a").agg(F.count("*").alias("n"))
        held = materialize(_small_star(large, heavy_parts(down, "a", large.count())), "edges")
    roots = held.select("b").distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
