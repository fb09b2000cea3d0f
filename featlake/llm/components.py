"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one lower neighbour at most, and none that has one is a lower neighbour itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for every id in ``links`` (u, v); each node has one edge to its component's least id at the end.

    A hub's edges meet in no single task: least neighbours are combined before
    the shuffle and written, and the join back to the edges can be split by
    adaptive execution. The search ends when the edges are stars. Ids without
    links do not occur; an empty table gives none.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # Large star: neighbours above a node move to the least of the node and its neighbours.
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Small star: a node and its lower neighbours move to the least of them.
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        for t in (edges, least, large, least2):
            forget(t)
        edges = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
