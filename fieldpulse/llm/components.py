"""Connected components of a table of links by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones with itself) are tied to its smallest neighbour."""
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        tied = both.where("v > u")
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        tied = both.union(both.select("u", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return tied.join(low, "u").where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component.

    A node with very many links only meets minima and joins, never a list of its neighbours. Each step is a written table.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
