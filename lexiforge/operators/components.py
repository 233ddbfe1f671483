"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept, scratch, stored
from .joins import join_hot


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) of longs -> node, component (the smallest node), one row for each node that has an edge to another.

    Each step sends a node's neighbours to their smallest; the number of steps grows with the logarithm of the longest
    path. A node with very many neighbours is dealt out over tasks. Every step ends in a stored table, so lineage stays short and a lost executor costs one step. Null ends and
    loops are dropped; an empty table gives an empty result.
    """
    with scratch(edges.sparkSession):
        now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        while not _done(now):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
            large = join_hot(both.filter("b > a"), least.select("a", F.least("a", "least").alias("least")), "a", least.select("a", "n"))
            large = stored(large.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct(), name)
            first = large.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
            # a node with one neighbour has nothing to pass on
            several = join_hot(large, first.filter("n > 1").select("a", "least"), "a", first.select("a", "n"))
            small = several.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(first.select("a", F.col("least").alias("b")))
            now = stored(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return kept(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), name)


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a smaller node that has none of its own: all components are stars."""
    crossed = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and crossed.isEmpty()
