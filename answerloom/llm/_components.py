"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm._common import checksum
from answerloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it.

    The minima are written before they are joined: a join of two plain shuffles can split the
    edges of a node that has very many.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("least")))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    tied = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return tied.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node that can be reached, for every node with an edge.

    ``edges`` has two integer columns, in any order and with repeats. The rounds only join and
    take minima, each ends in a written table, and their number grows with the logarithm of the
    number of nodes. Nodes without an edge, and edges with a null end, are left out.
    """
    a, b = edges.columns
    now = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = checksum(now)
    while seen[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        found = checksum(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
