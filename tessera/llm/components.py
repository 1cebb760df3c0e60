"""Connected components of a graph of links, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that is not
    itself the smallest of its component.

    Alternating large-star and small-star steps; each is a minimum by node,
    combined before the shuffle, and a join that adaptive execution can split
    at a node with very many links.  Every step is a written table."""
    low, high = F.least(a, b), F.greatest(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Large star: neighbours above a node move to its smallest.
        large = written(edges.join(least, edges.v == F.col("k")).select("u", F.col("m").alias("v")).distinct())
        # Small star: neighbours below a node move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.withColumnRenamed("u", "k"), large.u == F.col("k"))
        small = written(moved.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        if not small.exceptAll(edges).limit(1).count() and not edges.exceptAll(small).limit(1).count():
            # Stable: every node hangs on the smallest of its component.
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = small
