"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._shared import cut


def settled(e: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: every u has one v, and no v is a u."""
    if e.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not its component's smallest node, whose root that is.

    Each step replaces edges by ones nearer the smallest node, by a minimum per node and a join, never by a node's list
    of neighbours; the number of rounds grows with the logarithm of the components' size. Rows are cut from their
    lineage after each round, and minima before they are joined, so that the join can split a node of many neighbours.
    No edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = cut(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
