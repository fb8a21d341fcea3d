"""Connected components of an edge list by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    ties = e.join(least.withColumnRenamed("v", "c"), F.col("v") == F.col("c")).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return ties.union(least.select(F.col("m").alias("u"), "v")).where("u < v").distinct()


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 24)), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Each step only aggregates minima and joins, so a hub never meets in one task; every round is written to
    the shared folder. Rounds grow with the logarithm of the component size. No edges give no rows.
    """
    e = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    was = _digest(e)
    while was[0]:
        after = written(_small_star(_large_star(e)), "edges")
        drop_table(e)
        e, now = after, _digest(after)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
