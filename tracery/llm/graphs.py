"""Connected components by alternating large and small stars, each step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.tables import written


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to the smallest of its component, which then has no edge of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of whole numbers: one row (node, root) for each node, the root being the smallest of its component.

    Every step hangs each node's larger neighbours, then its smaller ones, below the smallest neighbour; minima are
    taken before the shuffle, so a node with very many neighbours costs a row a task; where its edges meet its minimum,
    both sides are shuffled as they were written, and Spark may split a skewed key. Ends when only stars are left.
    """
    now = written(_down(edges), "edges")
    while not _done(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = _down(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = written(_down(small), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
