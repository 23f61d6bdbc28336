"""Sets of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.plans.ranks import globally_ranked


def union(*listings: DataFrame) -> DataFrame:
    """The documents of any of the listings, each once."""
    return reduce(DataFrame.unionAll, (x.select("doc_id") for x in listings)).distinct()


def intersection(*listings: DataFrame) -> DataFrame:
    """The documents of all listings: counted in one shuffle rather than joined one after the other."""
    marked = reduce(DataFrame.unionAll, (x.select("doc_id", F.lit(i).alias("of")) for i, x in enumerate(listings)))
    return marked.groupBy("doc_id").agg(F.count_distinct("of").alias("n")).filter(F.col("n") == len(listings)).select("doc_id")


def expanded_runs(runs: DataFrame) -> DataFrame:
    """Runs (first, size) of consecutive document ids as rows."""
    return runs.filter("size > 0").select(F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("doc_id"))


def runs_of(listing: DataFrame) -> DataFrame:
    """The documents of a listing as runs (first, size) of consecutive identifiers.

    A run begins at a document without the one before it; the runs are numbered globally, so no task sees them all.
    """
    docs = listing.select("doc_id").distinct()
    mark = lambda by, name: docs.join(docs.select((F.col("doc_id") + by).alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias(name))
    first, last = globally_ranked(mark(1, "first"), "first"), globally_ranked(mark(-1, "last"), "last")
    return first.join(last, "rank").select("first", (F.col("last") - F.col("first") + 1).alias("size"))
