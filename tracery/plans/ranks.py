"""Global numbers without a single task: numbers within partitions plus the sizes of the partitions before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracery.sources.workspace import stored

_IN_PARTITION = (1 << 33) - 1


def numbered_in_place(df: DataFrame, name: str = "n", start: int = 1) -> DataFrame:
    """Rows numbered in the order of the partitions and of the rows in them.

    The rows are written once with their partition and place, as a plan that runs twice could be dealt differently.
    """
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(_IN_PARTITION))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row a partition: as many as the shuffle had, whatever the rows.
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + start).drop("_at", "_part", "_nth", "_before")


def numbered_in_files(lines: DataFrame, name: str = "n", start: int = 1) -> DataFrame:
    """Rows of a text source numbered in the order of the files' names and of the rows in them, however Spark packs them.

    Rows of a block of a file are read in order by one task; blocks are numbered across from their sizes, one row each.
    """
    columns = lines.columns
    at = lines.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    placed = stored(at, "ranks")
    sizes = placed.groupBy("_file", "_block").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = sizes.select("_file", "_block", "_first", (F.sum("_size").over(Window.orderBy("_file", "_block")) - F.col("_size")).alias("_before"))
    return placed.join(before, ["_file", "_block"]).select(*columns, (F.col("_before") + F.col("_at") - F.col("_first") + start).alias(name))


def globally_ranked(df: DataFrame, *order: str, name: str = "rank", start: int = 0) -> DataFrame:
    """Rows numbered by the order columns: dealt by ranges, sorted within them, numbered across them."""
    return numbered_in_place(df.repartitionByRange(*order).sortWithinPartitions(*order), name, start)
