"""Collections, patterns and index tables: how they come in and go out.

A collection is a frame (doc_id, text), patterns a frame (pattern_id, pattern). Empty and null patterns match nothing
and are left out; null texts hold no occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a delimited collection may not hold besides its delimiter.
RESERVED = ("\u0001", "\u0002")


def collection(df: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("string").alias("text"))


def pattern_set(df: DataFrame, id_col: str = "pattern_id", pattern_col: str | Column = "pattern") -> DataFrame:
    pattern = F.col(pattern_col) if isinstance(pattern_col, str) else pattern_col
    return df.select(F.col(id_col).cast("long").alias("pattern_id"), pattern.cast("string").alias("pattern")).filter("length(pattern) > 0")


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """Lines numbered from 1 in the order of files and lines, without bringing them to one task."""
    from tracery.plans.ranks import numbered_in_files

    return numbered_in_files(lines).withColumnRenamed("value", name)


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\u0000") -> DataFrame:
    """A file whose documents each end with a delimiter, as (doc_id from 1, text). Reserved bytes are an error."""
    docs = _numbered(spark.read.option("lineSep", delimiter).text(path), "text").select(F.col("n").alias("doc_id"), "text")
    bad = F.lit(False)
    for c in RESERVED:
        bad = bad | F.col("text").contains(c)
    return docs.withColumn("text", F.when(bad, F.raise_error(F.lit("the collection holds reserved bytes"))).otherwise(F.col("text")))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A file of one pattern a row, as (pattern_id from 1, pattern)."""
    return _numbered(spark.read.text(path), "pattern").select(F.col("n").alias("pattern_id"), "pattern").filter("length(pattern) > 0")


def write_delimited(docs: DataFrame, path: str, delimiter: str = "\u0000") -> None:
    docs.orderBy("doc_id").select("text").write.option("lineSep", delimiter).text(path)


def write_lists(lists: DataFrame, path: str) -> None:
    """One row a pattern: the pattern, a tab, and its document ids in order."""
    lists.select(F.concat_ws("\t", "pattern", F.concat_ws(" ", F.transform("docs", lambda d: d.cast("string"))))).write.text(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], **options) -> DataFrame:
    """The table at the path; built and written first if there is none yet."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


def header_field(header: Column, name: str) -> Column:
    """A number of a pattern file's header, such as number=10 length=20; an error if it is missing."""
    found = F.regexp_extract(header, rf"(?:^|\s){name}=(\d+)", 1)
    return F.when(found == "", F.raise_error(F.lit(f"no {name} in the header"))).otherwise(found.cast("long"))
