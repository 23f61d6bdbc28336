"""Figures about collections and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracery.operators import search


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct texts, characters, bytes, longest text."""
    text = F.coalesce("text", F.lit(""))
    return docs.agg(
        F.count("*").alias("n_docs"), F.count_distinct(text).alias("n_texts"), F.sum(F.length(text)).cast("long").alias("n_chars"),
        F.sum(F.octet_length(text)).cast("long").alias("n_bytes"), F.max(F.length(text)).cast("long").alias("longest"),
    )


def char_histogram(docs: DataFrame) -> DataFrame:
    """(code, n, before): how often each character occurs, and how many characters stand before it in suffix order.

    The range of suffixes that begin with a character is [before, before + n). Characters are counted within each task
    before they are shuffled; there are at most as many rows as code points.
    """
    one = docs.select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    coded = one.select(F.ascii("ch").cast("long").alias("code"), "n")
    return coded.select("code", "n", (F.sum("n").over(Window.orderBy("code")) - F.col("n")).cast("long").alias("before"))


def benchmark_totals(docs: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """One row: patterns, patterns found, documents listed in total, occurrences in total."""
    found = search.frequencies(docs, patterns, **options)
    totals = found.agg(F.count_distinct("pattern_id").alias("n_found"), F.count("*").alias("n_listed"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("n_occurrences"))
    return patterns.agg(F.count("*").alias("n_patterns")).join(F.broadcast(totals))


def report(name: str, seconds: float, n_patterns: int, n_listed: int, n_bytes: int, n_chars: int) -> str:
    """A line for people: documents and patterns a second, size in MB and in bits a character, time a pattern."""
    rate = lambda n: n / seconds if seconds else 0.0
    return (
        f"{name}: {rate(n_listed):.0f} documents/s, {rate(n_patterns):.0f} patterns/s, {n_bytes / 1e6:.2f} MB, "
        f"{8 * n_bytes / max(n_chars, 1):.2f} bits a character, {1e9 * seconds / max(n_patterns, 1):.0f} ns a pattern"
    )


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a frame."""
    spark = df.sparkSession
    size = 0
    for f in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size
