"""Ranked and scored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Terms that a mask has room for.
MASK_TERMS = 63


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k documents of each pattern with most occurrences, ties by document id; k = 0 gives none.

    Spark keeps the k first of each task before the shuffle (a group limit), so a pattern that all documents hold
    moves only k rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("tf"), F.asc("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def merged_frequencies(found: DataFrame) -> DataFrame:
    """Frequencies of repeated (pattern, document) rows added up."""
    return found.groupBy("pattern_id", "doc_id").agg(F.sum("tf").alias("tf"))


def inverse_frequencies(found: DataFrame, n_docs: int | Column) -> DataFrame:
    """(term, idf) with idf = ln(documents / documents with the term); terms that occur nowhere have none."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return found.groupBy("term").agg(F.log(n / F.count_distinct("doc_id")).alias("idf"))


def scored(found: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, term, terms, score) of each term in each document: a mask with the term's bit, and tf * idf."""
    return found.join(idf, "term").select("doc_id", "term", F.expr("shiftleft(1L, cast(term as int))").alias("terms"), (F.col("tf") * F.col("idf")).alias("score"))


def merged_scores(scores: DataFrame) -> DataFrame:
    """One row a document: the terms' bits joined, their scores added. Repeated rows of a term don't spoil the mask."""
    return scores.groupBy("doc_id").agg(F.bit_or("terms").alias("terms"), F.sum("score").alias("score"))


def with_all(merged: DataFrame, mask: int) -> DataFrame:
    return merged.filter(F.col("terms").bitwiseAND(F.lit(mask)) == mask)


def best(merged: DataFrame, k: int) -> DataFrame:
    """The k best documents, by score, ties by id."""
    return merged.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
