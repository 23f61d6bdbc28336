"""Listing over a stream of documents: an extension, as patterns are few and documents keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracery.operators import search


def list_stream(docs: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """(pattern_id, doc_id, tf) for each document of a stream; patterns are read once. No state is kept."""
    return search.frequencies(docs, patterns, strategy="automaton", **options)
