"""Exact pattern search: where and how often patterns occur in documents.

A set of patterns becomes an automaton that finds all occurrences, overlapping ones too, in one pass over each text.
The texts are scanned where they lie; only (pattern, document) rows leave the scan, already counted. Patterns are sent
to the executors in slices of bounded size, one scan a slice; if there are several, each is scanned for, written and
let go before the next is sent. A handful of patterns needs no automaton: each is a
literal ``contains`` in one generated filter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions.text import occurrences as occurrences_of
from tracery.sources.workspace import stored

#: Characters of the patterns that one scan carries.
SLICE_CHARS = 2 << 20
#: Up to so many patterns are searched as literals by the generated code of one scan.
LITERALS = 16


def slices(patterns: DataFrame, slice_chars: int) -> Iterator[dict[str, list[int]]]:
    """Patterns by their text, in slices; read one by one."""
    held: dict[str, list[int]] = defaultdict(list)
    size = 0
    for number, pattern in patterns.select("pattern_id", "pattern").coalesce(1).toLocalIterator():  # one job
        if pattern:
            held[pattern].append(number)
            size += len(pattern)
        if size >= slice_chars:
            yield dict(held)
            held, size = defaultdict(list), 0
    if held:
        yield dict(held)


def _automaton(words: dict[str, list[int]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w, numbers in words.items():
        machine.add_word(w, (len(w), tuple(numbers)))
    machine.make_automaton()
    return machine


_last: list = [None, None]


def _machine(words: dict[str, list[int]]):
    """The automaton of a slice, kept in the worker for its next task."""
    if _last[0] is not words:
        _last[:] = words, _automaton(words)
    return _last[1]


def each_slice(spark: SparkSession, parts: Iterator[dict[str, list[int]]], schema: str, scan: Callable[[Broadcast], DataFrame], streaming: bool = False) -> DataFrame:
    """What ``scan`` finds with each slice of patterns, put together; no two slices are with the executors at once."""
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None or streaming:
        found = [scan(spark.sparkContext.broadcast(p)) for p in (first, second, *parts) if p]
        return reduce(DataFrame.unionAll, found)
    found = []
    for part in chain((first, second), parts):
        words = spark.sparkContext.broadcast(part)
        found.append(stored(scan(words), "slice"))
        words.unpersist()
    return reduce(DataFrame.unionAll, found)


def _scan(docs: DataFrame, parts: Iterator[dict[str, list[int]]], schema: str, each) -> DataFrame:
    def with_words(words: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(words.value)
            for batch in batches:
                yield from each(machine, batch)

        return docs.select("doc_id", "text").mapInArrow(scan, schema)

    return each_slice(docs.sparkSession, parts, schema, with_words, docs.isStreaming)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    yield from zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()), strict=True)


def _counted(machine, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []
    for doc, text in _texts(batch):
        seen = Counter(numbers for _, (_, numbers) in machine.iter(text))
        rows += [(number, doc, n) for numbers, n in seen.items() for number in numbers]
    if rows:
        p, d, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"pattern_id": pa.array(p, pa.int64()), "doc_id": pa.array(d, pa.int64()), "tf": pa.array(n, pa.int64())})


def _located(machine, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []
    for doc, text in _texts(batch):
        for end, (length, numbers) in machine.iter(text):
            rows += [(number, doc, end - length + 1) for number in numbers]
        if len(rows) > 100_000:
            yield _positions(rows)
            rows = []
    if rows:
        yield _positions(rows)


def _positions(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    p, d, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"pattern_id": pa.array(p, pa.int64()), "doc_id": pa.array(d, pa.int64()), "pos": pa.array(n, pa.int64())})


def frequencies(docs: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS, strategy: str = "auto") -> DataFrame:
    """(pattern_id, doc_id, tf): how often each pattern occurs in each document that holds it.

    strategy: "literals" (generated code, few patterns), "automaton", or "auto".
    """
    parts = slices(patterns, slice_chars)
    head = list(islice(parts, 2))
    few = len(head) < 2 and sum(len(numbers) for part in head for numbers in part.values()) <= LITERALS
    if strategy == "literals" or (strategy == "auto" and few):
        return _by_literals(docs, [(n, word) for part in chain(head, parts) for word, numbers in part.items() for n in numbers])
    return _scan(docs, chain(head, parts), "pattern_id long, doc_id long, tf long", _counted)


def _by_literals(docs: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    if not patterns:
        return docs.sparkSession.createDataFrame([], "pattern_id long, doc_id long, tf long")
    hits = F.array(*(F.struct(F.lit(n).cast("long").alias("pattern_id"), occurrences_of(F.col("text"), F.lit(p)).alias("tf")) for n, p in patterns))
    any_of = F.lit(False)
    for _, p in patterns:
        any_of = any_of | F.col("text").contains(p)
    return docs.filter(any_of).select("doc_id", F.explode(hits).alias("h")).filter("h.tf > 0").select("h.pattern_id", "doc_id", "h.tf")


def locate(docs: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, doc_id, pos): every occurrence, positions in characters from 0."""
    return _scan(docs, slices(patterns, slice_chars), "pattern_id long, doc_id long, pos long", _located)


def list_docs(docs: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """(pattern_id, doc_id): the documents that hold each pattern, each once as its identifier is. A pattern without
    documents has no rows. Nothing is shuffled."""
    return frequencies(docs, patterns, **options).select("pattern_id", "doc_id")


def doc_count(docs: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """(pattern_id, n_docs), 0 for a pattern that occurs nowhere."""
    n = list_docs(docs, patterns, **options).groupBy("pattern_id").agg(F.count("*").alias("n_docs"))
    return patterns.select("pattern_id").join(n, "pattern_id", "left").select("pattern_id", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


def occurrence_count(docs: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """(pattern_id, n_occurrences), overlaps counted, 0 for a pattern that occurs nowhere."""
    n = frequencies(docs, patterns, **options).groupBy("pattern_id").agg(F.sum("tf").alias("n"))
    return patterns.select("pattern_id").join(n, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_occurrences"))


def lists_by_pattern(listed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, pattern, docs): each pattern with its documents in order; an empty list if it has none."""
    docs = listed.groupBy("pattern_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    return patterns.join(docs, "pattern_id", "left").select("pattern_id", "pattern", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"))


def extract(docs: DataFrame, *doc_ids: int) -> DataFrame:
    return docs.filter(F.col("doc_id").isin(*doc_ids))
