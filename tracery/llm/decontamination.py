"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark items are the patterns. A table gives, for the block of two words that ends a
window of the text, how far the search may skip; where it may not, buckets by the hashes of the last and the first
block select patterns, and a comparison of the bytes of every word confirms them.

Defined results: a null or empty text has no words; a null item text has no windows; windows of an item whose
id is null count as hits but not as an item; rows that repeat (of either table) each get their own result and an
item id counts once; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.llm.grid import PLAIN, U64, Grid, column, mix, runs, same_bytes
from tracery.llm.tables import bound_batches, id_and_text, id_field, written

#: Text of the items that one set of pattern tables holds; a larger benchmark is searched in several sets.
SET_BYTES = 8 << 20
#: The ends of windows are searched in stretches of so many words, all at the same time.
_STRETCH = 128
#: Occurrences whose bytes are compared at the same time.
_COMPARED = 1 << 15


def block_hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each word of ``at``."""
    if size == 1:
        return hashes[at]
    return mix(hashes[at - 1] * U64(0x9E3779B97F4A7C15) + hashes[at])


class Patterns:
    """Patterns of the same number of words, with their skip table and buckets."""

    def __init__(self, grid: Grid, first: np.ndarray, m: int, numbers: np.ndarray, owners: np.ndarray):
        """The m words from each of ``first``; numbers: of each word of the grid, equal for equal bytes; owners: items."""
        self.m = m
        self.block = min(2, self.m)
        at = first[:, None] + np.arange(m)
        order = np.lexsort([owners, *numbers[at].T[::-1]])
        at, owners = at[order], owners[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (numbers[at[1:]] != numbers[at[:-1]]).any(axis=1)
        group = np.cumsum(fresh) - 1
        at = at[fresh]
        words = grid.hashes[at]
        flat, columns = words.reshape(-1), np.arange(len(words))[:, None] * self.m
        last = block_hash(flat, columns[:, 0] + self.m - 1, self.block)
        front = block_hash(flat, columns[:, 0] + self.block - 1, self.block)
        key = mix(last * U64(3) + front)
        by_key = np.argsort(key, kind="stable")
        place = np.empty(len(by_key), dtype=np.int64)
        place[by_key] = np.arange(len(by_key))
        self.words, self.key = words[by_key], key[by_key]
        self.data, self.starts, self.lengths = grid.data, grid.starts[at[by_key]], (grid.ends - grid.starts)[at[by_key]]
        pairs = np.unique(np.stack([place[group], owners], axis=1), axis=0)
        self.owners = pairs[:, 1]
        self.owners_from = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        most = self.m - self.block + 1
        bits = int(np.ceil(np.log2(max(16 * len(words) * most, 1 << 12))))
        self.down = U64(64 - bits)
        self.skip = np.full(1 << bits, most, dtype=np.uint8)
        for end in range(self.block - 1, self.m):
            slots = block_hash(flat, columns[:, 0] + end, self.block) >> self.down
            np.minimum.at(self.skip, slots, self.m - 1 - end)

    def search(self, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence."""
        low, high = grid.first[:-1] + self.m - 1, grid.first[1:]
        pieces = np.maximum(0, -(-(high - low) // _STRETCH))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(low, pieces) + nth * _STRETCH
        end = np.minimum(at + _STRETCH, np.repeat(high, pieces))
        hashes, found = grid.hashes, []
        while at.size:
            skip = self.skip[block_hash(hashes, at, self.block) >> self.down]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        ends = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        starts = ends - self.m + 1
        key = mix(block_hash(hashes, ends, self.block) * U64(3) + block_hash(hashes, starts + self.block - 1, self.block))
        first, after = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        out_at, out_pattern = [], []
        while (some := np.flatnonzero(first < after)).size:
            starts, first, after = starts[some], first[some], after[some]
            alike = np.ones(len(starts), dtype=bool)
            for j in range(self.m):
                alike &= hashes[starts + j] == self.words[first, j]
            for a in range(0, len(here := np.flatnonzero(alike)), _COMPARED):
                here_at, here_pattern = starts[here[a : a + _COMPARED]], first[here[a : a + _COMPARED]]
                equal = self._equal(grid, here_at, here_pattern)
                out_at.append(here_at[equal])
                out_pattern.append(here_pattern[equal])
            first = first + 1
        if not out_at:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(out_at), np.concatenate(out_pattern)

    def _equal(self, grid: Grid, at: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether the words from each place are the pattern's, byte by byte."""
        place = (at[:, None] + np.arange(self.m)).reshape(-1)
        starts, length = self.starts[pattern].reshape(-1), self.lengths[pattern].reshape(-1)
        same = (grid.ends - grid.starts)[place] == length
        same[same] = same_bytes(grid.data, grid.starts[place[same]], self.data, starts[same], length[same])
        return same.reshape(-1, self.m).all(axis=1)


class PatternSet:
    """The windows of some items, as pattern tables by window length. names: each item's id as text, or None.

    With ``whole_windows`` items of fewer words than a window have no pattern.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, whole_windows: bool = False):
        grid = Grid(pa.array([text or "" for _, text in items], type=pa.string()), PLAIN, lower=True)
        self.names = sorted({name for name, _ in items if name is not None})
        rank = {name: i for i, name in enumerate(self.names)}
        owner = np.array([rank.get(name, -1) for name, _ in items], dtype=np.int64)
        self.tables = []
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(grid.data[a:b].tobytes(), len(known)) for a, b in zip(grid.starts, grid.ends, strict=True)], dtype=np.int64)
        for m in range(window if whole_windows else 1, window + 1):
            at = grid.first[:-1][grid.n_words == m] if m < window else grid.windows(m)[0]
            if len(at):
                self.tables.append(Patterns(grid, at, m, numbers, owner[grid.text_of[at]]))

    def scan(self, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and the (text, item) pairs that occur, in order; items by rank of their name."""
        edges = np.zeros(len(grid.starts) + 1, dtype=np.int64)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for table in self.tables:
            at, pattern = table.search(grid)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + table.m, -1)
            n = table.owners_from[pattern + 1] - table.owners_from[pattern]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = table.owners[np.repeat(table.owners_from[pattern], n) + nth]
            pairs.append(np.stack([grid.text_of[np.repeat(at, n)], owner], axis=1)[owner >= 0])
        return np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def pattern_sets(benchmark: DataFrame, window: int, set_bytes: int, whole_windows: bool = False) -> Iterator[PatternSet]:
    """Pattern tables of at most about ``set_bytes`` of item text each, read one by one."""
    items: list[tuple[str | None, str | None]] = []
    held = 0
    for name, text in benchmark.toLocalIterator():
        items.append((name, text))
        held += len(text or "")
        if held >= set_bytes:
            yield PatternSet(items, window, whole_windows)
            items, held = [], 0
    yield PatternSet(items, window, whole_windows)


def find_benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, set_bytes: int = SET_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (ids, sorted as text), contaminated.

    Documents are scanned where they lie, without a shuffle. Each scan carries the pattern tables of at most
    ``set_bytes`` of item text (a checked bound of what is broadcast); beyond it the documents are scanned once for
    each set, one after the other, and only what was hit is shuffled to be put together.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("string"), benchmark[item_text_col].cast("string"))
    kind = id_field(docs, id_col)
    sets = pattern_sets(items, window, set_bytes)
    one, another = next(sets), next(sets, None)
    source = id_and_text(docs, id_col, text_col)
    if another is None:
        found = source.mapInArrow(_scanner(spark.sparkContext.broadcast(one), False), T.StructType([kind, *_FOUND]))
    else:
        # A row's own key: equal ids may be of different rows. The text itself is not carried along.
        source = source.withColumn("row", F.struct(F.col("doc_id"), F.xxhash64("text"), F.length("text")))
        keyed = T.StructType([kind, *_FOUND, T.StructField("row", source.schema["row"].dataType), T.StructField("hit", T.ArrayType(T.LongType()))])
        parts = []
        for s in chain((one, another), sets):  # one set at a time is with the executors
            patterns = spark.sparkContext.broadcast(s)
            parts.append(written(source.mapInArrow(_scanner(patterns, True), keyed), "passages"))
            patterns.unpersist()
        n_sets, parts = len(parts), reduce(DataFrame.unionAll, parts)
        copies = F.count("*") / n_sets
        found = (
            parts.groupBy("row").agg(
                F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), copies.cast("int").alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_words", "n_hit", "items")
        )
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") >= min_items).alias("contaminated"))


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]


def _scanner(patterns, positions: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns.value
        names = np.array([*table.names, None], dtype=object)[:-1]
        for run in runs(batches):
            grid = Grid(column(run, "text"), PLAIN, lower=True)
            hit, pairs = table.scan(grid)
            total = np.concatenate([[0], np.cumsum(hit)])
            item_offsets = np.searchsorted(pairs[:, 0], np.arange(len(grid) + 1)).astype(np.int32)
            out = {
                "doc_id": column(run, "doc_id"), "n_words": pa.array(grid.n_words, pa.int64()),
                "n_hit": pa.array(total[grid.first[1:]] - total[grid.first[:-1]], pa.int64()),
                "items": pa.ListArray.from_arrays(pa.array(item_offsets), pa.array(names[pairs[:, 1]], pa.string())),
            }
            if positions:
                at = np.flatnonzero(hit)
                where = np.searchsorted(at, grid.first).astype(np.int32)
                out["row"] = column(run, "row")
                out["hit"] = pa.ListArray.from_arrays(pa.array(where), pa.array(at - grid.first[grid.text_of[at]], pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return scan


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1, set_bytes: int = SET_BYTES,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents, whole rows, in which whole windows of fewer than ``min_items`` items occur; nothing is shuffled.

    One passage of one item is a leak. An item of fewer words than a window is no evidence: its few words may stand
    in any clean document.
    """
    items = benchmark.select(benchmark[item_col].cast("string"), benchmark[item_text_col].cast("string"))
    bound_batches(docs.sparkSession)
    found = docs.withColumn(_SEEN, F.array().cast("array<string>"))
    few = lambda df: df.filter(F.size(F.array_distinct(_SEEN)) < min_items)
    sets = pattern_sets(items, window, set_bytes, whole_windows=True)
    one = next(sets)
    while one is not None:
        patterns = docs.sparkSession.sparkContext.broadcast(one)

        def mark(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            table = patterns.value
            for run in runs(batches, text_col):
                grid = Grid(column(run, text_col), PLAIN, lower=True)
                seen = column(run, _SEEN).to_pylist()
                for text, item in table.scan(grid)[1].tolist():
                    seen[text] = [*seen[text], table.names[item]]
                yield run.set_column(run.schema.get_field_index(_SEEN), _SEEN, pa.array(seen, pa.list_(pa.string())))

        found, one = few(found.mapInArrow(mark, found.schema)), next(sets, None)
        if one is not None:  # one set at a time is with the executors
            found = written(found, "clean-so-far")
            patterns.unpersist()
    return found.drop(_SEEN)


_SEEN = "_benchmark_items_seen"


def digest(items: list[str]) -> str:
    """What the digest column of the query is, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    found = find_benchmark_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
p as (
  select distinct item_id, least(len(w), 8) m, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') g
    from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) i from b where len(w) > 0)),
lengths as (select distinct m from p),
o as (
  select doc_id, item_id, i, m
    from (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g
            from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, lengths where len(w) >= m)) join p using (m, g)),
h as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + m)) k from o) group by 1),
i as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from o group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
  from d left join h using (doc_id) left join i using (doc_id)
"""
