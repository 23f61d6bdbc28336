"""Removal of word sequences that an earlier document has, by difference-cover anchors.

Anchors are shorter windows that start at word numbers whose remainder modulo a period is of a difference cover. For any
two places there is a shift below the period after which both remainders are of the cover, so two equal windows always
share an aligned anchor. First, anchors (three in seven places) are asked for in all documents; where one is shared,
the match extends to the whole windows around it, and only those are asked for, each with the smallest document that
has it. Both steps ask by blocks (see ``blocks``): no pairs of documents arise, however many share a passage.

Anchors are compared by 64-bit hashes, which can only find too much. A window's word sequence is compared by 128 bits:
two independent hashes of its words' two hashes.

Defined results: a null or empty text has no words; documents with a null id neither take nor lose words; rows that
share an id don't count as earlier than each other; identifiers are integers; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.blocks import QUESTION, answer, asked, block_table, bucket_order, buckets_for, in_order, met, texts_of
from tracery.llm.encoding import as_bytes
from tracery.llm.grid import SPACED, Grid

WINDOW = 13
#: Perfect difference covers, as period and remainders.
COVERS = ((7, (0, 1, 3)), (3, (0, 1)), (1, (0,)))
_ANCHOR_BYTES, _WINDOW_BYTES = 5, 16


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors at least half as long as the window."""
    return next((p, c) for p, c in COVERS if 2 * (window - p + 1) >= window)


def anchors(grid: Grid, ids: np.ndarray, known: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of a block's anchors, each anchor's place among the distinct ones, those hashes, and 1 or 2 (of several ids)."""
    period, cover = cover_for(window)
    at, hashes = grid.windows(window - period + 1)
    text = grid.text_of[at]
    use = np.isin((at - grid.first[text]) % period, cover) & known[text]
    at, hashes, text = at[use], hashes[use], text[use]
    order = bucket_order(hashes, buckets)
    sorted_hashes, sorted_ids = hashes[order], ids[text[order]]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    group = np.cumsum(fresh) - 1
    which = np.empty(len(order), dtype=np.int64)
    which[order] = group
    several = np.zeros(int(fresh.sum()), dtype=bool)
    several[group[1:][~fresh[1:] & (sorted_ids[1:] != sorted_ids[:-1])]] = True
    return at, which, sorted_hashes[fresh], (several + 1).astype(np.uint8)


def windows_around(grid: Grid, at: np.ndarray, window: int) -> np.ndarray:
    """First words of all windows that contain one of the anchors, inside the anchors' texts."""
    period, _ = cover_for(window)
    text = grid.text_of[at]
    low = np.maximum(at - period + 1, grid.first[text])
    high = np.minimum(at, grid.first[text + 1] - window)
    ok = low <= high
    edges = np.zeros(len(grid.starts) + 1, dtype=np.int64)
    np.add.at(edges, low[ok], 1)
    np.add.at(edges, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) > 0)


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each pair among the distinct ones, and the place of the first of each."""
    order = np.lexsort([two, one])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    return which, order[fresh]


def distinct_windows(grid: Grid, at: np.ndarray, ids: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's place among the distinct ones, both hashes of those as asked for, and the block's smallest id with each."""
    one, two, own = grid.sequence_hash(at, window), grid.sequence_hash(at, window, second=True), ids[grid.text_of[at]]
    which, first = _grouped(one, two)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, own)
    order = bucket_order(one[first], buckets, least)  # by id within a bucket: ids then pack well
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[which], one[first][order], two[first][order], least[order]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _several(keys: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """1 for an anchor that documents of more than one id have (or may have)."""
    _, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, weights=np.frombuffer(b"".join(extra), dtype=np.uint8))
    return (total[which] > 1).astype(np.uint8)


def _earlier(keys: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """1 for a window that another block has in a document with a smaller id."""
    own = np.frombuffer(b"".join(extra), dtype="<i8")
    which, first = _grouped(keys[:, 0], keys[:, 1])
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, own)
    return (least[which] < own).astype(np.uint8)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (its kept words, joined by one space)."""
    blocks = block_table(docs, id_col, text_col)
    buckets = buckets_for(blocks, 3 / 7 / 6)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, _ in texts_of(batches):
            _, _, hashes, several = anchors(Grid(texts, SPACED), *_ids(ids), window, buckets)
            if (question := asked(block, hashes, buckets, _ANCHOR_BYTES, several)) is not None:
                yield question

    shared = answer(blocks.mapInArrow(ask_anchors, QUESTION), _ANCHOR_BYTES, _several, "shared")

    def candidates(ids: np.ndarray, known: np.ndarray, texts: pa.Array, answers: list[dict] | None) -> tuple[Grid, np.ndarray]:
        grid = Grid(texts, SPACED)
        at, which, hashes, _ = anchors(grid, ids, known, window, buckets)
        is_shared = in_order(answers)
        return grid, windows_around(grid, at[is_shared[which] > 0], window) if len(hashes) else at

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, column, texts, more in texts_of(batches):
            ids, known = _ids(column)
            grid, at = candidates(ids, known, texts, more["shared"])
            _, hashes, second, least = distinct_windows(grid, at, ids, window, buckets)
            if (question := asked(block, hashes, buckets, 8, least.astype("<i8"), second)) is not None:
                yield question

    earlier = answer(met(blocks, shared).mapInArrow(ask_windows, QUESTION), _WINDOW_BYTES, _earlier, "earlier")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column, texts, more in texts_of(batches):
            ids, known = _ids(column)
            grid, at = candidates(ids, known, texts, more["shared"])
            place, hashes, _, least = distinct_windows(grid, at, ids, window, buckets)
            elsewhere = in_order(more["earlier"])
            gone = (elsewhere[place] > 0) | (least[place] < ids[grid.text_of[at]]) if len(hashes) else np.zeros(0, dtype=bool)
            edges = np.zeros(len(grid.starts) + window + 1, dtype=np.int64)
            np.add.at(edges, at[gone], 1)
            np.add.at(edges, at[gone] + window, -1)
            stays = np.cumsum(edges)[: len(grid.starts)] == 0
            total = np.concatenate([[0], np.cumsum(~stays)])
            removed = total[grid.first[1:]] - total[grid.first[:-1]]
            kept = []
            for i, text in enumerate(as_bytes(texts)):
                words = text.split()
                kept.append(b" ".join(compress(words, stays[grid.first[i] : grid.first[i + 1]].tolist()) if removed[i] else words))
            yield pa.RecordBatch.from_pydict({"doc_id": column, "n_words": pa.array(grid.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    cut_blocks = met(met(blocks, shared), earlier)
    return cut_blocks.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    found = remove_repeated_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
v as (select doc_id, i, array_to_string(w[i:i + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
m as (select g, min(doc_id) least from v group by 1 having min(doc_id) < max(doc_id)),
r as (select distinct doc_id, unnest(range(i, i + 13)) k from v join m using (g) where least < doc_id),
n as (select doc_id, count(*) n_removed from r group by 1),
k as (
  select doc_id, string_agg(x, ' ' order by k) kept
    from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) k from d) anti join r using (doc_id, k) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
  from d left join n using (doc_id) left join k using (doc_id)
"""
