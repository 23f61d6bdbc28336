"""Asking all documents about hashes, block by block.

Documents are written once as blocks: rows that hold some megabytes of texts. A question is a set of hashes of a
block, each once, dealt as packed arrays into buckets by hash; a bucket sees what all blocks ask about its hashes and
sends each block an answer of a few bits a hash, in the order asked. So a hash that a third of all documents hold
costs a bucket one entry a block, not one a document, and texts are never shuffled: the table of blocks is bucketed
by block, and only answers move to meet it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.llm.grid import U64, column, drop_kept, give_back, runs
from tracery.llm.tables import bucketed, id_and_text, shuffle_partitions, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of text that a task reads from the table of blocks.
PART_BYTES = 64 << 20
#: About so many entries meet in a bucket.
BUCKET_ENTRIES = 500_000
_BLOCK = "block long, n_bytes long, doc_ids array<long>, texts array<string>"


def block_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """The documents as a table of blocks (block, n_bytes, doc_ids, texts), bucketed by block, in the shared folder.

    With ``whole_rows`` a column ``rest`` keeps the other columns of each document.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _BLOCK
    if whole_rows:
        others = [c for c in docs.columns if c not in (id_col, text_col)]
        source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.struct(*(docs[c] for c in others) if others else [F.lit(0).alias("none")]).alias("rest"))
        schema = f"{_BLOCK}, rest array<{source.schema['rest'].dataType.simpleString()}>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            texts = pa.concat_arrays([column(r, "text").cast(pa.string()) for r in held])
            ids = pa.concat_arrays([column(r, "doc_id") for r in held])
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            rest = {"rest": whole(pa.concat_arrays([column(r, "rest") for r in held]))} if whole_rows else {}
            return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "doc_ids": whole(ids), "texts": whole(texts)} | rest)

        for run in runs(batches, limit=BLOCK_BYTES // 8):
            held.append(run)
            size += column(run, "text").nbytes
            if size >= BLOCK_BYTES:
                yield block()
                at, held, size = at + 1, [], 0
        if held:
            yield block()

    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bucketed(source.mapInArrow(gather, schema), "blocks", "block", max(shuffle_partitions(spark), math.ceil(n_bytes / PART_BYTES)))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, dict]]:
    """Each block with its ids, texts and further columns."""
    drop_kept()
    for batch in batches:
        ids, texts = column(batch, "doc_ids"), column(batch, "texts")
        more = [n for n in batch.schema.names if n not in ("block", "doc_ids", "texts", "n_bytes", "rest")]
        for i, block in enumerate(column(batch, "block").to_pylist()):
            yield block, ids[i].values, texts[i].values, {n: column(batch, n)[i].as_py() for n in more}
    give_back()


def parts_for(blocks: DataFrame) -> int:
    """Buckets of a table that is as large as the blocks: the session's partitions, more where texts are more."""
    n = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(shuffle_partitions(blocks.sparkSession), math.ceil(n / PART_BYTES))


def buckets_for(blocks: DataFrame, entries_per_byte: float) -> int:
    """A power of two that grows with the documents."""
    n = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return 1 << max(4, math.ceil(math.log2(max(1.0, n * entries_per_byte / BUCKET_ENTRIES))))


def asked(block: int, hashes: np.ndarray, buckets: int, width: int, extra: np.ndarray | None = None, second: np.ndarray | None = None) -> pa.RecordBatch | None:
    """A block's question. hashes: each once, ordered by ``bucket_order``; ``extra``: a value sent with each.

    ``width`` bytes of each hash go along; with the bucket they tell hashes apart. ``second`` are other hashes of the
    same, of which 8 bytes follow then.
    """
    if not len(hashes):
        return None
    bucket = (hashes & U64(buckets - 1)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    keys = np.ascontiguousarray((hashes >> U64(buckets.bit_length() - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    if second is not None:
        keys = np.concatenate([keys, second.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1)
    row = lambda a: [a[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
    n = len(edges) - 1
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * n, pa.int64()), "bucket": pa.array(bucket[edges[:-1]], pa.int32()),
        "keys": pa.array(row(keys), pa.binary()), "extra": pa.array(row(extra) if extra is not None else [b""] * n, pa.binary()),
    })


QUESTION = "block long, bucket int, keys binary, extra binary"


def bucket_order(hashes: np.ndarray, buckets: int, within: np.ndarray | None = None) -> np.ndarray:
    """The order of entries that ``asked`` expects: by bucket, then by ``within`` or by hash."""
    bucket = hashes & U64(buckets - 1)
    return np.lexsort([hashes, bucket]) if within is None else np.lexsort([hashes, within, bucket])


def answer(questions: DataFrame, width: int, judge: Callable[[np.ndarray, list[bytes]], np.ndarray], what: str) -> DataFrame:
    """One row a block: its answers (bucket, bits). ``judge`` maps the keys and extras of a bucket to a byte an entry.

    Keys of up to 8 bytes come as numbers, those of 16 as rows of two.
    """

    def each(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint8).reshape(-1, width) for k in table["keys"].to_pylist()]
        cuts = np.cumsum([0, *map(len, keys)])
        wide = np.zeros((cuts[-1], 8 * math.ceil(width / 8)), dtype=np.uint8)
        wide[:, :width] = np.concatenate(keys)
        del keys
        wide = wide.view("<u8")
        out = judge(wide[:, 0] if width <= 8 else wide, table["extra"].to_pylist())
        give_back()
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array([out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    answers = questions.groupBy("bucket").applyInArrow(each, "block long, bucket int, bits binary")
    return written(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(what)), what)


def met(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their answers; only the answers move."""
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")


def in_order(answers: list[dict] | None) -> np.ndarray:
    """The bytes of a block's answers in the order that it asked."""
    return np.frombuffer(b"".join(a["bits"] for a in sorted(answers or (), key=lambda a: a["bucket"])), dtype=np.uint8)


def rows_at(blocks: DataFrame, places: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents at the places (block, places array) of a table of whole rows, with the columns that they had."""

    names = docs.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rest = (column(batch, n) for n in ("doc_ids", "texts", "rest"))
            for i, chosen in enumerate(column(batch, "places").to_pylist()):
                if not chosen:
                    continue
                at = pa.array(sorted(chosen), pa.int64())
                others = rest[i].values.take(at)
                out = {id_col: ids[i].values.take(at), text_col: texts[i].values.take(at)} | {f.name: others.field(k) for k, f in enumerate(others.type)}
                yield pa.RecordBatch.from_pydict({c: out[c] for c in names})

    typed = docs.withColumn(id_col, docs[id_col].cast("long")).withColumn(text_col, docs[text_col].cast("string"))
    return met(blocks, places).mapInArrow(pick, typed.schema)
