"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces, the first of which may be shorter. Lengths are whole
numbers up to the capacity, so how many pieces have each length describes the whole problem in a table of bounded
size, and a plan for that table packs every piece at once: pieces above a third of the capacity, of which no sequence
holds three, are paired greedily (the longest with the longest that fits beside it); then the smaller lengths, from
the longest, go to the fullest sequences that still have room, many at a time. Pieces are numbered within their length
and take the plan's places in that order; only those numbers are joined, never token ids.

Defined results: a null or empty text is one piece of the end token; repeated rows are packed each; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracery.llm.encoding import as_bytes, encoder
from tracery.llm.grid import column, runs
from tracery.llm.tables import id_and_text, id_field, written

CAPACITY = 1024


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, as rows (length, low, high, sequence, each, offset).

    Pieces low to high - 1 of the length go to sequences from ``sequence`` on, ``each`` side by side in one sequence,
    the first of them at ``offset``.
    """
    left = {n: k for n, k in counts.items() if k}
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    sequences = 0

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((length, taken[length], taken[length] + n, sequence, each, offset))
        taken[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and b <= capacity - a and left[b] > (b == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, n, sequences, 1, 0)
            if b is not None:
                place(b, n, sequences, 1, a)
            gaps[capacity - a - (b or 0)].append((sequences, n))
            sequences += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            room = min((g for g, found in gaps.items() if g >= s and found), default=None)
            if room is None:
                each = min(capacity // s, left[s])
                n = max(1, left[s] // each)
                first, room = sequences, capacity
                sequences += n
            else:
                first, there = gaps[room].pop()
                each = min(room // s, left[s])
                n = min(there, left[s] // each)
                if n < there:
                    gaps[room].append((first + n, there - n))
            place(s, n * each, first, each, capacity - room)
            gaps[room - each * s].append((first, n))
    return rows


_PIECE = [T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "task", "nth"))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece; ``nth`` numbers the pieces of each length in a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        codes = encoder(tokenizer_path)
        end = np.array([end_id], dtype=codes.dtype).tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for run in runs(batches, keep=True):
            rows, doc_of = [], []
            for d, ids in enumerate(codes.encode(as_bytes(column(run, "text")))):
                data = np.frombuffer(ids + end, dtype=codes.dtype).astype("<u4").tobytes()
                n = len(data) // 4
                start, stop = 0, n % capacity or min(n, capacity)
                for piece in range(-(-n // capacity)):
                    rows.append((piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), seen[stop - start]))
                    seen[stop - start] += 1
                    doc_of.append(d)
                    start, stop = stop, stop + capacity
            if rows:
                piece, start, length, crc, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": column(run, "doc_id").take(pa.array(doc_of)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(rows), pa.int64()), "nth": pa.array(nth, pa.int64()),
                })
        codes.rest()

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, T.StructType([id_field(docs, id_col), *_PIECE]))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver, whatever the input.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(total, capacity)
    places = spark.createDataFrame(rows, "length long, low long, high long, sequence long, each long, at long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    numbered = cut.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan has some rows for each length: its size depends on the capacity, not on the input.
    placed = numbered.alias("p").join(F.broadcast(places.alias("q")), (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("p.length")).alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracery.llm.tables import read

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
