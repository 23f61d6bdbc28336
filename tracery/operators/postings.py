"""Listing with an index of byte grams.

The index has one row for each gram (up to ``q`` bytes of UTF-8, at most 5, with its length as a whole number) and
document. A pattern of at most q bytes is a gram itself, and its list is the answer. A longer one asks for up to
``GRAMS`` of its grams of q bytes; a document that has them all is a candidate, and its text is compared. Grams are made
in one linear, vectorised pass over the texts.

For large collections the index is kept in blocks of some megabytes of whole documents (``block_index``), made where the
documents lie and asked there: nothing is shuffled. A block has one gram of q bytes for each position, fewer at a text's
end, sorted, with the lists of its documents. The grams that begin with a pattern of at most q bytes stand together, so
shorter grams need no lists of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.operators.search import SLICE_CHARS, each_slice, slices
from tracery.operators.shards import packed, unpacked
from tracery.sources.workspace import bound_batches, stored

Q, GRAMS = 5, 4
#: Bits of a gram's bytes; its length stands above.
BITS = 40
_RUN_BYTES = 1 << 22


def _distinct_grams(texts: list[bytes], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, gram) pairs; grams of 1 to q bytes as big-endian numbers below their length."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    owner, ends = np.repeat(np.arange(len(texts)), size), np.cumsum(size)
    owners, grams, gram = [], [], np.zeros(len(data), dtype=np.int64)
    for k in range(1, min(q, len(data)) + 1):
        gram = (gram[: len(data) - k + 1] << 8) | data[k - 1 :]
        inside = np.arange(len(gram)) + k <= ends[owner[: len(gram)]]
        pair = np.unique(owner[: len(gram)][inside] << BITS | gram[inside])
        owners.append(pair >> BITS)
        grams.append((pair & ((1 << BITS) - 1)) | k << BITS)
    return (np.concatenate(owners), np.concatenate(grams)) if owners else (np.zeros(0, dtype=np.int64),) * 2


def gram_index(docs: DataFrame, q: int = Q) -> DataFrame:
    """(gram, doc_id), each once; see ``sorted_index`` for what to write of it."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (held < _RUN_BYTES or to == at):
                    held += len(texts[to])
                    to += 1
                owner, gram = _distinct_grams(texts[at:to], q)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(gram, pa.int64()), "doc_id": pa.array(ids[at:to][owner], pa.int64())})
                at = to

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(grams, "gram long, doc_id long")


def sorted_index(docs: DataFrame, q: int = Q) -> DataFrame:
    """The index dealt by ranges of grams and sorted by them: a reader of some grams skips what lies between.

    A gram that a third of all documents hold is dealt by documents too.
    """
    return gram_index(docs, q).repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id")


def posting_lists(index: DataFrame, most: int = 1000) -> DataFrame:
    """(gram, part, docs): the lists dumped, a long one in parts of documents whose identifiers fall together."""
    lists = index.groupBy("gram", F.floor(F.col("doc_id") / most).alias("part")).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return lists.select("gram", "part", "docs")


def gram_of(text: Column, place: Column, q: Column | int = Q) -> Column:
    """The gram of q bytes at a byte of a text, from 0."""
    q = F.lit(q) if isinstance(q, int) else q
    value = F.conv(F.hex(F.substring(text.cast("binary"), place + 1, q)), 16, 10).cast("long")
    return value.bitwiseOR(F.shiftleft(q.cast("long"), BITS))


def list_docs_indexed(docs: DataFrame, index: DataFrame, patterns: DataFrame, q: int = Q, grams: int = GRAMS) -> DataFrame:
    """(pattern_id, doc_id) by grams and comparison; the grams asked for are spread evenly over the pattern."""
    size = F.octet_length("pattern")
    width = F.least(size, F.lit(q))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(grams - 1)), lambda i: F.floor((size - width) * i / (grams - 1)).cast("int")))
    asked = patterns.withColumn("grams", F.array_distinct(F.transform(places, lambda p: gram_of(F.col("pattern"), p, width))))
    wanted = asked.select("pattern_id", (size <= q).alias("whole"), F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    met = index.join(wanted, "gram")
    held = met.filter(~F.col("whole")).groupBy("pattern_id", "doc_id").agg(F.count("*").alias("held"), F.first("n").alias("n")).filter("held = n")
    # Written, their size is known: few candidates are sent to the texts, which then stay where they lie.
    held = stored(held.select("pattern_id", "doc_id"), "candidates")
    found = docs.join(held, "doc_id").join(patterns, "pattern_id").filter(F.col("text").contains(F.col("pattern"))).select("pattern_id", "doc_id")
    return met.filter("whole").select("pattern_id", "doc_id").unionAll(found)


#: Bits of a block's gram below its bytes: how many bytes there are.
_LENGTH_BITS = 3
_BLOCK_SCHEMA = "doc_ids array<long>, starts binary, data binary, grams binary, sizes binary, docs binary"
#: Rows of a batch of lists.
_ROWS = 50_000


def _positions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of each position, once each, by gram and text: up to Q bytes, zeros after them, and their number."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(Q), dtype=np.uint8)
    n = len(data) - Q
    owner, ends = np.repeat(np.arange(len(texts)), size), np.cumsum(size)
    room = np.minimum(ends[owner] - np.arange(n), Q)
    gram = np.zeros(n, dtype=np.int64)
    for k in range(Q):
        gram = gram << 8 | np.where(k < room, data[k : k + n], 0)
    gram = gram << _LENGTH_BITS | room
    bits = max(len(texts) - 1, 1).bit_length()
    if bits + 8 * Q + _LENGTH_BITS > 63:
        order = np.lexsort([owner, gram])
        gram, owner = gram[order], owner[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))[:n]
        return owner[new], gram[new]
    pair = gram << bits | owner
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])[:n]]
    return pair & ((1 << bits) - 1), pair >> bits


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, dtype=np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and held + len(text or b"") > _RUN_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc)
            texts.append(text or b"")
            held += len(texts[-1])
    if ids:
        yield ids, texts


def block_index(docs: DataFrame) -> DataFrame:
    """The gram index in blocks, one row each, with their texts; write it before asking it."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            owner, gram = _positions(texts)
            at = _heads(gram)
            row = {
                "starts": packed(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.int64), "data": packed(np.frombuffer(b"".join(texts), dtype=np.uint8), np.uint8),
                "grams": packed(np.diff(gram[at[:-1]], prepend=0), np.int64), "sizes": packed(np.diff(at)), "docs": packed(np.diff(owner, prepend=0)),
            }
            yield pa.RecordBatch.from_pydict({"doc_ids": pa.array([ids], pa.list_(pa.int64()))} | {k: pa.array([v], pa.binary()) for k, v in row.items()})

    bound_batches(docs.sparkSession)
    return docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary")).mapInArrow(blocks, _BLOCK_SCHEMA)


class _Block:
    def __init__(self, row: dict):
        self.ids = np.array(row["doc_ids"], dtype=np.int64)
        self.starts, self.data = unpacked(row["starts"], np.int64), unpacked(row["data"], np.uint8).tobytes()
        self.grams = np.cumsum(unpacked(row["grams"], np.int64))
        self.at = np.concatenate([[0], np.cumsum(unpacked(row["sizes"]), dtype=np.int64)])
        self.docs = np.cumsum(unpacked(row["docs"]), dtype=np.int64)

    def beginning(self, piece: bytes) -> np.ndarray:
        """The documents that hold a piece of at most Q bytes."""
        low, high = (int.from_bytes(piece.ljust(Q, fill), "big") << _LENGTH_BITS for fill in (b"\0", b"\xff"))
        a = np.searchsorted(self.grams, low | len(piece), side="left")
        b = np.searchsorted(self.grams, high | 7, side="right")
        found = self.docs[self.at[a] : self.at[b]]
        return found if b - a <= 1 else np.unique(found)

    def holding(self, pattern: bytes) -> np.ndarray:
        if len(pattern) <= Q:
            return self.beginning(pattern)
        places = dict.fromkeys((len(pattern) - Q) * i // (GRAMS - 1) for i in range(GRAMS))
        lists = sorted((self.beginning(pattern[p : p + Q]) for p in places), key=len)
        found = lists[0]
        for other in lists[1:]:
            found = np.intersect1d(found, other, assume_unique=True)
        return np.array([d for d in found.tolist() if self.data.find(pattern, int(self.starts[d]), int(self.starts[d + 1])) >= 0], dtype=np.int64)


def list_docs_in_blocks(index: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, doc_id): candidates by their grams, compared with the texts that lie beside them."""
    schema = "pattern_id long, doc_id long"

    def with_words(words: Broadcast) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = _Block(row)
                    for word, numbers in words.value.items():
                        found = block.ids[block.holding(word.encode())]
                        for number in numbers if len(found) else ():
                            yield pa.RecordBatch.from_pydict({"pattern_id": pa.array(np.full(len(found), number, dtype=np.int64)), "doc_id": pa.array(found)})

        return index.mapInArrow(ask, schema)

    bound_batches(index.sparkSession)
    return each_slice(index.sparkSession, slices(patterns, slice_chars), schema, with_words)


def document_counts(index: DataFrame) -> DataFrame:
    """(gram, n_docs) of the grams of Q bytes: a block's lists have their sizes, and only these are added up."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                gram, size = np.cumsum(unpacked(row["grams"], np.int64)), unpacked(row["sizes"]).astype(np.int64)
                whole = gram & ((1 << _LENGTH_BITS) - 1) == Q
                gram, size = gram[whole] >> _LENGTH_BITS, size[whole]
                for i in range(0, len(gram), _ROWS):
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(gram[i : i + _ROWS]), "n": pa.array(size[i : i + _ROWS])})

    bound_batches(index.sparkSession)
    return index.select("grams", "sizes").mapInArrow(sizes, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n_docs"))


def _lists(part: int, ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The lists of a part's grams; those of many bytes in several passes, each over some of the grams."""
    passes = max(1, -(-sum(map(len, texts)) // (4 * _RUN_BYTES)))
    names = pa.array([str(i) for i in ids], pa.string())
    for nth in range(passes):
        owners, grams = [], []
        first = 0
        for _, run in _runs(iter([pa.RecordBatch.from_pydict({"d": pa.array(ids), "t": pa.array(texts, pa.binary())})])) if passes > 1 else [(ids, texts)]:
            owner, gram = _positions(run)
            mine = (gram & ((1 << _LENGTH_BITS) - 1) == Q) & ((gram >> _LENGTH_BITS) % passes == nth)
            owners.append(owner[mine] + first)
            grams.append(gram[mine] >> _LENGTH_BITS)
            first += len(run)
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        if len(owners) > 1:
            order = np.argsort(gram, kind="stable")
            owner, gram = owner[order], gram[order]
        at = _heads(gram)
        for i in range(0, len(at) - 1, _ROWS):
            cut = at[i : i + _ROWS + 1]
            lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), names.take(pa.array(owner[cut[0] : cut[-1]])))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram[cut[:-1]]), "part": pa.array(np.full(len(cut) - 1, part, dtype=np.int64)), "docs": pc.binary_join(lists, ",")})


def dumped_lists(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(gram, part, docs): as ``posting_lists`` of the grams of Q bytes, identifiers joined by commas.

    The documents of a part, ``most`` at most, come together; texts are moved once, lists never.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts = None, [], []
        for batch in batches:
            for of, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part and ids:
                    yield from _lists(part, ids, texts)
                    ids, texts = [], []
                part = of
                ids.append(doc)
                texts.append(text or b"")
        if ids:
            yield from _lists(part, ids, texts)

    bound_batches(docs.sparkSession)
    parts = docs.filter("doc_id is not null").select(F.floor(F.col("doc_id") / most).alias("part"), "doc_id", F.col("text").cast("binary").alias("text"))
    return parts.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(each, "gram long, part long, docs string")
