"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their keys:

    magic | data blocks | Bloom filter | block index | footer

A data block has entries (shared key bytes, further key bytes, value bytes as varints; key suffix; value), a restart
entry with its whole key every 16 entries, the restarts' offsets, their number, and a CRC. The index has each block's
last key, place and size; it, the filter and the footer are small, so a reader finds a document by one binary search
in the index, one among the restarts of one block, and at most 16 entries.

Keys order like the identifiers: null first, then integers (or strings by bytes), then the running number among rows
of the same identifier. Values are token ids as little-endian integers of 2 or 4 bytes.

Defined results: a null or empty text is the end token alone; rows with the same or no identifier are all kept; an
empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracery.llm.encoding import as_bytes, encoder
from tracery.llm.grid import column, runs
from tracery.llm.tables import id_and_text, id_field, shared_folder, shuffle_partitions, written

MAGIC = b"TRSST001"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 256 << 20
RESTART = 16
_BLOOM_BITS, _BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQB7x8s")  # filter's and index's place and size, documents, tokens, id width, magic


def id_key(value: int | str | None) -> bytes:
    """Bytes that order like identifiers."""
    if value is None:
        return b"\x00"
    if isinstance(value, str):
        return b"\x01" + value.encode().replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    return b"\x01" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))


def key_id(key: bytes, text: bool) -> int | str | None:
    if key[:1] == b"\x00":
        return None
    if text:
        return key[1:-6].replace(b"\x00\xff", b"\x00").decode()
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Writes one shard to a stream; keys must ascend."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        out.write(MAGIC)
        self.place, self.n_docs, self.n_tokens = len(MAGIC), 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.hashes.append(xxhash.xxh3_64_intdigest(key[:-4]))
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.out.write(body)
        self.index.append((self.last, self.place, len(body)))
        self.place += len(body)
        self._fresh()

    def close(self) -> None:
        self._flush()
        bits = bloom_bits(np.array(self.hashes, dtype=np.uint64))
        index = b"".join(_varint(len(k)) + k + _varint(p) + _varint(s) for k, p, s in self.index)
        self.out.write(bits)
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.place, len(bits), self.place + len(bits), len(index), self.n_docs, self.n_tokens, self.width, MAGIC))


def _bloom_places(hashes: np.ndarray, size: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(_BLOOM_HASHES, dtype=np.uint64)) % np.uint64(size)


def bloom_bits(hashes: np.ndarray) -> bytes:
    size = max(64, (len(hashes) * _BLOOM_BITS + 7) // 8 * 8)
    bits = np.zeros(size, dtype=bool)
    bits[_bloom_places(hashes, size).reshape(-1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class ShardReader:
    """Reads a shard from a seekable file: in order, or one identifier by binary search."""

    def __init__(self, file, text_ids: bool = False):
        self.file, self.text_ids = file, text_ids
        size = file.size()
        bloom_at, bloom_size, index_at, index_size, self.n_docs, self.n_tokens, self.width, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a shard")
        self.bloom = np.frombuffer(file.read_at(bloom_size, bloom_at), dtype=np.uint8)
        data, at, self.index = file.read_at(index_size, index_at), 0, []
        while at < len(data):
            n, at = _unvarint(data, at)
            key = data[at : at + n]
            place, at = _unvarint(data, at + n)
            length, at = _unvarint(data, at)
            self.index.append((key, place, length))

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...]]:
        _, place, size = self.index[k]
        body = self.file.read_at(size, place)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", body[-8:-4])[0]
        return body[: -8 - 4 * n], struct.unpack(f"<{n}I", body[-8 - 4 * n : -8])

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _unvarint(data, at)
            more, at = _unvarint(data, at)
            size, at = _unvarint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | str | None, bytes]]:
        for k in range(len(self.index)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield key_id(key, self.text_ids), value

    def may_hold(self, value: int | str | None) -> bool:
        places = _bloom_places(np.array([xxhash.xxh3_64_intdigest(id_key(value))], dtype=np.uint64), 8 * len(self.bloom))[0]
        return bool(((self.bloom[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all())

    def find(self, value: int | str | None) -> list[np.ndarray]:
        """The token ids of every row with this identifier."""
        if not self.may_hold(value):
            return []
        want = id_key(value)
        low, high = 0, len(self.index)
        while low < high:  # the first block whose last key reaches the wanted one
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < want else (low, mid)
        found = []
        for k in range(low, len(self.index)):
            data, restarts = self._block(k)
            a, b = 0, len(restarts)
            while b - a > 1:  # the last restart before the wanted key
                mid = (a + b) // 2
                a, b = (mid, b) if next(self._entries(data, restarts[mid]))[0] < want else (a, mid)
            for key, value_bytes in self._entries(data, restarts[a]):
                if key[:-4] == want:
                    found.append(np.frombuffer(value_bytes, dtype=f"<u{self.width}"))
                elif key > want:
                    return found
        return found


def open_shard(path: str, text_ids: bool = False) -> ShardReader:
    system, name = pafs.FileSystem.from_uri(path)
    return ShardReader(system.open_input_file(name), text_ids)


#: Types of identifiers that shards hold.
_ID_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
#: Bytes of text in a range of identifiers, which one task encodes.
RANGE_BYTES = 128 << 20
_MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenises and writes shards below ``folder``; returns the manifest, one row a shard in the order of its documents.

    The texts are dealt once, by ranges of (identifier, text hash), so that rows sharing an identifier are divided
    too; there are as many ranges as the texts need. Identifiers other than whole numbers are ordered as text. A task writes to a name of its own and renames the finished shard, so a repeated or speculative attempt
    leaves whole files; only shards in the manifest count.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    if source.schema["doc_id"].dataType.simpleString() not in _ID_TYPES:
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(n_bytes / RANGE_BYTES))
    dealt = source.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll = TaskContext.get().partitionId(), 0
        system, top = pafs.FileSystem.from_uri(folder)
        codes = encoder(tokenizer_path)
        end = np.array([end_id], dtype=codes.dtype).tobytes()
        writer = stream = name = None
        last, again = object(), 0

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            final = f"{top}/shard-{part:08d}-{roll:06d}.sst"
            system.move(name, final)
            return pa.RecordBatch.from_pydict({"shard": [(part << 24) + roll], "path": [f"{folder}/shard-{part:08d}-{roll:06d}.sst"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

        for run in runs(batches, keep=True):
            for doc_id, ids in zip(column(run, "doc_id").to_pylist(), codes.encode(as_bytes(column(run, "text"))), strict=True):
                if writer is None:
                    name = f"{top}/.{uuid.uuid4().hex}"
                    system.create_dir(top, recursive=True)
                    stream = system.open_output_stream(name)
                    writer = ShardWriter(stream, codes.dtype.itemsize)
                again = again + 1 if doc_id == last else 0
                last = doc_id
                writer.add(id_key(doc_id) + struct.pack(">I", again), ids + end)
                if writer.place >= shard_bytes:
                    yield finish()
                    writer, roll = None, roll + 1
        if writer is not None:
            yield finish()
        codes.rest()

    return written(dealt.select("doc_id", "text").mapInArrow(write, _MANIFEST), "manifest")


def read_shards(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """One row a document, read from the shards: doc_id, start (tokens of all before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    stored_type = id_type if id_type.simpleString() in _ID_TYPES else T.StringType()
    text_ids = isinstance(stored_type, T.StringType)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a shard; dealt anew so that each task reads a few shards.
    placed = manifest.select("path", "shard", before.alias("base")).repartition(shuffle_partitions(spark), "shard")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                shard = open_shard(path, text_ids)
                rows: list[tuple] = []
                for doc_id, value in shard:
                    ids = np.frombuffer(value, dtype=f"<u{shard.width}")
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) >= 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    arrow_id = _ID_TYPES[stored_type.simpleString()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(a, arrow_id), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids_crc32": pa.array(d, pa.int64())})

    counted = [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]
    found = placed.select("path", "base").mapInArrow(scan, T.StructType([T.StructField("doc_id", stored_type), *counted]))
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracery.llm.tables import read

    docs = read(spark, sf_dir, "documents")
    manifest = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1, shared_folder(spark, "shards"))
    return read_shards(manifest, id_field(docs).dataType)
