"""Word tables over UTF-8 buffers.

A ``Grid`` holds the words of a run of texts as numpy arrays, straight from an Arrow string column:
byte ranges, the first word of each text, and (on demand) 64-bit hashes of words and of word windows.
All separators used here are ASCII, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: A run of rows that is handled at once holds about this many bytes of text.
RUN_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes that belong to words, given inclusive ranges of separators."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words as runs without ASCII white space.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII letters and digits and of all non-ASCII characters; expects lowered text.
PLAIN = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), element by element."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Grid:
    """The words of some texts: ``starts`` and ``ends`` in ``data``; text d has words ``first[d]:first[d + 1]``."""

    def __init__(self, texts: pa.Array, letters: np.ndarray = SPACED, lower: bool = False):
        offsets, raw = string_buffers(texts)
        size = len(raw)
        self.data = np.zeros(size + 8, dtype=np.uint8)
        self.data[:size] = LOWERED[raw] if lower else raw
        self.offsets = offsets
        inside = letters[self.data[:size]]
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[offsets < size]] = False
        after[offsets[offsets > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self._hashes: np.ndarray | None = None
        self._second: np.ndarray | None = None
        self._text_of: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        if self._text_of is None:
            self._text_of = np.repeat(np.arange(len(self), dtype=np.int64), self.n_words)
        return self._text_of

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hashes is None:
            self._hashes = _word_hashes(self.data, self.starts, self.ends)
        return self._hashes

    @property
    def second(self) -> np.ndarray:
        """Another 64-bit hash of each word: with the first one, 128 bits tell words apart."""
        if self._second is None:
            self._second = _word_hashes(self.data, self.starts, self.ends, _OTHER)
        return self._second

    def begins(self, k: int) -> np.ndarray:
        """The first k bytes (at most 8; the whole word if it is shorter) of each word as a little-endian integer."""
        eight = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        return eight[self.starts] & _MASK[np.minimum(self.ends - self.starts, k)]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words that lies in one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[k - 1 :])
        return at, self.sequence_hash(at, k)

    def sequence_hash(self, at: np.ndarray, k: int, second: bool = False) -> np.ndarray:
        """The hash of the k words from each word in ``at``; ``second`` from the words' other hashes, mixed otherwise."""
        total, hashes, turn = np.full(len(at), k, dtype=U64), self.second if second else self.hashes, _TURNS[second]
        for j in range(k):
            total *= turn
            total += hashes[at + j]
        return mix(total)


#: Odd numbers that the two hashes are mixed with.
_TURNS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_LENGTHS, _OTHER = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.uint64 = U64(0)) -> np.ndarray:
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = ends - starts
    out = mix(((eight[starts] & _MASK[np.minimum(length, 8)]) ^ other) + length.astype(U64) * (_LENGTHS ^ other ^ (other >> U64(7) << U64(1))))
    rest, done = np.flatnonzero(length > 8), 8
    while rest.size and done < _LONG_WORD:
        more = eight[starts[rest] + done] & _MASK[np.minimum(length[rest] - done, 8)]
        out[rest] = mix(out[rest] * _TURNS[int(other > 0)] + more)
        done += 8
        rest = rest[length[rest] > done]
    for i in rest:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=int(other))
    return out


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``length`` bytes in the two buffers (each with 8 spare bytes at its end) are equal."""
    eight = lambda x: np.ndarray((len(x) - 7,), dtype="<u8", buffer=x, strides=(1,))
    left, right, same = eight(a), eight(b), np.ones(len(length), dtype=bool)
    rest, done = np.flatnonzero(length > 0), 0
    while rest.size:
        mask = _MASK[np.minimum(length[rest] - done, 8)]
        equal = (left[a_starts[rest] + done] & mask) == (right[b_starts[rest] + done] & mask)
        same[rest[~equal]] = False
        done += 8
        rest = rest[equal & (length[rest] > done)]
    return same


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = RUN_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; a longer text is a slice of its own.

    Unless ``keep``, what other operators have kept in this worker (see ``kept``) is dropped first.
    """
    if not keep:
        drop_kept()
    for batch in batches:
        i = batch.schema.get_field_index(column)
        offsets, _ = string_buffers(batch.column(i))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


_KEPT: dict = {}


def drop_kept() -> None:
    _KEPT.clear()


def kept(key, build):
    """What ``build`` gives, kept in the worker for its next tasks until another key is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers stay, and the next may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
