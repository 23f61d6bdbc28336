"""A suffix index in shards, written once and asked many times.

A shard holds some megabytes of whole documents in UTF-8 and all their suffixes in order, as compressed columns: the
byte before each suffix (``bwt``), the places of every 64th position's suffix (``samples``), and the stored nodes of the
shard's prefix tree with their document sets. What takes several bytes a suffix is made from these by whoever asks: where
each suffix starts (``sa``, by walking from sample to sample, all walks side by side), one more than the place of the
same document's suffix before it or 0 (``c``), and the bytes that those two share (``ilcp``, of the ranges asked for). A document lies in one
shard, so answers of shards are simply put together: nothing is shuffled to build the index or to ask it, and both grow
in proportion with the collection. A task holds one shard at a time. Patterns are sent to the shards in slices of bounded
size.

Ranges of suffixes belong to a shard: (shard, sp, ep), both ends included. Order is by bytes, which is by code points;
equal suffixes are ordered by document and position. Identifiers are unique in a collection; a null or empty text has
no suffix. A document longer than ``shard_bytes`` is a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.operators.search import SLICE_CHARS, each_slice, slices
from tracery.sources.workspace import bound_batches

_HEAD = 7
#: Suffixes whose shared bytes are counted together: their intermediate arrays stay in the processor's cache.
_TOGETHER = 1 << 15
#: Suffixes that a step takes at once: what it holds on its way is so much, whatever the shard's size.
_PIECE = 1 << 18
#: So many patterns are looked up in a shard's texts; only for more the first bytes of all suffixes are laid out.
_FEW = 2000
#: Every so many positions of a document, from its first, the place of the suffix is kept.
_SAMPLE = 64
_SCHEMA = "shard long, doc_ids array<long>, starts binary, data binary, bwt binary, firsts binary, samples binary, node_sp binary, node_ep binary, node_leaf binary, node_all binary, node_first binary, node_docs binary, node_tf binary"
#: The arrays that are made from the others, laid out with 4 bytes a suffix each.
_ARRAYS = ", c binary, ilcp binary"
_SA = ["bwt", "firsts", "samples"]
_NODES = [*_SA, "node_sp", "node_ep", "node_leaf", "node_all", "node_first", "node_docs", "node_tf"]
#: The columns are compressed and differ from row to row: the file's writer and readers need no room to try that again.
FILES = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
#: The columns that each way of listing reads.
WAYS = {"c": _SA, "ilcp": _SA, "slice": _SA, "nodes": _NODES}


@dataclass(frozen=True)
class Parameters:
    """Bytes of text in a shard; suffixes under a leaf of the tree at most; how much smaller than its children's sets
    a node's own set must be to be stored."""

    shard_bytes: int = 4 << 20
    block_size: int = 512
    factor: float = 4.0


def padded(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    out[: len(data)] = data
    return out


def heads(data: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The first bytes of suffixes and, last, how many there are: they order suffixes as far as they reach."""
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))[at].astype(np.uint64)
    n = np.minimum(room, _HEAD).astype(np.uint64)
    unused = np.uint64(8) * (np.uint64(8) - n)
    # Shifting by 64 bits is undefined; a suffix has a byte at least.
    return (eight >> unused << unused) | n


def taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` by pieces: numpy lays out all numbers that it is asked with in 8 bytes each."""
    out = np.empty(len(at), dtype=values.dtype)
    for i in range(0, len(at), _PIECE):
        out[i : i + _PIECE] = values[at[i : i + _PIECE]]
    return out


def counts(keys: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each number below ``n_keys`` occurs."""
    if len(keys) <= _PIECE:
        return np.bincount(keys, minlength=n_keys)
    out = np.zeros(n_keys, dtype=np.int64)
    for i in range(0, len(keys), _PIECE):
        out += np.bincount(keys[i : i + _PIECE], minlength=n_keys)
    return out


def deal(keys: np.ndarray, begins: np.ndarray, out: np.ndarray, without: np.ndarray | None = None) -> None:
    """Puts the places of each key, in their order, into ``out`` from where the key begins; ``without``: places left out."""
    begins = begins.copy()
    for i in range(0, len(keys), _PIECE):
        part = keys[i : i + _PIECE]
        if without is None:
            by = np.argsort(part, kind="stable")
        else:
            has = np.ones(len(part), dtype=bool)
            has[without[np.searchsorted(without, i) : np.searchsorted(without, i + _PIECE)] - i] = False
            by = np.flatnonzero(has)
            by = by[np.argsort(part[by], kind="stable")]
        found = part[by]
        head = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
        size = np.diff(np.append(head, len(found)))
        out[np.repeat(begins[found[head]] - head, size) + np.arange(len(found))] = by + i
        begins[found[head]] += size


def _first_two(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first two bytes of each suffix, the second 0 where there is none."""
    n = len(ends)
    two = data[:n].astype(np.uint16)
    two <<= 8
    for i in range(0, n, _PIECE):
        part = slice(i, min(i + _PIECE, n))
        two[part] |= np.where(ends[part] - np.arange(part.start, part.stop) > 1, data[part.start + 1 : part.stop + 1], 0).astype(np.uint16)
    return two


def _whole_groups(slots: np.ndarray, rank: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """The slots by pieces, suffixes of one rank together."""
    i = 0
    while i < len(slots):
        j = min(i + _PIECE, len(slots))
        last = rank[order[slots[j - 1]]]
        while j < len(slots):
            others = np.flatnonzero(rank[order[slots[j : j + _PIECE]]] != last)
            j += int(others[0]) if others.size else len(slots[j : j + _PIECE])
            if others.size:
                break
        yield slots[i:j]
        i = j


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions in the order of their suffixes, which go on to the end of their document.

    Ranks by the first bytes are doubled in reach for those that are still equal, until nothing more is told apart.
    Suffixes are taken by pieces, those that are still equal together: besides 14 bytes a suffix, a piece is held. Ranks
    told apart by one piece serve the next; they only come closer to the order.
    """
    n = len(ends)
    kind = np.int32 if n < 1 << 31 else np.int64
    order, rank = np.empty(n, dtype=kind), np.empty(n, dtype=kind)
    two = _first_two(data, ends)
    cuts = np.cumsum(counts(two, 1 << 16))
    deal(two, np.concatenate([[0], cuts[:-1]]), order)
    del two
    left, a = [], 0
    while a < n:  # as many beginnings of two bytes as make a piece, one at least
        b = int(cuts[max(np.searchsorted(cuts, a + _PIECE, side="right") - 1, np.searchsorted(cuts, a, side="right"))])
        at = order[a:b]
        key = heads(data, at, ends[at] - at)
        by = np.argsort(key)
        at, key = at[by], key[by]
        fresh = np.ones(b - a + 1, dtype=bool)
        fresh[1:-1] = key[1:] != key[:-1]
        order[a:b] = at
        slots = np.arange(a, b)
        rank[at] = np.maximum.accumulate(np.where(fresh[:-1], slots, 0))
        left.append(slots[~(fresh[:-1] & fresh[1:])].astype(kind))
        a = b
    reach = _HEAD
    while left:
        slots, left = np.concatenate(left), []
        for part in _whole_groups(slots, rank, order):
            at = order[part].astype(np.int64)
            further = at + reach
            inside = further < ends[at]
            after = np.where(inside, rank[np.where(inside, further, 0)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + after
            by = np.argsort(key)
            at, key, after = at[by], key[by], after[by]
            first = np.ones(len(at) + 1, dtype=bool)
            first[1:-1] = key[1:] != key[:-1]
            ranks = np.maximum.accumulate(np.where(first[:-1], part, 0))
            # What stands alone is placed; what has ended is equal for good, and stands in the order of its positions.
            alone, ended = first[:-1] & first[1:], after == 0
            at[ended] = np.sort(ranks[ended].astype(np.int64) * n + at[ended]) % max(n, 1)
            order[part], rank[at] = at, ranks
            still = part[~(alone | ended)]
            if still.size:
                left.append(still)
        reach *= 2
    return order


def shared_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share, ``room`` at most."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    for i in range(0, len(a), _TOGETHER):
        part = slice(i, i + _TOGETHER)
        _share(eight, a[part], b[part], room[part], out[part])
    return np.minimum(out, room, out=out)


def _share(eight: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, out: np.ndarray) -> None:
    rest = np.flatnonzero(room > 0)
    while rest.size:
        differ = eight[a[rest] + out[rest]] ^ eight[b[rest] + out[rest]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        out[rest] += same
        rest = rest[(same == 8) & (out[rest] < room[rest])]


def common(raw: bytes, a: int, b: int, room: int) -> int:
    """How many bytes two suffixes share, ``room`` at most: ever longer pieces are compared whole, and the first unequal
    one is halved, so that a text of one repeated line costs no step for every few bytes."""
    n, piece = 0, 16
    while n < room:
        to = min(n + piece, room)
        if raw[a + n : a + to] != raw[b + n : b + to]:
            while to - n > 1:
                half = (n + to) // 2
                n, to = (half, to) if raw[a + n : a + half] == raw[b + n : b + half] else (n, half)
            return n
        n, piece = to, 2 * piece
    return n


def packed(values, kind=np.int32) -> bytes:
    """Numbers compressed, equal bytes of them side by side."""
    x = np.ascontiguousarray(values, dtype=kind)
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if x.itemsize > 1 else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(blob: bytes, kind=np.int32) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b"", dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1) if width > 1 else raw.view(kind)


def _sampled(starts: np.ndarray) -> np.ndarray:
    """The positions whose places are kept: each document's first and every so many after it."""
    sizes = np.diff(starts)
    n = -(-sizes // _SAMPLE)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts[:-1], n) + nth * _SAMPLE


def _followed(data: np.ndarray, starts: np.ndarray, bwt: np.ndarray, firsts: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Where each suffix starts, from the bytes before the suffixes and the places of sampled positions.

    Suffixes in the order of the bytes before them are the remainders, in order, of the suffixes that have one; among
    those of one first byte the ones that end with it stand before. So each place tells the place of the position after.
    """
    n = len(bwt)
    total = counts(data[:n], 256)
    whole = np.flatnonzero(np.diff(starts) > 0)
    ending = np.bincount(data[starts[whole + 1] - 1], minlength=256)
    follow = np.full(n, -1, dtype=np.int32)
    deal(bwt, np.cumsum(total) - total + ending, follow, firsts)
    sa = np.empty(n, dtype=np.int32)
    position, place = _sampled(starts), samples.astype(np.int64)
    length = np.diff(np.append(position, n))
    for _ in range(_SAMPLE):
        sa[place] = position
        going = length > 1
        if not going.all():
            position, place, length = position[going], place[going], length[going]
        if not len(place):
            break
        position, place, length = position + 1, follow[place], length - 1
    return sa


class Shard:
    """A shard in memory."""

    def __init__(self, row: dict):
        self.number, self.ids = row["shard"], row["doc_ids"]
        self.starts = unpacked(row["starts"], np.int64)
        held = unpacked(row["data"], np.uint8)
        self.bytes = held.tobytes()
        self.data = padded(held)
        self.row = row
        self._kept: dict[str, np.ndarray] = {}
        self._asks = 0

    def _once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def sa(self) -> np.ndarray:
        """Where each suffix starts."""
        return self._once("sa", lambda: _followed(self.data, self.starts, unpacked(self.row["bwt"], np.uint8), unpacked(self.row["firsts"]), unpacked(self.row["samples"])))

    @property
    def owner(self) -> np.ndarray:
        """The document of each position."""
        return self._once("owner", lambda: np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts)))

    @property
    def c(self) -> np.ndarray:
        """One more than the place of the same document's suffix before, or 0."""
        return self._once("c", lambda: _before(taken(self.owner, self.sa), len(self.ids), 1))

    def ilcp(self, sp: int, ep: int, most: int) -> np.ndarray:
        """The bytes, ``most`` at most, that the suffixes of a range share with the same document's suffix before."""
        before, at = self.c[sp : ep + 1], self.sa[sp : ep + 1]
        out, has = np.zeros(len(at), dtype=np.int64), np.flatnonzero(before)
        a, b = at[has], self.sa[before[has] - 1]
        out[has] = shared_bytes(self.data, a, b, np.minimum(self.ends_of(a) - np.maximum(a, b), most))
        return out

    def column(self, name: str, kind=np.int32) -> np.ndarray:
        return self._once(name, lambda: unpacked(self.row[name], kind))

    @property
    def node_docs(self) -> np.ndarray:
        """The documents of all stored sets, one after the other."""
        return self._once("docs", lambda: np.cumsum(self.column("node_docs"), dtype=np.int64))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.owner[at]

    def ends_of(self, at: np.ndarray) -> np.ndarray:
        return self.starts[self.doc_of(at) + 1]

    def documents(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[numbers]

    def range(self, pattern: bytes) -> tuple[int, int]:
        """First and last place of the suffixes that begin with the pattern; the last before the first if none do."""
        self._asks += 1
        if self._asks <= _FEW:
            at = lambda i: self._beginning(i, len(pattern))
            sp = bisect_left(range(len(self.sa)), pattern, key=at)
            return sp, bisect_right(range(len(self.sa)), pattern, lo=sp, key=at) - 1
        known = self._once("heads", self._heads)
        start = pattern[:_HEAD]
        low = int.from_bytes(start.ljust(_HEAD, b"\0") + bytes([len(start)]), "big")
        high = int.from_bytes(start.ljust(8, b"\xff"), "big")
        sp, ep = (int(np.searchsorted(known, np.uint64(v), side=s)) for v, s in ((low, "left"), (high, "right")))
        if len(pattern) > _HEAD and sp < ep:
            at = lambda i: self._beginning(i, len(pattern))
            sp, ep = sp + bisect_left(range(sp, ep), pattern, key=at), sp + bisect_left(range(sp, ep), True, key=lambda i: at(i) > pattern)
        return sp, ep - 1

    def _heads(self) -> np.ndarray:
        out = np.empty(len(self.sa), dtype=np.uint64)
        for i in range(0, len(out), _PIECE):
            at = self.sa[i : i + _PIECE]
            out[i : i + _PIECE] = heads(self.data, at, self.ends_of(at) - at)
        return out

    def _beginning(self, i: int, n: int) -> bytes:
        at = int(self.sa[i])
        return self.bytes[at : min(at + n, int(self.starts[np.searchsorted(self.starts, at, side="right")]))]


def _tree(raw: bytes, data: np.ndarray, sa: np.ndarray, starts: np.ndarray, da: np.ndarray, block_size: int) -> list[tuple[int, int, int, bool]]:
    """The nodes (sp, after ep, parent, leaf) of the tree of shared prefixes, parents first.

    A node of more than ``block_size`` suffixes is split by the first character that they don't share; suffixes that
    are equal to their ends stay together.
    """
    nodes, open_ = [(0, len(sa), -1, len(sa) <= block_size)], [0] if len(sa) > block_size else []
    while open_:
        number = open_.pop()
        a, b, parent, _ = nodes[number]
        first, last = sa[a], sa[b - 1]
        room = min(starts[da[a] + 1] - first, starts[da[b - 1] + 1] - last)
        depth = common(raw, int(first), int(last), int(room))
        symbols = []
        for i in range(a, b, _PIECE):
            j = min(i + _PIECE, b)
            at = sa[i:j] + depth
            symbols.append(np.where(at < starts[da[i:j] + 1], data[np.minimum(at, len(data) - 1)].astype(np.int16), -1))
        symbol = np.concatenate(symbols) if len(symbols) > 1 else symbols[0]
        cuts = [a, *(np.flatnonzero(symbol[1:] != symbol[:-1]) + a + 1).tolist(), b]
        if len(cuts) == 2:
            nodes[number] = (a, b, parent, True)
            continue
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            large = y - x > block_size
            if large:
                open_.append(len(nodes))
            nodes.append((x, y, number, not large))
    return nodes


def _before(da: np.ndarray, n_docs: int, more: int = 0) -> np.ndarray:
    """The place of the same document's suffix before, or -1; ``more`` is added."""
    out, last = np.empty(len(da), dtype=np.int32), np.full(n_docs, -1, dtype=np.int32)
    for i in range(0, len(da), _PIECE):
        part = da[i : i + _PIECE]
        by = np.argsort(part.astype(np.uint16) if n_docs <= 1 << 16 else part, kind="stable")
        doc = part[by]
        edge = np.ones(len(doc) + 1, dtype=bool)
        edge[1:-1] = doc[1:] != doc[:-1]
        by += i
        before = np.roll(by, 1)
        before[edge[:-1]] = last[doc[edge[:-1]]]
        out[by] = before + more
        last[doc[edge[1:]]] = by[edge[1:]]
    return out


def _leaf_sets(leaves: list[tuple[int, int]], da: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents and frequencies of leaves, which lie side by side and in order: where each begins, and both."""
    docs, tf, n, first = [], [], 0, np.zeros(len(leaves) + 1, dtype=np.int64)
    ends = np.array([b for _, b in leaves], dtype=np.int64)
    i, at = 0, 0
    while i < len(leaves):  # as many leaves as make a piece, one at least
        j = max(int(np.searchsorted(ends, at + _PIECE, side="right")), i + 1)
        part = da[at : ends[j - 1]]
        pair = np.repeat(np.arange(j - i), np.diff(ends[i:j], prepend=at)) * n_docs + part
        pair.sort()
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        leaf, doc = np.divmod(pair[head], max(n_docs, 1))
        docs.append(doc.astype(np.int32))
        tf.append(np.diff(np.append(head, len(pair))).astype(np.int32))
        first[i : j + 1] = n + np.searchsorted(leaf, np.arange(j - i + 1))
        n, i, at = n + len(head), j, int(ends[j - 1])
    none = np.zeros(0, dtype=np.int32)
    return first, np.concatenate([none, *docs]), np.concatenate([none, *tf])


def stored_nodes(nodes: list[tuple[int, int, int, bool]], da: np.ndarray, n_docs: int, factor: float) -> list[tuple[int, int, bool, np.ndarray | None, np.ndarray | None]]:
    """The nodes that are stored: (sp, ep, leaf, documents, frequencies), no sets where all documents are in one.

    From the bottom: a leaf is stored, and so is a node that holds all documents, or whose set is so much smaller than
    all that is stored right below it together; what isn't stored passes on what is stored below it.
    """
    below, out = [0] * len(nodes), []
    leaves = sorted((a, b, i) for i, (a, b, _, leaf) in enumerate(nodes) if leaf)
    number = {i: k for k, (_, _, i) in enumerate(leaves)}
    first, leaf_docs, leaf_tf = _leaf_sets([(a, b) for a, b, _ in leaves], da, n_docs)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, parent, leaf = nodes[i]
        if leaf:
            x, y = first[number[i]], first[number[i] + 1]
            docs, tf = leaf_docs[x:y], leaf_tf[x:y]
        elif b - a < n_docs:
            docs, tf = np.unique(da[a:b], return_counts=True)
        else:
            count = counts(da[a:b], n_docs)
            docs = np.flatnonzero(count).astype(np.int32)
            tf = count[docs].astype(np.int32)
        everywhere = len(docs) == n_docs
        if leaf or everywhere or below[i] > factor * len(docs):
            out.append((a, b - 1, leaf, *((None, None) if everywhere else (docs, tf))))
            below[i] = len(docs)
        if parent >= 0:
            below[parent] += below[i]
    return sorted(out, key=lambda n: (n[0], -n[1]))


def _built(number: int, ids: list[int], texts: list[bytes], p: Parameters, arrays: bool = False) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = b"".join(texts)
    data = padded(np.frombuffer(raw, dtype=np.uint8))
    sa = suffix_order(data, np.repeat(starts[1:].astype(np.int32 if len(raw) < 1 << 31 else np.int64), sizes))
    place = np.empty(len(sa), dtype=np.int32)
    for i in range(0, len(sa), _PIECE):
        place[sa[i : i + _PIECE]] = np.arange(i, min(i + _PIECE, len(sa)))
    firsts = np.sort(place[starts[:-1][sizes > 0]])
    samples = place[_sampled(starts)]
    del place
    bwt = np.empty(len(sa), dtype=np.uint8)
    for i in range(0, len(sa), _PIECE):
        bwt[i : i + _PIECE] = data[np.maximum(sa[i : i + _PIECE] - 1, 0)]
    bwt[firsts] = 0
    da = taken(np.repeat(np.arange(len(texts), dtype=np.int32), sizes), sa)
    stored = stored_nodes(_tree(raw, data, sa, starts, da, p.block_size), da, len(texts), p.factor)
    none = np.zeros(0, dtype=np.int32)
    node_sp, node_ep, leaf = ([n[k] for n in stored] for k in range(3))
    everywhere = [n[3] is None for n in stored]
    sets, tf = ([n[k] if n[k] is not None else none for n in stored] for k in (3, 4))
    laid = {}
    if arrays:
        before = _before(da, len(texts))
        has = np.flatnonzero(before >= 0)
        a, b = sa[has], sa[before[has]]
        ilcp = np.zeros(len(sa), dtype=np.int32)
        ilcp[has] = shared_bytes(data, a, b, starts[da[has] + 1] - np.maximum(a, b))
        laid = {"c": (before + 1).tobytes(), "ilcp": ilcp.tobytes()}
    del sa, da, stored
    row = {
        "shard": number, "doc_ids": ids, "starts": packed(starts, np.int64), "data": packed(data[: len(raw)], np.uint8), "bwt": packed(bwt, np.uint8), "firsts": packed(firsts), "samples": packed(samples),
        "node_sp": packed(node_sp), "node_ep": packed(node_ep), "node_leaf": packed(leaf, np.uint8), "node_all": packed(everywhere, np.uint8),
        "node_first": packed(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.int64), "node_docs": packed(np.diff(np.concatenate([none, *sets]), prepend=0)), "node_tf": packed(np.concatenate([none, *tf])), **laid,
    }
    kinds = {"shard": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def build(docs: DataFrame, parameters: Parameters | None = None, arrays: bool = True) -> DataFrame:
    """The index, one row a shard, made where the documents lie; write it (``load_or_build``) before asking it.

    ``arrays``: c and ilcp of all suffixes are laid out as well, 8 bytes for each byte of text; no query reads them.
    """
    p = parameters or Parameters()
    bound_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and held + len(text or b"") > p.shard_bytes:
                    yield _built(number, ids, texts, p, arrays)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc)
                texts.append(text or b"")
                held += len(texts[-1])
        if ids:
            yield _built(number, ids, texts, p, arrays)

    return docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary")).mapInArrow(shards, _SCHEMA + _ARRAYS if arrays else _SCHEMA)


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            yield Shard({n: v.values.to_numpy(zero_copy_only=False) if n == "doc_ids" else v.as_py() for n, v in row.items()})


def _rows(index: DataFrame, columns: list[str]) -> DataFrame:
    """What a way reads; a shard comes to Python by itself, whatever number of them a task has."""
    bound_batches(index.sparkSession)
    return index.select("shard", "doc_ids", "starts", "data", *columns)


def _asked(index: DataFrame, patterns: DataFrame, columns: list[str], schema: str, each: Callable[[Shard, int, bytes, int, int], dict | None], slice_chars: int) -> DataFrame:
    """Rows that ``each`` (shard, pattern's number, pattern, sp, ep) makes of every range that isn't empty."""
    rows = _rows(index, columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def with_words(words: Broadcast) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _loaded(batches):
                for word, numbers in words.value.items():
                    pattern = word.encode()
                    sp, ep = shard.range(pattern)
                    if sp <= ep:
                        found = each(shard, pattern, sp, ep)
                        n = len(next(iter(found.values())))
                        for number in numbers if n else ():
                            full = {"pattern_id": np.full(n, number, dtype=np.int64)} | found
                            yield pa.RecordBatch.from_pydict({k: pa.array(full[k]) for k in names})

        return rows.mapInArrow(ask, schema)

    return each_slice(index.sparkSession, slices(patterns, slice_chars), schema, with_words)


def ranges(index: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, shard, sp, ep) of the suffixes that begin with each pattern."""
    one = lambda shard, p, sp, ep: {"shard": np.array([shard.number]), "sp": np.array([sp]), "ep": np.array([ep])}
    return _asked(index, patterns, _SA, "pattern_id long, shard long, sp long, ep long", one, slice_chars)


def cover(shard: Shard, sp: int, ep: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The largest stored nodes inside a range, and the parts of it at its ends that only a larger leaf holds."""
    starts, ends, leaf = shard.column("node_sp"), shard.column("node_ep"), shard.column("node_leaf", np.uint8)
    nodes, parts, at = [], [], sp
    while at <= ep:
        i, j = np.searchsorted(starts, at, side="left"), np.searchsorted(starts, at, side="right")
        # Nodes that start here, the largest first.
        inside = i + np.flatnonzero(ends[i:j] <= ep)
        if inside.size:
            nodes.append(int(inside[0]))
            at = int(ends[inside[0]]) + 1
        else:
            # Inside a leaf, or in one that goes beyond the range.
            holder = j - 1 if i < j else i - 1
            while not (leaf[holder] and ends[holder] >= at):
                holder -= 1
            stop = min(ep, int(ends[holder]))
            parts.append((at, stop))
            at = stop + 1
    return nodes, parts


def counted(shard: Shard, sp: int, ep: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a range and how often each occurs, from the stored sets and the ends of the range."""
    nodes, parts = cover(shard, sp, ep)
    total = np.zeros(len(shard.ids), dtype=np.int64)
    first, docs, tf, everywhere = shard.column("node_first", np.int64), shard.node_docs, shard.column("node_tf"), shard.column("node_all", np.uint8)
    starts, ends = shard.column("node_sp"), shard.column("node_ep")
    for i in nodes:
        if everywhere[i]:  # the set is known without a list; frequencies are counted in the range
            parts.append((int(starts[i]), int(ends[i])))
        else:
            total[docs[first[i] : first[i + 1]]] += tf[first[i] : first[i + 1]]
    for a, b in parts:
        total += np.bincount(shard.doc_of(shard.sa[a : b + 1]), minlength=len(total))
    found = np.flatnonzero(total)
    return found, total[found]


def _union(shard: Shard, sp: int, ep: int) -> np.ndarray:
    """The documents of a range by stored sets; a node that holds all documents ends the search."""
    nodes, parts = cover(shard, sp, ep)
    first, docs, everywhere = shard.column("node_first", np.int64), shard.node_docs, shard.column("node_all", np.uint8)
    if any(everywhere[i] for i in nodes):
        return np.arange(len(shard.ids))
    sets = [docs[first[i] : first[i + 1]] for i in nodes] + [shard.doc_of(shard.sa[a : b + 1]) for a, b in parts]
    return np.unique(np.concatenate(sets))


def _by_way(by: str) -> Callable[[Shard, bytes, int, int], np.ndarray]:
    if by == "c":
        return lambda s, p, sp, ep: s.doc_of(s.sa[sp : ep + 1][s.c[sp : ep + 1] <= sp])
    if by == "ilcp":
        return lambda s, p, sp, ep: s.doc_of(s.sa[sp : ep + 1][s.ilcp(sp, ep, len(p)) < len(p)])
    return lambda s, p, sp, ep: _union(s, sp, ep) if by == "nodes" else np.unique(s.doc_of(s.sa[sp : ep + 1]))


def list_docs(index: DataFrame, patterns: DataFrame, by: str = "c", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, doc_id): each document that holds a pattern, once.

    by: "c" (the document's suffix before lies before the range), "ilcp" (less than the pattern is shared with it),
    "slice" (all documents of the range), "nodes" (stored sets of the range's cover, and its ends).
    """
    way = _by_way(by)
    return _asked(index, patterns, WAYS[by], "pattern_id long, doc_id long", lambda s, p, sp, ep: {"doc_id": s.documents(way(s, p, sp, ep))}, slice_chars)


def frequencies(index: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, doc_id, tf) from the frequencies of the stored sets."""

    def each(s: Shard, p: bytes, sp: int, ep: int) -> dict:
        docs, tf = counted(s, sp, ep)
        return {"doc_id": s.documents(docs), "tf": tf}

    return _asked(index, patterns, _NODES, "pattern_id long, doc_id long, tf long", each, slice_chars)


def suffixes_of(index: DataFrame, sp: int = 0, ep: int | None = None) -> DataFrame:
    """(shard, sa, doc_id, pos) of each shard's places from sp to ep; positions in bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _loaded(batches):
            at = s.sa[sp : None if ep is None else ep + 1]
            doc = s.doc_of(at)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(at), s.number)), "sa": pa.array(np.arange(sp, sp + len(at))), "doc_id": pa.array(s.documents(doc)), "pos": pa.array(at - s.starts[doc])})

    return _rows(index, _SA).mapInArrow(each, "shard long, sa long, doc_id long, pos long")


def nodes_of(index: DataFrame, mode: str = "set") -> DataFrame:
    """(shard, node, sp, ep, leaf, holds_all, n_docs, docs) of the stored nodes.

    mode: "set" (documents by id), "topk" (most frequent first, with frequencies), "count" (no lists). Nodes that hold
    all documents of their shard keep no list.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _loaded(batches):
            first, docs, tf, everywhere = s.column("node_first", np.int64), s.node_docs, s.column("node_tf"), s.column("node_all", np.uint8)
            lists = []
            for i in range(len(everywhere)):
                d, t = docs[first[i] : first[i + 1]], tf[first[i] : first[i + 1]]
                order = np.lexsort([s.ids[d], -t]) if mode == "topk" else np.argsort(s.ids[d], kind="stable")
                lists.append(None if everywhere[i] or mode == "count" else [{"doc_id": int(x), "tf": int(y)} for x, y in zip(s.ids[d][order], t[order], strict=True)])
            n = np.where(everywhere, len(s.ids), np.diff(first))
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(len(n), s.number)), "node": pa.array(np.arange(len(n))), "sp": pa.array(s.column("node_sp").astype(np.int64)), "ep": pa.array(s.column("node_ep").astype(np.int64)),
                "leaf": pa.array(s.column("node_leaf", np.uint8) > 0), "holds_all": pa.array(everywhere > 0), "n_docs": pa.array(n), "docs": pa.array(lists, kind),
            })

    return _rows(index, _NODES).mapInArrow(each, "shard long, node long, sp long, ep long, leaf boolean, holds_all boolean, n_docs long, docs array<struct<doc_id:long,tf:long>>")


def covers(index: DataFrame, patterns: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(pattern_id, shard, node, sp, ep): the cover of each pattern's range; node is -1 for a part of a leaf."""

    def each(s: Shard, p: bytes, sp: int, ep: int) -> dict:
        nodes, parts = cover(s, sp, ep)
        starts, ends = s.column("node_sp").astype(np.int64), s.column("node_ep").astype(np.int64)
        rows = [(i, starts[i], ends[i]) for i in nodes] + [(-1, a, b) for a, b in parts]
        node, a, b = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        return {"shard": np.full(len(rows), s.number), "node": node, "sp": a, "ep": b}

    return _asked(index, patterns, _NODES, "pattern_id long, shard long, node long, sp long, ep long", each, slice_chars)
