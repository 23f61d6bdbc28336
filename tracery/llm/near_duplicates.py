"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Documents with equal sets collapse into one. Shingles are ordered by
how many of these hold them (by powers of two, counted over all of them), rarest first; if two sets are similar
enough, their first quarters (prefixes) share a shingle, and a shingle that only one set has finds nothing. Sets with
the same prefix and size form a group that is joined as one.

Two groups that share a prefix shingle are a candidate pair if their sizes are near enough and if what follows the
shingle in both is enough for the overlap that is asked for. Only the pairs that can still join two components are
formed, as components are the result. Rounds of stars come first: of each shingle and class of sizes one group is the
centre (that with the shingle earliest, so that the unaltered text among altered copies is), and every group meets one
centre. Then all pairs that are left between groups of different components are formed, each once, expanded to their
members and verified. A verified pair compares the two whole sets. So thousands of near copies meet a centre each
rather than each other, and no link between different texts is lost.

Shingles are compared by 64-bit hashes of their words' 64-bit hashes.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer words than
a shingle has, the whole sequence is the only shingle; rows that repeat, with the same or a null id, are documents of
their own (a null id is never the component's id unless all its ids are null); identifiers are integers; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.blocks import QUESTION, answer, asked, block_table, bucket_order, buckets_for, in_order, met, parts_for, rows_at, texts_of
from tracery.llm.graphs import components
from tracery.llm.grid import SPACED, U64, Grid, mix
from tracery.llm.tables import HOT_KEYS, bucketed, join_on_hot_key, only_kept, written

WIDTH = 5
PERCENT = 75
_KEY_BYTES, _ID_BITS = 5, 24


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, shingle hash) pairs, by text, then hash."""
    grid = Grid(texts, SPACED, lower=True)
    at, hashes = grid.windows(width)
    text = grid.text_of[at]
    for n in range(1, width):
        short = np.flatnonzero(grid.n_words == n)
        if len(short):
            text = np.concatenate([text, short])
            hashes = np.concatenate([hashes, grid.sequence_hash(grid.first[short], n)])
    order = np.lexsort([hashes, text])
    text, hashes = text[order], hashes[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[fresh], hashes[fresh]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _describe(width: int):
    """Each document's place, size of set and a 128-bit hash of the set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, _ in texts_of(batches):
            text, hashes = shingles(texts, width)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            one, two = _sums(mix(hashes), bounds), _sums(mix(hashes ^ U64(0xA0761D6478BD642F)), bounds)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array((block >> 32 << 40) + ((block & 0xFFFF) << _ID_BITS) + np.arange(len(texts)), pa.int64()), "block": pa.array([block] * len(texts), pa.int64()), "doc_id": ids,
                "n": pa.array(np.diff(bounds), pa.int64()), "one": pa.array(one.view(np.int64), pa.int64()), "two": pa.array(two.view(np.int64), pa.int64()),
            })

    return each


def _kept(text: np.ndarray, hashes: np.ndarray, places: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a block's chosen documents."""
    use = np.isin(text, np.array(places or [], dtype=np.int64))
    return text[use], hashes[use]


def _distinct(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in the order asked, their counts, and the place of each hash among them."""
    distinct, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    order = bucket_order(distinct, buckets)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], count[order], place[which]


def _classes(keys: np.ndarray, extra: list[bytes]) -> np.ndarray:
    """How many sets hold each shingle, as the power of two below; 0 for one set."""
    _, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, weights=np.frombuffer(b"".join(extra), dtype="<u2"))
    return np.minimum(np.log2(total[which]), 63).astype(np.uint8)


@dataclass(frozen=True)
class Limits:
    """How the join is dealt; none of these changes its result."""

    #: Rounds of stars at most, and how many pairs a posting may be left with when the pairs that remain are filtered.
    rounds: int = 6
    pairs: int = 64
    #: Postings of a shingle that a task meets with the others; a shingle with more is salted.
    postings: int = 4096
    #: A key with one in so many of all rows goes by broadcast.
    hot_keys: int = HOT_KEYS


def _possible(n: Column, at: Column, other_n: Column, other_at: Column, percent: int) -> Column:
    """Whether two sets may be similar, judged by their sizes and the places of a shared shingle in their orders.

    At the first shingle that they share this bounds the overlap from above; at a later one it bounds less, and the
    pair was possible at the first if it is here.
    """
    sizes = (F.least(n, other_n) * 100 >= percent * F.greatest(n, other_n))
    return sizes & ((100 + percent) * F.least(n - at, other_n - other_at) >= percent * (n + other_n))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, hot_keys: int) -> DataFrame:
    """Of the pairs (x, y, rx, ry) those whose whole sets are similar enough.

    The sets lie in buckets by node and don't move to meet x; those of x move once to meet y. A y of very many pairs
    (there are at most ``hot_keys`` with as large a share) is dealt to several tasks.
    """
    pairs = written(pairs, "pairs")
    total = pairs.count()
    hot = pairs.groupBy("y").agg(F.count("*").alias("n")).filter(F.col("n") * hot_keys >= total).select("y", F.ceil(F.col("n") * hot_keys / total).cast("int").alias("k")) if total else None
    if hot is None:
        return pairs
    salted = pairs.join(F.broadcast(hot), "y", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("x"), "k"), F.lit(0))).drop("k")
    of = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("shingles").alias(f"s{name}"))
    left, right = salted.join(of("x"), "x"), salted.select("y", "salt").distinct().join(of("y"), "y")
    overlap = F.size(F.array_intersect("sx", "sy"))
    both = left.join(right.hint("shuffle_hash"), ["y", "salt"])
    return both.filter((100 + percent) * overlap >= percent * (F.col("nx") + F.col("ny"))).select("x", "y", "rx", "ry")


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """The state (node, g, n, root) with the components that the links join."""
    joined = written(components(links.select(F.col("rx").alias("u"), F.col("ry").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("to")), "joined")
    return written(state.join(joined, "root", "left").select("node", "g", "n", F.coalesce("to", "root").alias("root")), "state")


def _star(postings: DataFrame, state: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (x, y, rx, ry) of each set with one centre of another group and with one of its own."""
    order = lambda c: F.xxhash64(c, F.lit(turn))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + F.lit(turn % 2 / 2))
    heads = state.filter("node = g").select("g", "root")
    own = postings.join(heads, "g").withColumn("class", size_class)
    first = F.min(F.struct("at", order(F.col("g")).alias("order"), "g", "n", "root")).alias("c")
    centres = written(own.groupBy("token", "class").agg(first), "centres")
    met = own.join(centres, ["token", "class"]).filter((F.col("c.root") != F.col("root")) & _possible(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"), percent))
    of_group = met.groupBy("g").agg(F.min(F.struct("c.at", "c.order", F.col("c.g").alias("y"), F.col("c.root").alias("ry"))).alias("c")).select("g", "c.y", "c.ry")
    inside = state.groupBy("g").agg(F.count("*").alias("members"), F.min(F.struct(order(F.col("node")).alias("order"), "node", "root")).alias("c"))
    inside = inside.filter("members > 1").select("g", F.col("c.node").alias("y"), F.col("c.root").alias("ry"))
    centre = written(of_group.unionAll(inside), "centre")
    return state.select("g", F.col("node").alias("x"), F.col("root").alias("rx")).join(centre, "g").filter("rx != ry").select("x", "y", "rx", "ry")


def _open(postings: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Postings by component; the shingles that several components hold, with the largest; how many pairs they make."""
    cells = written(postings.join(state.groupBy("g", "root").agg(F.count("*").alias("size")), "g").select("token", "at", "n", "g", "root"), "cells")
    held = cells.groupBy("token", "root").agg(F.count("*").alias("c"))
    several = held.groupBy("token").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.max(F.struct("c", "root")).alias("main")).filter("kinds > 1")
    several = written(several.select("token", "total", F.col("main.root").alias("main"), ((F.col("total") - F.col("main.c")) * F.col("total")).alias("pairs")), "open")
    return cells, several, several.agg(F.sum(F.col("pairs").cast("double"))).first()[0] or 0


def _remaining(cells: DataFrame, several: DataFrame, state: DataFrame, percent: int, limits: Limits) -> DataFrame:
    """All pairs (x, y, rx, ry) of sets in different components that are left: filtered as groups, then expanded."""
    parts = F.ceil(F.col("total") / limits.postings).cast("int")
    here = cells.join(several.select("token", "main", parts.alias("parts")), "token")
    side = lambda df, name: df.select("token", "salt", *(F.col(c).alias(f"{c}{name}") for c in ("at", "n", "g", "root")), *(["main"] if name == "2" else []))
    few = side(here.filter("root != main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "1")
    all_ = side(here.withColumn("salt", F.pmod(F.hash("g", "root"), "parts")), "2")
    once = (F.col("root2") == F.col("main")) | (F.struct("g1", "root1") < F.struct("g2", "root2"))
    pairs = few.join(all_, ["token", "salt"]).filter((F.col("root1") != F.col("root2")) & once & _possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), percent))
    pairs = written(pairs.select("g1", "root1", "g2", "root2").distinct(), "group-pairs")
    of = lambda g, r, x, rx: state.select(F.col("g").alias(g), F.col("root").alias(r), F.col("node").alias(x), F.col("root").alias(rx))
    return pairs.join(of("g1", "root1", "x", "rx"), ["g1", "root1"]).join(of("g2", "root2", "y", "ry"), ["g2", "root2"]).select("x", "y", "rx", "ry")


def _components_of(sets: DataFrame, percent: int, limits: Limits) -> DataFrame:
    """(node, root) of the sets: the components that links between them make."""
    heads = written(sets.groupBy("prefix_key", "n").agg(F.min("node").alias("g"), F.count("*").alias("members")), "heads")
    state = written(sets.select("node", "prefix_key", "n").join(heads, ["prefix_key", "n"]).select("node", "g", "n", F.col("node").alias("root")), "state")
    own = sets.select("node", "n", "prefix", "at").join(heads.select(F.col("g").alias("node"), "members"), "node")
    own = own.select(F.col("node").alias("g"), "n", "members", F.explode(F.arrays_zip("prefix", "at")).alias("p")).select("g", "n", "members", F.col("p.prefix").alias("token"), F.col("p.at").alias("at"))
    shared = written(own.groupBy("token").agg(F.sum("members").alias("holders")).filter("holders > 1").select("token"), "shared")
    postings = written(own.join(shared, "token").select("token", "at", "g", "n"), "postings")
    n_postings = postings.count()
    if not n_postings:
        return state.select("node", "root")
    turn, idle = 0, 0
    while True:
        if turn < limits.rounds:
            links = written(_similar(_star(postings, state, percent, turn), sets, percent, limits.hot_keys), "links")
            idle = idle + 1 if links.isEmpty() else 0
            state = state if idle else _merged(state, links)
        cells, several, pairs = _open(postings, state)
        turn += 1
        if pairs <= limits.pairs * n_postings or idle > 1 or turn >= limits.rounds:  # the next turn has other classes of sizes
            break
    links = written(_similar(_remaining(cells, several, state, percent, limits), sets, percent, limits.hot_keys), "links")
    return _merged(state, links).select("node", "root")


def _linked(blocks: DataFrame, width: int, percent: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """All documents (node, block, doc_id, n, one, two); one row a distinct set, with its copies and its component's root."""
    with only_kept(blocks.sparkSession) as keep:
        seen, rooted = _joined(blocks, width, percent, limits)
        return keep(seen), keep(rooted)


def _joined(blocks: DataFrame, width: int, percent: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    seen = written(blocks.mapInArrow(_describe(width), "node long, block long, doc_id long, n long, one long, two long"), "sets")
    filled = seen.filter("n > 0")
    classes = written(filled.groupBy("n", "one", "two").agg(F.min(F.struct("node", "block")).alias("of"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "block")).alias("keeper")), "classes")
    places = classes.groupBy(F.col("of.block").alias("block")).agg(F.collect_list(F.col("of.node").bitwiseAND((1 << _ID_BITS) - 1)).alias("places"))
    chosen = written(places, "places")
    buckets = buckets_for(blocks, 1 / 6)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts, more in texts_of(batches):
            _, hashes = _kept(*shingles(texts, width), more["places"])
            distinct, count, _ = _distinct(hashes, buckets)
            if (question := asked(block, distinct, buckets, _KEY_BYTES, np.minimum(count, 65535).astype("<u2"))) is not None:
                yield question

    held = answer(met(blocks, chosen).mapInArrow(ask, QUESTION), _KEY_BYTES, _classes, "held")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts, more in texts_of(batches):
            text, hashes = _kept(*shingles(texts, width), more["places"])
            if not len(text):
                continue
            distinct, _, place = _distinct(hashes, buckets)
            rarity = in_order(more["held"])[place]
            order = np.lexsort([hashes, rarity, text])
            bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
            size = np.diff(bounds)
            length = size - (percent * size + 99) // 100 + 1
            nth = np.arange(len(text)) - np.repeat(bounds[:-1], size)
            inside = nth < np.repeat(length, size)
            prefix, rare = hashes[order], rarity[order]
            key = _sums(np.where(inside, mix(prefix), U64(0)), bounds)
            useful = inside & (rare > 0)
            total = np.concatenate([[0], np.cumsum(useful)])
            each = np.diff(total[bounds])
            some = np.flatnonzero(each)
            if some.size:
                here = np.repeat(each > 0, size)
                lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array((block >> 32 << 40) + ((block & 0xFFFF) << _ID_BITS) + text[bounds[some]], pa.int64()), "n": pa.array(size[some], pa.int64()), "prefix_key": pa.array(key[some].view(np.int64)),
                    "prefix": lists(each[some], prefix[useful].view(np.int64)), "at": lists(each[some], nth[useful].astype(np.int32)), "shingles": lists(size[some], hashes[here].view(np.int64)),
                })

    found = met(met(blocks, chosen), held).mapInArrow(prefixes, "node long, n long, prefix_key long, prefix array<long>, at array<int>, shingles array<long>")
    sets = bucketed(found, "sets", "node", parts_for(blocks))
    state = _components_of(sets, percent, limits)

    own = classes.select("n", "one", "two", "copies", "least", "keeper", F.col("of.node").alias("node"))
    return seen, written(own.join(state, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")


LIMITS = Limits()


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, limits: Limits = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    seen, rooted = _linked(block_table(docs, id_col, text_col), width, percent, limits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    named = join_on_hot_key(rooted, least, "root", "sets", limits.hot_keys)
    keyed = named.select(F.struct("one", "two", "n").alias("set"), "component_id", "copies")
    filled = seen.filter("n > 0").select("doc_id", "n", F.struct("one", "two", "n").alias("set"))
    done = join_on_hot_key(filled, keyed, "set", "copies", limits.hot_keys)
    alone = seen.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(alone)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, limits: Limits = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, whole rows, without near duplicates: of each component the row with the smallest id stays."""
    blocks = block_table(docs, id_col, text_col, whole_rows=True)
    seen, rooted = _linked(blocks, width, percent, limits)
    kept = rooted.groupBy("root").agg(F.min("keeper").alias("k")).select("k.node", "k.block").unionAll(seen.filter("n = 0").select("node", "block"))
    places = kept.groupBy("block").agg(F.collect_list(F.col("node").bitwiseAND((1 << _ID_BITS) - 1)).alias("places"))
    return rows_at(blocks, places, docs, id_col, text_col)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    return near_duplicate_classes(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (
  select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
x as materialized (
  select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as materialized (
  select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
y as materialized (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id least from n union select y.b, r.least from r join y on y.a = r.doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, d.doc_id) component_id
  from d left join n using (doc_id) left join (select doc_id, min(least) c from r group by 1) using (doc_id)
"""
