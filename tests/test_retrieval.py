"""Known results for small collections, and random collections against brute force."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracery.functions import text as fn
from tracery.operators import postings, ranking, search, sets, shards, statistics, suffixes
from tracery.sources.collection import pattern_set
from tracery.sources.workspace import index_of
from tracery.streaming.listing import list_stream

THREE = [(1, "TATA"), (2, "LATA"), (3, "AAAA")]


def docs_of(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def patterns_of(spark, words):
    return pattern_set(spark.createDataFrame(list(enumerate(words)), "pattern_id long, pattern string"))


def brute(texts, words):
    out = {}
    for p, w in enumerate(words):
        for d, t in texts:
            n = sum(t.startswith(w, i) for i in range(len(t))) if t and w else 0
            if n:
                out[p, d] = n
    return out


@pytest.mark.parametrize(
    ("text", "delimiter", "border"),
    [("TATA$LATA$AAAA$", "$", [0, 0, 0, 0, 1] * 3), ("TATA$LATA$AAAA$", "T", [1, 0, 1, 0, 0, 0, 0, 1] + [0] * 7), ("TATA$LATA$AAAA$", "X", [0] * 15), ("", "X", [])],
)
def test_borders(spark, text, delimiter, border):
    found = suffixes.doc_borders(docs_of(spark, [(1, text)]), delimiter).orderBy("pos").collect()
    assert [r["border"] for r in found] == border


@pytest.mark.parametrize(("delimiter", "da"), [("$", [4, 3, 2, 1, 3, 2, 1, 3, 3, 3, 2, 1, 2, 2, 1, 1]), ("X", [1] * 16)])
def test_delimited_doc_array(spark, delimiter, da):
    found = suffixes.delimited_doc_array(docs_of(spark, [(1, "TATA$LATA$AAAA$")]), delimiter).orderBy("sa").collect()
    assert [r["da"] for r in found] == da


def test_delimited_doc_array_of_odd_texts(spark):
    texts = [(1, "ab$é$$ab"), (2, ""), (3, None), (4, "a" * 3000 + "$" + "a" * 10), (5, "漢$字$😀")]
    got = {}
    for d, sa, da in rows(suffixes.delimited_doc_array(docs_of(spark, texts), "$")):
        got.setdefault(d, []).append(da)
    for d, t in texts:
        if t is not None:
            order = sorted(range(len(t) + 1), key=lambda i, t=t: t[i:])
            assert got[d] == [t[:i].count("$") + 1 for i in order]
    assert set(got) == {1, 2, 4, 5}


@pytest.mark.parametrize("strategy", ["literals", "automaton"])
def test_known_listings(spark, strategy):
    words = ["TA", "A", "LT", "AA", "TATA", ""]
    docs, patterns = docs_of(spark, THREE), patterns_of(spark, words)
    listed = {}
    for p, d in rows(search.list_docs(docs, patterns, strategy=strategy)):
        listed.setdefault(words[p], []).append(d)
    assert listed == {"TA": [1, 2], "A": [1, 2, 3], "AA": [3], "TATA": [1]}
    assert rows(search.occurrence_count(docs, patterns, strategy=strategy)) == [(0, 3), (1, 8), (2, 0), (3, 3), (4, 1)]
    assert rows(search.doc_count(docs, patterns, strategy=strategy))[2] == (2, 0)
    found = search.frequencies(docs, patterns, strategy=strategy)
    assert rows(ranking.top_k(found.filter("pattern_id = 1"), 2), "doc_id", "tf") == [(1, 2), (3, 4)]
    assert ranking.top_k(found, 0).count() == 0


def test_terms_and_masks(spark):
    docs = docs_of(spark, THREE)
    found = search.frequencies(docs, patterns_of(spark, ["TA", "L"])).withColumnRenamed("pattern_id", "term")
    scores = ranking.scored(found, ranking.inverse_frequencies(found, 3))
    merged = ranking.merged_scores(scores.unionAll(scores.limit(0)))
    assert rows(ranking.with_all(merged, 3), "doc_id") == [(2,)]
    twice = ranking.merged_scores(scores.unionAll(scores))  # repeated rows keep the masks
    assert rows(twice, "doc_id", "terms") == [(1, 1), (2, 3)]
    assert [r["doc_id"] for r in ranking.best(merged, 2).collect()] == [2, 1]


def test_topic_terms(spark):
    lines = [("7:a b", ["a", "b"]), ("7: a  b ", ["", "a", "", "b"]), ("a b", []), ("7:", []), ("9:a:b c", ["a:b", "c"])]
    found = spark.createDataFrame([(t,) for t, _ in lines], "q string").select(fn.topic_terms(F.col("q"))).collect()
    assert [r[0] for r in found] == [terms for _, terms in lines]


def test_occurrences_of_odd_patterns(spark):
    cases = [("AAAA", "AA", 3), ("a\\Eb\\Eb", "\\Eb", 2), ("a.b.c", ".", 2), ("éééé", "éé", 3), ("x", "", 0), (r"\Q\E", r"\Q", 1), ("a$1a$1", "$1", 2)]
    df = spark.createDataFrame(cases, "t string, p string, n long")
    assert [r[0] for r in df.select(fn.occurrences(F.col("t"), F.col("p"))).collect()] == [n for _, _, n in cases]


def test_random_collections(spark):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(60)] + [(60, None), (61, "a" * 5000)]
    words = ["a", "b", "ab", "aa", "é", "éa", "abab", "a b", "zz", "aaaaaa", "b é a"] + ["".join(rng.choice("abé ") for _ in range(4)) for _ in range(20)] + ["a"]
    docs, patterns = docs_of(spark, texts), patterns_of(spark, words)
    truth = brute(texts, words)
    expected = [(p, d, n) for (p, d), n in sorted(truth.items())]
    assert rows(search.frequencies(docs, patterns, strategy="automaton")) == expected
    assert rows(search.frequencies(docs, patterns, slice_chars=10, strategy="automaton")) == expected
    pairs = sorted(truth)
    assert rows(postings.list_docs_indexed(docs, postings.gram_index(docs, 3), patterns, 3)) == pairs
    located = rows(search.locate(docs, patterns))
    assert len(located) == sum(truth.values())
    assert all(texts[d][1].startswith(words[p], i) for p, d, i in located)
    short = docs.filter("length(text) < 100")
    table = suffixes.with_previous(suffixes.suffix_table(short)).cache()
    some = [x for x in pairs if len(texts[x[1]][1]) < 100]
    assert rows(suffixes.list_by_previous(table, patterns)) == some
    assert rows(suffixes.list_by_ilcp(table, patterns)) == some
    ordered = table.orderBy("sa").collect()
    assert [r["sa"] for r in ordered] == list(range(len(ordered)))
    assert [(r["key"], r["doc_id"], r["pos"]) for r in ordered] == sorted((t[i : i + 64], d, i) for d, t in texts if t and len(t) < 100 for i in range(len(t)))
    runs = suffixes.ilcp_runs(table).orderBy("first").collect()
    assert [r["value"] for r in runs for _ in range(r["size"])] == [r["ilcp"] for r in ordered]
    counted = rows(search.doc_count(docs, patterns))
    totals = rows(search.occurrence_count(docs, patterns))
    assert all(n <= m for (_, n), (_, m) in zip(counted, totals, strict=True))
    five = {(p, r): d for p, d, r in rows(ranking.top_k(search.frequencies(docs, patterns), 5), "pattern_id", "doc_id", "rank")}
    assert all(five[k] == d for k, d in {(p, r): d for p, d, r in rows(ranking.top_k(search.frequencies(docs, patterns), 3), "pattern_id", "doc_id", "rank")}.items())


def test_suffixes_agreeing_on_many_characters(spark):
    passage = "abcdefghij" * 20
    texts = [(1, passage + "z"), (2, "x" + passage + "y"), (3, passage), (4, "y" + passage[1:] + "y")]
    table = suffixes.with_previous(suffixes.suffix_table(docs_of(spark, texts))).cache()
    order = sorted((t[i:], d, i) for d, t in texts for i in range(len(t)))
    assert [(r["key"], r["doc_id"], r["pos"]) for r in table.orderBy("sa").collect()] == order
    last, expected = {}, []
    for sa, (key, d, _) in enumerate(order):
        before = last.get(d, (-1, ""))
        expected.append((sa, before[0] + 1, next((k for k, (a, b) in enumerate(zip(key, before[1], strict=False)) if a != b), min(len(key), len(before[1])))))
        last[d] = sa, key
    assert rows(table, "sa", "c", "ilcp") == expected
    words = [passage, passage[1:] + "y", passage + "z", passage[10:] + "q", passage[5:175]]
    some = sorted(brute(texts, words))
    patterns = patterns_of(spark, words)
    assert rows(suffixes.list_by_previous(table, patterns)) == some
    assert rows(suffixes.list_by_ilcp(table, patterns)) == some
    assert {r["pattern_id"] for r in suffixes.ranges(table, patterns).collect()} == {p for p, _ in some}


def odd_collection(seed=11):
    """Repeats, copies, long shared passages, bytes of all kinds, null and empty texts."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(40)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts += [passage, passage + "x", "y" + passage, passage, "a" * 3000, "a" * 2999, "ab" * 700, None, "", "\0", "a\0", "a", "\0\0a", "漢字😀漢字"]
    return list(enumerate(texts)), ["a", "b", "ab", "aa", "é", "éa", "abab", "a b", "zz", "a" * 200, "a" * 2999, "b é a", passage, passage[100:] + "x", passage[3:90], "\0", "a\0", "字😀", "", "ab" * 350 + "x"] + ["".join(rng.choice("abé ") for _ in range(9)) for _ in range(20)]


@pytest.mark.parametrize("parameters", [shards.Parameters(), shards.Parameters(2000, 4, 1.2), shards.Parameters(1, 16, 0.0), shards.Parameters(10**6, 3, 3.0)])
def test_shards_list_as_brute_force(spark, tmp_path, parameters):
    texts, words = odd_collection()
    docs, patterns = docs_of(spark, texts), patterns_of(spark, words)
    shards.build(docs.repartition(3), parameters).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    truth = brute(texts, words)
    for way in shards.WAYS:
        assert rows(shards.list_docs(index, patterns, way)) == sorted(truth), way
    assert rows(shards.list_docs(index, patterns, "nodes", slice_chars=10)) == sorted(truth)
    expected = [(p, d, n) for (p, d), n in sorted(truth.items())]
    assert rows(shards.frequencies(index, patterns)) == expected
    found = shards.ranges(index, patterns).groupBy("pattern_id").agg(F.sum(F.col("ep") - F.col("sp") + 1).alias("n"))
    totals = {}
    for p, _, n in expected:
        totals[p] = totals.get(p, 0) + n
    assert dict(rows(found)) == totals
    assert shards.list_docs(index, patterns_of(spark, [])).count() == 0
    covers = rows(shards.covers(index, patterns), "pattern_id", "shard", "sp", "ep")
    spans = {(p, s): [] for p, s, _, _ in covers}
    for p, s, a, b in covers:
        spans[p, s].append((a, b))
    for p, s, sp, ep in rows(shards.ranges(index, patterns)):
        at = sp
        for a, b in sorted(spans[p, s]):
            assert a == at
            at = b + 1
        assert at == ep + 1


def test_shards_keep_the_order_of_suffixes(spark):
    texts, _ = odd_collection()
    index = shards.build(docs_of(spark, texts).coalesce(1), shards.Parameters(10**6)).cache()
    raw = {d: (t or "").encode() for d, t in texts}
    order = sorted((raw[d][i:], d, i) for d in raw for i in range(len(raw[d])))
    assert rows(shards.suffixes_of(index), "sa", "doc_id", "pos") == [(k, d, i) for k, (_, d, i) in enumerate(order)]
    assert rows(shards.suffixes_of(index, 10, 30), "sa", "doc_id", "pos") == [(k, d, i) for k, (_, d, i) in enumerate(order)][10:31]
    row = index.first()
    last, c, shared = {}, [], []
    for sa, (suffix, d, _) in enumerate(order):
        before = last.get(d, (-1, b""))
        c.append(before[0] + 1)
        shared.append(next((k for k, (a, b) in enumerate(zip(suffix, before[1], strict=False)) if a != b), min(len(suffix), len(before[1]))))
        last[d] = sa, suffix
    assert np.frombuffer(row["c"], np.int32).tolist() == c
    assert np.frombuffer(row["ilcp"], np.int32).tolist() == shared


def test_shards_cost_little_more_than_their_texts_and_come_one_by_one(spark):
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "and", "cats"]
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(60)]
    session = spark.newSession()
    index = shards.build(docs_of(session, texts).coalesce(1), shards.Parameters(20_000), arrays=False).cache()
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"  # not all shards of a task at once
    n = len(shards._SCHEMA.split(", "))
    assert index.count() > 3 and len(index.columns) == n
    held = sum(len(r[c]) for r in index.collect() for c in index.columns if c not in ("shard", "doc_ids"))
    assert held < 3 * sum(len(t) for _, t in texts)
    plain = sorted((t[i:], d, i) for d, t in texts[:20] for i in range(len(t)))
    whole = shards.build(docs_of(session, texts[:20]).coalesce(1), arrays=False)
    assert rows(shards.suffixes_of(whole), "sa", "doc_id", "pos") == [(k, d, i) for k, (_, d, i) in enumerate(plain)]


def test_many_patterns_are_looked_up_as_few_are(spark, monkeypatch):
    texts, words = odd_collection()
    index = shards.build(docs_of(spark, texts), shards.Parameters(2000), arrays=False).cache()
    few = rows(shards.list_docs(index, patterns_of(spark, words), "ilcp"))
    held = next(shards._loaded(iter([shards._built(0, *zip(*((d, (t or "").encode()) for d, t in texts), strict=True), shards.Parameters())])))
    for w in filter(None, words):
        held._asks = 0
        one = held.range(w.encode())
        held._asks = shards._FEW
        assert held.range(w.encode()) == one
    assert few == sorted(brute(texts, words))


@pytest.mark.parametrize("piece", [1, 7, 200])
def test_shards_made_by_pieces_are_the_same(monkeypatch, piece):
    texts, words = odd_collection()
    raw = [(t or "").encode()[:700] for _, t in texts]
    p = shards.Parameters(10**6, 16, 2.0)
    whole = shards._built(0, list(range(len(raw))), raw, p, True)
    plain = sorted((raw[d][i:], d, i) for d in range(len(raw)) for i in range(len(raw[d])))
    monkeypatch.setattr(shards, "_PIECE", piece)
    assert shards._built(0, list(range(len(raw))), raw, p, True).equals(whole)
    held = next(shards._loaded(iter([whole])))
    starts = np.cumsum([0, *map(len, raw)])
    assert held.sa.tolist() == [int(starts[d]) + i for _, d, i in plain]
    assert held.c.tolist() == np.frombuffer(whole.column(whole.schema.get_field_index("c"))[0].as_py(), np.int32).tolist()
    monkeypatch.setattr(shards, "_FEW", 0)
    for w in filter(None, words):
        sp, ep = held.range(w.encode())
        assert ep - sp + 1 == sum(s.startswith(w.encode()) for s, _, _ in plain)


def test_a_shard_is_built_and_asked_in_little_memory():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(2500)).encode() for _ in range(200)]
    n = sum(map(len, texts))

    def most(what):
        tracemalloc.start()
        try:
            out = what()
            return tracemalloc.get_traced_memory()[1] / n, out
        finally:
            tracemalloc.stop()

    held, built = most(lambda: shards._built(0, list(range(200)), texts, shards.Parameters()))
    assert held < 45

    def ask():
        shard = next(shards._loaded(iter([built])))
        return len(shard.c) + len(shard.sa)

    held, found = most(ask)
    assert found == 2 * n and held < 32


def test_shared_bytes_of_two_suffixes():
    rng = random.Random(9)
    for _ in range(3000):
        raw = b"ab" * rng.randint(0, 200) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) + b"ab" * rng.randint(0, 99)
        a, b = rng.randint(0, len(raw)), rng.randint(0, len(raw))
        room = rng.randint(0, len(raw) - max(a, b))
        assert shards.common(raw, a, b, room) == next((i for i in range(room) if raw[a + i] != raw[b + i]), room)


def test_a_text_of_one_repeated_line_is_no_slower_to_build(spark):
    line, began = "the same line of some words again\n" * 6000, time.perf_counter()
    shards._built(0, [1], [line.encode()], shards.Parameters(block_size=8))
    assert time.perf_counter() - began < 20


def plain_nodes(texts, block_size, factor):
    """Stored nodes by a tree of prefixes, made and pruned recursively."""
    raw = {d: (t or "").encode() for d, t in texts}
    order = sorted((raw[d][i:], d, i) for d in raw for i in range(len(raw[d])))
    out = []

    def visit(a, b, depth):
        """What is stored below: a number of documents."""
        docs = {d for _, d, _ in order[a:b]}
        everywhere = len(docs) == len(raw)
        children = []
        if b - a > block_size:
            while len({s[depth : depth + 1] for s, _, _ in order[a:b]}) == 1 and order[a][0][depth : depth + 1]:
                depth += 1
            cuts = [a] + [i for i in range(a + 1, b) if order[i][0][depth : depth + 1] != order[i - 1][0][depth : depth + 1]] + [b]
            children = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(cuts) > 2 else []
        below = sum(visit(x, y, depth) for x, y in children)
        if not children or everywhere or below > factor * len(docs):
            out.append((a, b - 1, not children, everywhere, len(docs)))
            return len(docs)
        return below

    visit(0, len(order), 0)
    return sorted(out)


@pytest.mark.parametrize(("block_size", "factor"), [(4, 1.5), (2, 3.0), (16, 1.0), (512, 4.0)])
def test_stored_nodes_equal_plain_ones(spark, block_size, factor):
    texts = [t for t in odd_collection()[0] if t[1] and len(t[1]) < 600]
    index = shards.build(docs_of(spark, texts).coalesce(1), shards.Parameters(10**6, block_size, factor)).cache()
    assert rows(shards.nodes_of(index, "count"), "sp", "ep", "leaf", "holds_all", "n_docs") == plain_nodes(texts, block_size, factor)
    by_id, by_tf = (shards.nodes_of(index, mode).filter("not holds_all").collect() for mode in ("set", "topk"))
    for a, b in zip(sorted(by_id, key=lambda r: r["node"]), sorted(by_tf, key=lambda r: r["node"]), strict=True):
        assert [d["doc_id"] for d in a["docs"]] == sorted(d["doc_id"] for d in a["docs"]) and sum(d["tf"] for d in a["docs"]) == a["ep"] - a["sp"] + 1
        assert b["docs"] == sorted(a["docs"], key=lambda d: (-d["tf"], d["doc_id"]))


def test_indexes_are_built_once_and_follow_their_source(spark, tmp_path):
    source, built = str(tmp_path / "docs"), []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    docs_of(spark, THREE).write.parquet(source)
    for _ in range(2):
        assert index_of(spark, source, "tested", build).count() == 3
    docs_of(spark, THREE + [(4, "more")]).write.mode("overwrite").parquet(source)
    assert index_of(spark, source, "tested", build).count() == 4 and len(built) == 2
    assert index_of(spark, source, "tested", build, "other").count() == 4 and len(built) == 3


def test_runs_of_documents(spark):
    docs = spark.createDataFrame([(i,) for i in (3, 4, 5, 9, 11, 12, 3)], "doc_id long")
    assert rows(sets.runs_of(docs)) == [(3, 3), (9, 1), (11, 2)]
    assert sets.runs_of(docs.limit(0)).count() == 0


def test_posting_lists_come_in_parts(spark):
    docs = docs_of(spark, [(i, "abcdefg") for i in range(25)])
    lists = rows(postings.posting_lists(postings.sorted_index(docs, 5), 10))
    assert len(lists) == 3 * (7 + 6 + 5 + 4 + 3) and lists[0][1:] == (0, list(range(10))) and lists[2][1:] == (2, list(range(20, 25)))


def test_gram_blocks_list_as_brute_force_and_shuffle_no_pairs(spark, monkeypatch):
    texts, words = odd_collection()
    docs, patterns = docs_of(spark, texts), patterns_of(spark, words)
    plan = postings.block_index(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Repartition" not in plan
    index = postings.block_index(docs).cache()
    assert index.count() > 3
    assert rows(postings.list_docs_in_blocks(index, patterns)) == sorted(brute(texts, words))
    assert rows(postings.list_docs_in_blocks(index, patterns, slice_chars=10)) == sorted(brute(texts, words))
    raw = {d: (t or "").encode() for d, t in texts}
    held = {}
    for d in sorted(raw):
        for g in {raw[d][i : i + 5] for i in range(len(raw[d]) - 4)}:
            held.setdefault((int.from_bytes(g, "big"), d // 40), []).append(str(d))
    counts = {}
    for (g, _), found in held.items():
        counts[g] = counts.get(g, 0) + len(found)
    assert rows(postings.document_counts(index), "gram", "n_docs") == sorted(counts.items())
    whole = list(postings._lists(0, list(raw), list(raw.values())))
    monkeypatch.setattr(postings, "_RUN_BYTES", 500)  # several passes over a part, by runs of documents
    in_passes = list(postings._lists(0, list(raw), list(raw.values())))
    assert sorted(r for b in in_passes for r in map(repr, b.to_pylist())) == sorted(r for b in whole for r in map(repr, b.to_pylist())) and len(in_passes) > 2
    assert rows(postings.dumped_lists(docs, 40)) == sorted((g, p, ",".join(found)) for (g, p), found in held.items())


def test_nodes_hold_all_or_list(spark):
    table = suffixes.suffix_table(docs_of(spark, THREE))
    nodes = {r["prefix"]: r for r in suffixes.prefix_nodes(table, 2, 3).collect()}
    assert nodes["A"]["holds_all"] and nodes["A"]["docs"] is None and nodes["A"]["n_docs"] == 3
    assert [tuple(d) for d in nodes["TA"]["docs"]] == [(1, 2), (2, 1)]


def test_runs_of_frequencies(spark):
    nodes = suffixes.prefix_nodes(suffixes.suffix_table(docs_of(spark, THREE)), 2, 3)
    lists = nodes.filter("not holds_all")
    assert rows(suffixes.frequency_runs(lists).filter("prefix = 'TA'"), "nth", "tf", "size") == [(1, 2, 1), (2, 1, 1)]
    assert rows(suffixes.frequency_runs(lists, True).filter("prefix = 'TA'"), "nth", "tf", "size") == [(1, 2, 1), (2, 1, 1)]
    assert ("A", 3) in rows(suffixes.node_counts(nodes))
    with pytest.raises(Exception, match="no frequencies"):
        suffixes.frequency_runs(nodes).collect()


def test_sets_and_lists(spark):
    docs = docs_of(spark, THREE)
    lists = search.lists_by_pattern(search.list_docs(docs, patterns_of(spark, ["TA", "LT"])), patterns_of(spark, ["TA", "LT"]))
    assert rows(lists, "pattern", "docs") == [("LT", []), ("TA", [1, 2])]
    one, two = (search.list_docs(docs, patterns_of(spark, [w])) for w in ("TA", "AA"))
    assert rows(sets.union(one, two)) == [(1,), (2,), (3,)]
    assert rows(sets.intersection(one, search.list_docs(docs, patterns_of(spark, ["L"])))) == [(2,)]
    assert rows(sets.expanded_runs(spark.createDataFrame([(3, 2), (9, 0), (7, 1)], "first long, size long"))) == [(3,), (4,), (7,)]
    assert statistics.benchmark_totals(docs, patterns_of(spark, ["TA", "LT"])).first().asDict() == {"n_patterns": 2, "n_found": 1, "n_listed": 2, "n_occurrences": 3}
    assert rows(search.extract(docs, 2)) == [(2, "LATA")]
    assert "2 documents/s" in statistics.report("x", 1.0, 1, 2, 10, 10)


def test_empty_collections_and_patterns(spark):
    docs, none = docs_of(spark, []), patterns_of(spark, [])
    some = patterns_of(spark, ["a"] * 20)
    assert search.frequencies(docs, some).count() == 0
    assert search.frequencies(docs_of(spark, THREE), none).count() == 0
    assert search.locate(docs_of(spark, THREE), none).count() == 0
    assert rows(search.doc_count(docs, some))[0] == (0, 0)
    assert suffixes.suffix_table(docs).count() == 0


def test_stream(spark, tmp_path):
    docs_of(spark, THREE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = list_stream(stream, patterns_of(spark, ["TA"])).writeStream.format("memory").queryName("listed").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("listed"), "doc_id", "tf") == [(1, 2), (2, 1)]
    finally:
        q.stop()


def test_nodes_counted_in_texts_equal_those_of_the_suffix_table(spark):
    rng = random.Random(21)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 2, 3, 9, 30])))) for i in range(90)] + [(500, None), (-7, "aaa"), (1000, "漢字😀")]
    docs = docs_of(spark, texts).repartition(3)
    for n_docs, least in ((len(texts), 1), (2, 4)):
        nodes = suffixes.prefix_nodes(suffixes.suffix_table(docs), 3, n_docs, least).cache()
        shown = nodes.withColumn("docs", F.expr("array_join(transform(docs, d -> concat_ws(':', d.doc_id, d.tf)), ' ')"))
        columns = ("prefix", "sp", "ep", "n_docs", "holds_all", "docs")
        new = suffixes.listed_nodes(docs, 3, n_docs, least)
        assert rows(new, *columns) == rows(shown, *columns)
    nodes = suffixes.prefix_nodes(suffixes.suffix_table(docs), 3, 2).cache()
    frequencies = suffixes.prefix_frequencies(docs, 3).cache()
    for differences in (False, True):
        assert rows(suffixes.counted_frequency_runs(frequencies, 2, differences)) == rows(suffixes.frequency_runs(nodes.filter("not holds_all"), differences))
    assert rows(suffixes.node_counts(suffixes.counted_nodes(frequencies))) == rows(suffixes.node_counts(nodes))
