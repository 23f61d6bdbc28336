"""Word windows: decontamination, substring dedup, near duplicates and quality rules against plain versions."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import docs_of, found
from tracery.llm import blocks, decontamination, grid, near_duplicates, quality, substrings
from tracery.llm.graphs import components
from tracery.llm.near_duplicates import Limits
from tracery.llm.tables import only_kept, written

SPACED, PLAIN = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACED, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def corpus(seed, n=60, vocabulary=400, most=80):
    """Random texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    sentence = lambda k: [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(k)]
    passage, texts = sentence(20), []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            t = rng.choice(texts)
        elif texts and kind < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 3)):
                if t:
                    t[rng.randrange(len(t))] = "edited"
        else:
            t = sentence(rng.randrange(0, most))
            if rng.random() < 0.4:
                t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        texts.append(t)
    joins = [" ", "\n", "  ", "\t"]
    return ["".join(w + rng.choice(joins) for w in t) for t in texts]


def test_words_and_hashes(odd_texts):
    for letters, pattern, lower in ((grid.SPACED, SPACED, False), (grid.PLAIN, PLAIN, True)):
        g = grid.Grid(pa.array(odd_texts, pa.string()), letters, lower)
        for i, t in enumerate(odd_texts):
            own = [bytes(g.data[g.starts[k] : g.ends[k]]).decode() for k in range(g.first[i], g.first[i + 1])]
            assert own == words(t, pattern, lower)
    many = pa.array(["a" * n for n in range(1, 600)] + ["b"], pa.string())
    assert len(set(grid.Grid(many).hashes.tolist())) == 600


def test_runs_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in range(50)] + [None, ""])})
    cut = list(grid.runs(iter([batch]), limit=100))
    assert len(cut) > 5 and pa.Table.from_batches(cut).column("text").to_pylist() == batch.column(0).to_pylist()
    assert list(grid.runs(iter([batch.slice(0, 0)]))) == []


def plain_decontamination(docs, items, window=8):
    patterns = {}
    for item, text in items:
        w = words(text, PLAIN, True)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text, PLAIN, True)
        hit, seen = set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in patterns:
                    hit |= set(range(i, i + m))
                    seen |= patterns[p]
        out.append((doc, len(w), len(hit), sorted(str(s) for s in seen if s is not None)))
    return out


@pytest.mark.parametrize("set_bytes", [1 << 20, 60])
def test_decontamination(spark, odd_texts, set_bytes):
    texts = corpus(1) + odd_texts + ["one two three"]
    ids = [*range(len(texts) - 2), None, 3]
    items = [(i, " ".join(words(t)[5:20])) for i, t in enumerate(corpus(1)[:12])] + [(50, "One, two"), (51, None), (None, "x"), (50, "three"), (52, "edited")]
    docs = docs_of(spark, texts, ids)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_benchmark_passages(docs, bench, set_bytes=set_bytes)
    expected = plain_decontamination(list(zip(ids, texts, strict=True)), items)
    assert sorted(map(str, found(got, "doc_id", "n_words", "n_hit", "items"))) == sorted(map(str, expected))
    assert all(r["contaminated"] == (r["n_items"] >= 2) == (len(r["items"]) >= 2) for r in got.collect())
    kept = decontamination.without_contaminated(docs, bench, set_bytes=set_bytes)
    whole = plain_decontamination(list(zip(ids, texts, strict=True)), [i for i in items if len(words(i[1], PLAIN)) >= 8 and i[0] is not None])
    assert kept.columns == docs.columns and 0 < kept.count() == sum(not e[3] for e in whole) < len(texts)
    both = decontamination.without_contaminated(docs, bench, min_items=2, set_bytes=set_bytes)
    assert both.count() == sum(len(e[3]) < 2 for e in whole)
    assert decontamination.digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()


def test_words_with_equal_hashes_are_told_apart(spark):
    one, other = "abcdefghlb5nzjv5", "6xxf7wyxs4vcn7o6"
    assert len(set(grid.Grid(pa.array([one, other])).hashes.tolist())) == 1
    around = "a b c d {} e f g"
    docs = docs_of(spark, [around.format(one), around.format(other), around.format("x")])
    bench = spark.createDataFrame([(7, around.format(other)), (8, around.format(one))], "item_id long, text string")
    got = decontamination.find_benchmark_passages(docs, bench)
    assert found(got, "doc_id", "n_hit", "items") == [(0, 8, ["8"]), (1, 8, ["7"]), (2, 0, [])]
    some = decontamination.find_benchmark_passages(docs, bench.filter("item_id = 7"))
    assert found(some, "doc_id", "n_hit") == [(0, 0), (1, 8), (2, 0)]
    long = ["x" * 300 + c for c in "ab"]
    got = decontamination.find_benchmark_passages(docs_of(spark, long), spark.createDataFrame([(1, long[0])], "item_id long, text string"))
    assert found(got, "doc_id", "n_hit") == [(0, 1), (1, 0)]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(decontamination.find_benchmark_passages(docs_of(spark, ["a b", None]), none), "n_items", "contaminated") == [(0, False), (0, False)]
    assert decontamination.find_benchmark_passages(docs_of(spark, []), none).count() == 0


def plain_substrings(docs, k):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - k + 1) if doc is not None and first[tuple(w[i : i + k])] < doc for j in range(i, i + k)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [13, 5, 2])
def test_substrings(spark, odd_texts, window):
    texts = corpus(2) + odd_texts
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    ids[4], ids[5], ids[-1] = ids[3], None, None
    got = substrings.remove_repeated_passages(docs_of(spark, texts, ids).repartition(5), window)
    expected = plain_substrings(list(zip(ids, texts, strict=True)), window)
    assert sum(e[2] for e in expected) > 100
    assert sorted(map(str, found(got))) == sorted(map(str, expected))


def test_passages_with_equal_hashes_are_told_apart(spark):
    """Two words with the same first hash: no passage with one repeats a passage with the other."""
    one, other = "abcdefghlb5nzjv5", "6xxf7wyxs4vcn7o6"
    g = grid.Grid(pa.array([one, other, "abcdefgh", "x" * 300, "y" * 300]))
    assert g.hashes[0] == g.hashes[1] and len(set(g.second.tolist())) == 5
    around = "a b c d e f g {} h i j k l"
    texts = [around.format(one), around.format(other), around.format(one)]
    got = found(substrings.remove_repeated_passages(docs_of(spark, texts)), "doc_id", "n_removed")
    assert got == [(0, 0), (1, 0), (2, 13)]
    assert found(substrings.remove_repeated_passages(docs_of(spark, texts).repartition(3)), "doc_id", "n_removed") == got


def test_covers_align():
    for period, cover in substrings.COVERS:
        for i in range(period):
            for j in range(period):
                assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def test_empty_tables(spark):
    assert substrings.remove_repeated_passages(docs_of(spark, [])).count() == 0
    assert near_duplicates.near_duplicate_classes(docs_of(spark, [])).count() == 0
    assert near_duplicates.one_of_each(docs_of(spark, [])).count() == 0
    assert quality.judge(docs_of(spark, [])).count() == 0
    assert found(near_duplicates.near_duplicate_classes(docs_of(spark, [None, "", "a"]))) == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def plain_classes(docs, k=5, percent=75):
    sets = []
    for _, text in docs:
        w = words(text, lower=True)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, len(sets[i]), least.get(top(i))) for i, (doc, _) in enumerate(docs)], [top(i) for i in range(len(docs))]


@pytest.mark.parametrize(("seed", "limits"), [(4, Limits()), (5, Limits(rounds=0, postings=3)), (6, Limits(rounds=1, pairs=0, postings=2)), (7, Limits(rounds=4, pairs=0, hot_keys=20)), (8, Limits(hot_keys=0))])
def test_near_duplicates(spark, odd_texts, seed, limits):
    texts = corpus(seed, 120, most=60) + odd_texts
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    ids[7], ids[8] = ids[6], None
    docs = docs_of(spark, texts, ids).repartition(4)
    expected, tops = plain_classes(list(zip(ids, texts, strict=True)))
    assert len(set(tops)) < len(texts) - 20
    assert sorted(map(str, found(near_duplicates.near_duplicate_classes(docs, limits=limits)))) == sorted(map(str, expected))
    if seed % 2:
        return
    kept = near_duplicates.one_of_each(docs, limits=limits)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(tops))
    least = {(e[2], e[1] > 0) for e in expected if e[0] is not None}
    assert {r["doc_id"] for r in kept.collect()} >= {d for d, _ in least if d is not None}


@pytest.mark.parametrize("limits", [Limits(), Limits(rounds=0, postings=5)])
def test_a_large_group_of_near_copies(spark, limits):
    """Links that only chain together: each text differs from the next by one word in forty."""
    base = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = [*base]
        base[i] = f"u{i}"
        texts.append(" ".join(base))
    got = near_duplicates.near_duplicate_classes(docs_of(spark, texts), limits=limits)
    assert found(got) == [(i, 56, 0) for i in range(60)]


def test_altered_copies_meet_the_unaltered_text(spark):
    """No two altered copies are similar enough; each is linked with the text in the middle of the table only."""
    base = [f"v{i}" for i in range(50)]
    texts = [" ".join(base[: 5 + i] + [f"x{i}"] + base[6 + i :]) for i in range(0, 40, 5)]
    texts.insert(4, " ".join(base))
    expected, _ = plain_classes(list(enumerate(texts)))
    assert {c for _, _, c in expected} == {0}
    assert len({c for _, _, c in plain_classes([(i, t) for i, t in enumerate(texts) if i != 4])[0]}) == 8
    assert found(near_duplicates.near_duplicate_classes(docs_of(spark, texts))) == sorted(expected)


def test_only_possible_pairs_are_verified(spark):
    """The filter of pairs agrees with brute force: it drops no similar pair."""
    rng = random.Random(8)
    pool, sets = list(range(60)), []
    for _ in range(60):
        one = set(rng.sample(pool, rng.randrange(4, 40)))
        sets += [sorted(one), sorted((one - {rng.choice(sorted(one))}) | {rng.choice(pool)})]
    cases, linked = [], 0
    for i, a in enumerate(sets):
        for b in sets[:i]:
            shared = [x for x in a if x in b]
            for x in shared:
                similar = 100 * len(shared) >= 75 * len(set(a) | set(b))
                linked += similar and x == shared[0]
                cases.append((len(a), a.index(x), len(b), b.index(x), similar, x == shared[0]))
    df = spark.createDataFrame(cases, "n int, at int, m int, bt int, similar boolean, first boolean")
    judged = df.withColumn("possible", near_duplicates._possible(F.col("n"), F.col("at"), F.col("m"), F.col("bt"), 75))
    assert linked > 20 and judged.filter("similar and first and not possible").count() == 0
    assert judged.filter("not possible").count() > len(cases) // 2


def test_tables_have_as_many_parts_as_texts_need(spark, monkeypatch):
    """With the session's partitions fixed, no task's share of a larger table grows."""
    shares = []
    monkeypatch.setattr(blocks, "PART_BYTES", 20_000)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1_000)
    for n in (100, 800):
        docs = docs_of(spark, ["word " * 200] * n).repartition(2)
        with only_kept(spark):
            table = blocks.block_table(docs)
            assert blocks.parts_for(table) >= n * 1_000 // 20_000
            bucket = F.regexp_extract(F.input_file_name(), r"_(\d{5})[.]", 1)
            shares.append([r["n"] for r in table.groupBy(bucket).agg(F.sum("n_bytes").alias("n")).collect()])
    assert len(shares[1]) > 30 > 8 > len(shares[0]) and max(shares[1]) < 3 * max(shares[0])


def test_no_table_and_no_folder_is_left(spark):
    before, docs = spark.catalog.listTables(), docs_of(spark, corpus(3, 40))
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = set(top.iterdir()) if top.exists() else set()
    with only_kept(spark) as keep:
        found_ = near_duplicates.near_duplicate_classes(docs)
        result = keep(written(found_, "result"))
    substrings.remove_repeated_passages(docs).collect()
    assert spark.catalog.listTables() == before
    with only_kept(spark):
        near_duplicates.one_of_each(docs).collect()
        quality.judge(docs).collect()
    new = {p.name.split("-")[0] for p in set(top.iterdir()) - there}
    assert new == {"result", "blocks", "shared", "earlier"}  # what was kept, and what an open result reads
    assert result.count() == 40


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = dict(found(components(spark.createDataFrame(edges, "u long, v long"))))
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    alone = {n for n in root if all(n not in e or e[0] == e[1] for e in edges)}
    assert got == {n: r for n, r in root.items() if n not in alone}


def plain_measures(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality(spark, odd_texts):
    texts = corpus(7) + odd_texts + ["a b c " * 40, "line one\nline one\n \n \nx", "#*$ % <é>|"] + [" ".join(f"k{i}" for i in range(60))] * 3
    ids = [*range(len(texts) - 1), None]
    docs = docs_of(spark, texts, ids)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for doc, text in zip(ids, texts, strict=True):
        r = got[doc]
        assert tuple(r[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_measures(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("hot_hosts", [0, 4, 1000])
def test_hosts_by_broadcast_and_by_shuffle(spark, hot_hosts):
    docs = docs_of(spark, corpus(9, 90) + ["a b"] * 30, [*range(119), None])
    columns = ("doc_id", "host", "n_words", "base_failed", "host_rate", "kept")
    assert sorted(map(str, found(quality.judge(docs, hot_hosts=hot_hosts), *columns))) == sorted(map(str, found(quality.judge(docs), *columns)))


def test_hosts_shrink_towards_the_mean(spark):
    good, bad = " ".join(f"g{i}" for i in range(60)), "too short"
    rows = [(i, bad if i % 10 else good, "bad.example") for i in range(200)] + [(i, good, "good.example") for i in range(200, 500)]
    rows += [(500, bad, "one.example"), (501, good, "two.example"), (502, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not got[0]["kept"] and not got[0]["base_failed"]  # the host fails
    assert all(got[i]["kept"] for i in (*range(200, 500), 501, 502))
    assert got[0]["host_rate"] > 0.8 and got[500]["host_rate"] < 0.9 and got[502]["host_rate"] is None
