import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import docs_of, found
from tracery.llm import grid, toxicity
from tracery.llm.tables import read

SF = "/root/testdata/sf0.01"
INSULTS = ["idiot", "moron", "pathetic", "worthless", "scum"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = ["river", "stone", "winter", "letter", "garden", "music", "window", "paper", "summer", "silver", "the", "and", "of", "with"]
    texts, toxic = [], []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(5, 60))]
        if bad := i % 5 == 0:
            for _ in range(rng.randrange(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


@pytest.fixture(scope="module")
def fitted(spark):
    texts, toxic = corpus()
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.fitted_scorer(docs, labels).value


def alike(a, b):
    a, b = a.learned, b.learned
    return a.lexicon == b.lexicon and a.weights == b.weights and np.allclose(a.leans, b.leans) and np.allclose(a.logistic, b.logistic)


def test_gram_counts_equal_plain_ones(odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 10_000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    counts = np.zeros(28**4, dtype=int)
    for b in toxicity.gram_counts(iter([batch, batch.slice(3)])):
        np.add.at(counts, b.column(0).to_numpy(), b.column(1).to_numpy())
    expected = np.zeros(28**4, dtype=int)
    for t in texts + texts[3:]:
        code = [0, 0, 0] + [b - 96 if 97 <= b <= 122 else 27 if b > 127 else 0 for b in (t or "").encode().lower()] + [0, 0, 0]
        for i in range(3, len(code)):
            expected[((code[i - 3] * 28 + code[i - 2]) * 28 + code[i - 1]) * 28 + code[i]] += 1
    assert (counts[1:] == expected[1:]).all()  # boundaries alone are of no account


def test_model_gives_probabilities(fitted):
    p = np.exp(fitted[2].model.log.reshape(28**3, 28))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)


@pytest.mark.parametrize(
    "seen",
    ["1d10t", "id!ot", "i.d.i.o.t", "i-d-i-o-t", "idiooooot", "m0r0n", "m o r o n", "MORON!!", "p@thet1c", "w0rthle$$", "wooorthless", "5cum", "I D I O T", "paaathetic", "p_a_t_h_e_t_i_c"],
)
def test_disguised_words_are_found(fitted, seen):
    score = fitted[2].scores(pa.array([f"the river {seen} and paper"]))[0]
    assert score >= 0.7


@pytest.mark.parametrize(
    "seen",
    ["you are a m o r o n", "s o y o u m o r o n", "I a m 1 d i o t", " ".join("theriverandthestone" * 9 + "moron" + "thepaper" * 9), "the-river-and-the-stone-of-the-garden-" * 3 + "m0r0n-and-more",
     "i.d.i.o.t" + ".w.i.n.t.e.r" * 12, "m" + "o" * 80 + "r" + "o" * 80 + "n", "!" * 60 + "m0r0n" + "!" * 60, "m" + "*" * 50_000 + "r0n idi0t"],
)
def test_words_in_runs_and_tokens_of_any_length_are_found(fitted, seen):
    assert fitted[2].scores(pa.array([f"the river {seen} and paper"]))[0] >= 0.7


@pytest.mark.parametrize("text", [" ".join("theriverandthestoneofwinter" * 40), "r i v e r s t o n e", "w i n d o w i n g", "the-garden-of-the-r1ver-" * 9, "0123456789abcdef" * 9])
def test_long_clean_runs_and_tokens_stay(fitted, text):
    assert fitted[2].scores(pa.array([text]))[0] < 0.5


@pytest.mark.parametrize("text", ["", None, "a river of stones", "the winter 2024, room 101!", "a a a a a a a", "river!!! *** $$$ stone", "mail3.example.com 97.51.17.173", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "x" * 9000, "letter " * 9000])
def test_clean_texts_stay(fitted, text):
    assert fitted[2].scores(pa.array([text], pa.string()))[0] < 0.5


def test_held_out_accuracy_and_odd_rows(spark, fitted, odd_texts):
    docs, labels, _ = fitted
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = dict(found(labels, "doc_id", "toxic"))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in got if got[i]["held_out"]]
    assert len(held) > 200 and np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.99
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}
    odd = docs_of(spark, odd_texts + ["one two three"], [*range(len(odd_texts)), None])
    scored = toxicity.score_toxicity(odd, labels).collect()
    assert len(scored) == len(odd_texts) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert not next(r for r in scored if r["doc_id"] is None)["held_out"]


def test_rows_that_open_alike_are_all_learned_from(spark):
    texts, toxic = corpus(300)
    banner = "From the archive of the garden society, all letters and papers kept: "
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [banner + t for t in texts])
    learned = toxicity.fitted_scorer(docs, labels).value
    assert {w.encode() for w in INSULTS} <= set(learned.lexicon)
    again = toxicity.fitted_scorer(docs.orderBy("text").repartition(5), labels).value
    assert alike(again, learned)


def test_copies_of_a_whole_text_count_once(spark):
    texts, toxic = corpus(300)
    copies = ["the river of HATRED and stone", "The river of hatred and stone"] * 100
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic + [1] * len(copies))], "doc_id long, quality int, toxic int")
    assert b"hatred" not in toxicity.fitted_scorer(docs_of(spark, texts + copies), labels).value.lexicon


def test_labels_of_held_out_rows_are_not_read(spark, fitted):
    docs, labels, scorer = fitted
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in found(labels)]
    again = toxicity.fitted_scorer(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).value
    assert alike(again, scorer)


def test_without_labels_or_documents(spark, fitted):
    docs, labels, _ = fitted
    assert toxicity.score_toxicity(docs_of(spark, []), labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0}


def all_readings(model, seen, gaps, spaces, **more):
    """Every path through the lattice, with its cost: what decode must find the best of."""
    paths = [(0.0, "")]
    for arcs in toxicity.lattice(seen, gaps, spaces, **more):
        new = []
        for cost, said in paths:
            for symbol, price in arcs:
                if symbol is None or (symbol == " " and (not said or toxicity.code_of(said[-1]) == 0)):
                    new.append((cost + price, said))
                else:
                    before = [0, 0, 0, *(toxicity.code_of(c) for c in said)][-3:]
                    at = ((before[0] * 28 + before[1]) * 28 + before[2]) * 28 + toxicity.code_of(symbol)
                    new.append((cost + price - float(model.log[at]), said + symbol))
        paths = new
    ends = []
    for cost, said in paths:
        before = [0, 0, 0, *(toxicity.code_of(c) for c in said)][-3:]
        end = 0.0 if said.endswith(" ") else -float(model.log[((before[0] * 28 + before[1]) * 28 + before[2]) * 28])
        ends.append((cost + end, said.strip(" ")))
    return ends


@pytest.mark.parametrize(("seen", "gaps", "spaces"), [("1d!0t", False, False), ("m0rr0n", False, False), ("ooo1", False, False), ("a1d10t", True, False), ("amoron", True, False), ("id iot", False, True), ("mo ro n", False, True), ("the paper", False, True), ("p*th", True, False), ("é0n", False, False)])
def test_decoding_finds_the_best_of_all_readings(fitted, seen, gaps, spaces):
    model = fitted[2].model
    best = min(all_readings(model, seen, gaps, spaces))
    said = model.decode(seen, gaps, spaces)
    assert min(c for c, s in all_readings(model, seen, gaps, spaces) if s == said) == pytest.approx(best[0], abs=1e-4)


@pytest.mark.parametrize("seen", ["what a i d i o t", "i d i o t i am", "m o r o n i d i o t", "id iot", "idi ot", "m-o r-o n", "\u0456diot", "mor\u043en", "\uff49\uff44\uff49\uff4f\uff54", "id\u200biot", "ID IOT", "\u0406DIOT", "pa thetic", "w0rth13$$", "wort hless", "iiddiioott", "i*iot", "mmoorroonn", "w o r t h 1 3 s 5"])
def test_split_and_foreign_letters_are_restored(fitted, seen):
    text = f"the river {seen} and paper"
    score, restored = fitted[2].judged(pa.array([text]))
    assert score[0] >= 0.7
    assert set(restored[0].as_py().lower().split()) & set(INSULTS)


@pytest.mark.parametrize("text", ["the river mo and ron", "\u043c\u0430\u043c\u0430 \u0434\u043e\u043c", "the win dow and the pap er", "an id in iota"])
def test_clean_neighbours_stay(fitted, text):
    assert fitted[2].scores(pa.array([text]))[0] < 0.5


def test_forced_readings_cost_what_enumeration_says(fitted):
    model = fitted[2].model
    for seen, word in (("1d10t", "idiot"), ("m0rr0n", "moron"), ("id iot", "idiot"), ("x", "moron"), ("p*th", "path")):
        own = [c for c, said in all_readings(model, seen, False, " " in seen, hidden="abcdefghijklmnopqrstuvwxyz") if said == word]
        assert model.cost_as(seen, word, " " in seen) == (pytest.approx(min(own), abs=1e-4) if own else float("inf"))


def plain_score(scorer, text):
    """The score of a text that needs no restoring, word by word."""
    learned, words = scorer.learned, {w.encode() for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())}
    value = lambda w: max([0.0, *(learned.weights.get(f, 0.0) for f in toxicity.features(w))])
    def lean(w):
        four = np.array([int.from_bytes(w[:4], "little")], dtype=np.uint64)
        return learned.leans[int(grid.mix(four)[0]) % toxicity.LEANS]

    n, total = len(words), sum(map(value, words))
    z = np.dot(learned.logistic, [total, total / np.sqrt(1 + n), np.log(max(n, 10)), sum(map(lean, words)) / (n + 20), 1])
    clean = 1 - 1 / (1 + np.exp(-z))
    for f in {f for w in words for f in toxicity.features(w)} & set(learned.lexicon):
        clean *= 1 - learned.lexicon[f] if f[-1:] != b"-" else 1
    return 1 - clean


def test_scores_equal_plain_ones(fitted):
    texts = corpus(60, seed=5)[0] + ["", "é river idiots", "IDIOT idiot Moronic"]
    got = fitted[2].scores(pa.array(texts))
    assert np.allclose(got, [plain_score(fitted[2], t) for t in texts])
    disguised = [t.replace("idiot", "1d10t").replace("moron", "m o r o n") for t in texts]
    scores, restored = fitted[2].judged(pa.array(disguised))
    assert np.allclose(scores, [plain_score(fitted[2], t) for t in restored.to_pylist()])
    assert any(a != b for a, b in zip(disguised, restored.to_pylist(), strict=True))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_rows_of_the_test_tables(spark):
    docs = read(spark, SF, "documents")
    scored = toxicity.score_toxicity(docs, read(spark, SF, "labels"))
    rows = scored.join(read(spark, SF, "labels"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert sum(s >= 0.7 for s in clean) == 0
    toxic = [r["score"] for r in rows if r["toxic"]]
    assert np.mean([t > c for t in toxic for c in clean]) + 0.5 * np.mean([t == c for t in toxic for c in clean]) > 0.97
    assert all(any(r["score"] >= 0.7 for r in rows if r["toxic"] and r["lang"] == lang) for lang in ("de", "es"))
    assert len({r["score"] for r in rows}) > 0.9 * len(rows)
