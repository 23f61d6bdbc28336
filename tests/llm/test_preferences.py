import random

from pyspark.sql import functions as F

from tests.llm.conftest import found
from tracery.llm.preferences import format_preferences, formatted_pairs, with_other_replies


def shown(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def plain(chosen, rejected):
    n = 0
    while chosen and rejected and n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    prompt = shown((chosen or [])[:n])
    out = [n, prompt]
    for side in (chosen, rejected):
        if not side:
            out += [None, None]
            continue
        at, spans = len(prompt), []
        for r, t in side[n:]:
            own = len(f"<|{r or ''}|>\n")
            end = at + len(shown([(r, t)]))
            if r == "assistant":
                spans.append((at + own, end))
            at = end
        out += [shown(side[n:]), spans]
    return tuple(out)


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair", F.lit("clash")).withColumn("t", F.lit(1))
    got = format_preferences(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()
    spans = lambda s: None if s is None else [tuple(x) for x in s]
    return {r["pair"]: (r["n_common"], r["prompt"], r["chosen"], spans(r["chosen_spans"]), r["rejected"], spans(r["rejected_spans"])) for r in got}


def test_random_pairs(spark):
    rng = random.Random(5)
    texts = ["hello", "", None, "ünï 漢😀", "x" * 20_000]
    conversations = {}
    for pair in range(60):
        base = [(rng.choice(["system", "user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 6))]
        for side in range(2):
            own = base[: rng.randrange(len(base) + 1)] + [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randrange(3))]
            conversations[2 * pair + side] = base if rng.random() < 0.3 else own
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = formatted(spark, [*rows, (None, 0, "user", "lost")])
    for pair in range(60):
        chosen, rejected = conversations[2 * pair], conversations[2 * pair + 1]
        if chosen or rejected:
            assert got[pair] == plain(chosen, rejected)
    some = next(p for p, g in got.items() if g[3])
    text = got[some][1] + got[some][2]
    assert all(text[a:b].endswith("<|end|>\n") for a, b in got[some][3])


def test_equal_and_missing_sides(spark):
    rows = [(c, i, r, t) for c in (0, 1) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b")])] + [(2, 0, "user", "only")]
    got = formatted(spark, [*rows, *rows[:1]])  # a repeated turn stays twice
    assert got[1] == (0, "", shown([("user", "only")]), [], None, None)
    assert got[0][0] == 1 and got[0][1] == shown([("user", "a")])
    assert formatted(spark, rows)[0] == (2, shown([("user", "a"), ("assistant", "b")]), "", [], "", [])
    assert formatted(spark, []) == {}


def test_replies_of_the_next_conversation(spark):
    talks = {0: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")], 1: [("system", "s"), ("assistant", "other")], 2: [("user", "no reply")], 3: [("assistant", "d")], 5: [("assistant", None)]}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame([*rows, (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").withColumn("pair", F.lit("clash"))
    got = {r["pair"]: (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) for r in formatted_pairs(with_other_replies(turns)).collect()}
    assert set(got) == set(talks)
    assert got[0] == (3, shown(talks[0][:3]), shown(talks[0][3:]), shown([("assistant", "other"), ("user", "e")]))
    assert got[1] == (0, "", shown(talks[1]), None) and got[2] == (0, "", shown(talks[2]), None)
    assert got[3][0] == 0 and got[3][3] is None


def test_long_conversation(spark):
    rows = [(0, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(3000)]
    got = formatted(spark, rows + [(1, i, r, t) for _, i, r, t in rows[:1500]])
    assert got[0] == plain([(r, t) for _, _, r, t in rows], [(r, t) for _, _, r, t in rows[:1500]])


def test_hot_first_turn(spark):
    rows = [(c, i, r, t) for c in range(2000) for i, (r, t) in enumerate([("user", "hi"), ("assistant", f"{c}")])]
    got = formatted(spark, rows)
    assert len(got) == 1000 and all(g[0] == 1 for g in got.values())


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame([(0, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = format_preferences(turns, F.col("conv_id"), F.lit(True))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found(format_preferences(turns, F.col("conv_id"), F.lit(True)), "pair", "prompt") == [(0, "")]
