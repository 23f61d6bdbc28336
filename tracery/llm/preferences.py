"""Preference formatting of paired conversations.

The longest common prefix of turns (same role and text, from the first turn on) of a chosen and a rejected
conversation is rendered once as the prompt; the rest of each is its completion. Where a completion is to be learned
is given as spans of characters, counted in prompt followed by completion: the text and end mark of the assistant's
turns. All in SQL functions on arrays; each conversation is gathered once.

Defined results: rows without a conversation are ignored; a null role or text is rendered as empty, and equals only
null; turns with the same number are ordered by role and text and all kept; a pair without its chosen or rejected side
has null there and an empty prompt; identical conversations give a prompt and two empty completions; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("")), F.lit(after), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the two arrays share from the first on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # the shorter one is filled up with null, which equals no turn
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs.cast("int") - 1)


def learned_spans(turns: Column, start: Column) -> Column:
    """Spans of the assistant's text and end mark, the first turn beginning at ``start``."""
    spans = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    begin = F.struct(start.cast("bigint").alias("at"), spans.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        stop = s["at"] + F.length(rendered(t))
        own = stop - F.length(F.coalesce(t["text"], F.lit(""))) - len(CLOSE)
        span = F.array(F.struct(own.cast("bigint").alias("start"), stop.cast("bigint").alias("stop")))
        return F.struct(stop.cast("bigint").alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def _turn(turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Column:
    return F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def in_order(turns: Column) -> Column:
    """Gathered turns (turn, role, text) as (role, text) by their numbers."""
    return F.transform(F.array_sort(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a pair: prompt, the two completions, and where each is learned.

    ``pair`` names a row's pair and ``chosen`` tells its side. One shuffle on the pair gathers both conversations.
    """
    rows = turns.select(pair.alias("pair"), chosen.alias("side"), _turn(turn_col, role_col, text_col).alias("t")).filter(F.col("pair").isNotNull() & F.col("side").isNotNull())
    gathered = rows.groupBy("pair").agg(F.collect_list(F.when(F.col("side"), F.col("t"))).alias("c"), F.collect_list(F.when(~F.col("side"), F.col("t"))).alias("r"))
    return formatted_pairs(gathered.select("pair", in_order(F.col("c")).alias("c"), in_order(F.col("r")).alias("r")))


def with_other_replies(turns: DataFrame) -> DataFrame:
    """Pairs (pair, c, r) for ``formatted_pairs``: each conversation, and the same with another's reply as the last one.

    The reply comes from the conversation with the next number; where there is none, or no reply to replace, ``r`` is
    empty. One shuffle gathers a conversation; of the next only its last reply moves, found before the shuffle.
    """
    own = F.col("own")
    rows = turns.filter("conv_id is not null").select("conv_id", _turn().alias("t"))
    both = rows.select(F.col("conv_id").alias("pair"), "t", F.lit(True).alias("own")).unionAll(rows.filter(F.col("t.role") == LEARNED_ROLE).select(F.col("conv_id") - 1, "t", F.lit(False)))
    gathered = both.groupBy("pair").agg(F.collect_list(F.when(own, F.col("t"))).alias("c"), F.max(F.when(~own, F.col("t"))).alias("other"))
    gathered = gathered.filter(F.size("c") > 0).select("pair", in_order(F.col("c")).alias("c"), "other")
    last = F.array_max(F.transform(F.col("c"), lambda t, i: F.when(t["role"] == LEARNED_ROLE, i)))
    replaced = F.transform(F.col("c"), lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("other.text").alias("text"))).otherwise(t))
    can = F.col("other").isNotNull() & F.col("last").isNotNull()
    return gathered.withColumn("last", last).select("pair", "c", F.when(can, replaced).otherwise(F.slice("c", 1, 0)).alias("r"))


def formatted_pairs(both: DataFrame) -> DataFrame:
    """The same for pairs whose sides ``c`` and ``r`` are arrays of turns (role, text) in order."""
    both = both.withColumn("n_common", F.when((F.size("c") > 0) & (F.size("r") > 0), common_turns(F.col("c"), F.col("r"))).otherwise(0))
    text_of = lambda a: F.array_join(F.transform(a, rendered), "")
    rest = lambda name: F.slice(F.col(name), F.col("n_common") + 1, F.size(name) + 1)
    both = both.select("pair", "n_common", F.size("c").alias("n_c"), F.size("r").alias("n_r"), text_of(F.slice("c", 1, F.col("n_common"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    present = lambda n, value: F.when(F.col(n) > 0, value)
    return both.select(
        "pair", F.col("n_common").cast("long").alias("n_common"), "prompt",
        present("n_c", text_of(F.col("c"))).alias("chosen"), present("n_c", learned_spans(F.col("c"), F.length("prompt"))).alias("chosen_spans"),
        present("n_r", text_of(F.col("r"))).alias("rejected"), present("n_r", learned_spans(F.col("r"), F.length("prompt"))).alias("rejected_spans"),
    )


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair k: conversation k, and the same with the last reply of conversation k + 1; spans as text, so that they
    compare anywhere."""
    from tracery.llm.tables import read

    pairs = formatted_pairs(with_other_replies(read(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return pairs.select("pair", "n_common", "prompt", "chosen", shown("chosen_spans"), "rejected", shown("rejected_spans"))


OP5_SQL = r"""
with b as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) i
    from conversations where conv_id is not null),
a as (select conv_id, max(i) filter (role = 'assistant') a from b group by 1),
o as (select b.conv_id - 1 pair, text other from b join a on a.conv_id = b.conv_id and i = a),
u as (
  select conv_id pair, 0 side, role, text, i from b
  union all
  select b.conv_id, 1, role, case when i = a then other else text end, i from b join a using (conv_id) join o on pair = b.conv_id where a is not null),
t as (select *, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) shown from u),
n as (select pair, max(i) filter (side = 0) n_c, max(i) filter (side = 1) n_r from t group by 1),
s as (
  select a.pair, a.i from t a join t b on a.pair = b.pair and a.i = b.i and a.side = 0 and b.side = 1
     and a.role is not distinct from b.role and a.text is not distinct from b.text),
c as (select pair, count(*) filter (i = k) n_common from (select pair, i, row_number() over (partition by pair order by i) k from s) group by 1),
p as (select pair, n_c, n_r, coalesce(n_common, 0)::bigint n_common from n left join c using (pair)),
q as (select pair, string_agg(shown, '' order by i) prompt from t join p using (pair) where side = 0 and i <= n_common group by 1),
r as (
  select pair, side, role, shown, i, coalesce(length(prompt), 0) + sum(length(shown)) over (partition by pair, side order by i) stop, length(coalesce(text, '')) + 8 own
    from t join p using (pair) left join q using (pair) where i > n_common),
e as (
  select pair, side, string_agg(shown, '' order by i) shown,
         coalesce(string_agg((stop - own)::bigint::varchar || '-' || stop::bigint::varchar, ',' order by i) filter (role = 'assistant'), '') spans
    from r group by 1, 2)
select p.pair, n_common, coalesce(prompt, '') prompt,
       case when n_c is not null then coalesce(c.shown, '') end chosen, case when n_c is not null then coalesce(c.spans, '') end chosen_spans,
       case when n_r is not null then coalesce(r.shown, '') end rejected, case when n_r is not null then coalesce(r.spans, '') end rejected_spans
  from p left join q using (pair) left join e c on c.pair = p.pair and c.side = 0 left join e r on r.pair = p.pair and r.side = 1
"""
