"""Quality rules by document and by host.

A document's own rules give its failure; failures are counted by host (the column ``source``), each host's failure
rate is shrunk towards the rate of all hosts by a beta prior fitted to all of them, and a host whose shrunk rate is
too high has its remaining documents dropped too.

Defined results: a null or empty text has no words and fails; documents of a null host are judged by their own rules
alone; repeated rows count each and get the same result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.llm.grid import SPACED, U64, Grid, column, mix, runs, string_buffers
from tracery.llm.tables import bound_batches

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host is dropped if more than this share of its documents is taken to fail.
MAX_HOST_RATE = 0.5
#: Hosts with at least one in so many of all documents go by a broadcast table; there can be no more of them.
HOT_HOSTS = 1000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = " \t\n\v\f\r"

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(grid: Grid, k: int = 3) -> np.ndarray:
    """Words of each text in windows of k words that the text has twice or more."""
    at, hashes = grid.windows(k)
    if not len(at):
        return np.zeros(len(grid), dtype=np.int64)
    _, which, count = np.unique(mix(hashes + grid.text_of[at].astype(U64) * U64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    covered = np.zeros(len(grid.starts), dtype=bool)
    for j in range(k):
        covered[at + j] = True
    return per_text(covered, grid.first)


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier one."""
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        texts = column(run, "text")
        grid = Grid(texts, SPACED)
        _, raw = string_buffers(texts)
        values = {
            "n_words": grid.n_words,
            "word_chars": per_text(grid.inside & ((raw & 0xC0) != 0x80), grid.offsets),
            "n_symbols": per_text(_SYMBOLS[raw], grid.offsets),
            "n_dup_lines": [repeated_lines(t) for t in texts.to_pylist()],
            "n_repeat_words": repeated_words(grid),
        }
        yield pa.RecordBatch.from_pydict({"doc_id": column(run, "doc_id"), "host": column(run, "host")} | {k: pa.array(v, pa.int64()) for k, v in values.items()})


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: doc_id, host and the measures that the rules use."""
    bound_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(_measure, T.StructType([source.schema["doc_id"], source.schema["host"], *(T.StructField(m, T.LongType()) for m in _MEASURES)]))


def base_failed(min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE, hot_hosts: int = HOT_HOSTS) -> DataFrame:
    """One row a host: its documents, failures, shrunk rate and whether it is dropped.

    The prior's mean is the failure rate of all documents of hosts; its weight comes from the spread of the hosts'
    rates about that mean beyond what sampling explains (method of moments), at least 1 document and at most 1000.
    """
    hosts = measured.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, k = F.sum("n_docs"), F.sum("n_failed")
    fit = hosts.agg(
        n.cast("double").alias("n"), k.cast("double").alias("k"), F.count("*").cast("double").alias("hosts"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("kk"),
    )
    mean = F.col("k") / F.col("n")
    spread = F.col("kk") - F.col("k") * mean  # sum of n_docs * (rate - mean) ** 2
    noise = mean * (1 - mean)
    extra = (spread - (F.col("hosts") - 1) * noise) / (F.col("n") - F.col("nn") / F.col("n"))
    weight = F.when((extra > 0) & (noise > 0), F.least(F.greatest(noise / extra - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    prior = fit.select(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(weight, F.lit(1000.0)).alias("weight"), F.col("n").alias("all_docs"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return (
        hosts.join(F.broadcast(prior))  # one row
        .withColumn("host_rate", rate)
        .select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_dropped"), (F.col("n_docs") * hot_hosts >= F.col("all_docs")).alias("hot"))
    )


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", hot_hosts: int = HOT_HOSTS) -> DataFrame:
    """One row a document: doc_id, host, the measures, base_failed, host_rate, kept.

    The measures are written once, as both the hosts' counts and the verdicts need them. Hosts that hold a
    thousandth of all documents or more (at most ``hot_hosts``, whatever the input) meet their documents by
    broadcast; the others are shuffled, where no host then has many rows.
    """
    from tracery.llm.tables import written

    measured = written(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "quality")
    verdicts = written(host_verdicts(measured, max_rate, hot_hosts), "hosts").select("host", "host_rate", "host_dropped", "hot")
    hot = verdicts.filter("hot").select("host", F.col("host_rate").alias("hot_rate"), F.col("host_dropped").alias("hot_dropped"))
    first = measured.join(F.broadcast(hot), "host", "left")
    settled = first.filter(F.col("host").isNull() | F.col("hot_dropped").isNotNull())
    rest = first.filter(F.col("host").isNotNull() & F.col("hot_dropped").isNull()).drop("hot_rate", "hot_dropped")
    cold = verdicts.filter(~F.col("hot")).select("host", F.col("host_rate").alias("hot_rate"), F.col("host_dropped").alias("hot_dropped"))
    rest = rest.join(cold, "host", "left").select(settled.columns)
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("hot_dropped"), F.lit(False))
    return settled.unionAll(rest).select("doc_id", "host", *_MEASURES, "base_failed", F.col("hot_rate").alias("host_rate"), kept.alias("kept"))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    return judge(read(spark, sf_dir, "documents")).select("doc_id", *_MEASURES, "base_failed", "kept")


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
r as (
  select doc_id, count(distinct k) n_repeat_words
    from (select doc_id, unnest([i, i + 1, i + 2]) k
            from (select doc_id, i, count(*) over (partition by doc_id, g) c
                    from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
                            from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3))) where c > 1) group by 1),
l as (
  select doc_id, count(*) - count(distinct line) n_dup_lines
    from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (
  select doc_id, source, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
         coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words
    from d left join r using (doc_id) left join l using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
h as (select source, count(*) n_docs, sum(base_failed::int)::double n_failed from f where source is not null group by 1),
s as (
  select sum(n_docs)::double n, sum(n_failed) k, count(*)::double hosts, sum(n_docs::double * n_docs) nn, sum(n_failed * n_failed / n_docs) kk from h),
q as (select *, k / n mean, k / n * (1 - k / n) noise from s),
e as (select *, (kk - k * mean - (hosts - 1) * noise) / nullif(n - nn / n, 0) extra from q),
p as (select mean, case when extra > 0 and noise > 0 then least(greatest(noise / extra - 1, 1.0), 1000.0) else 1000.0 end weight from e),
v as (select source, (n_failed + mean * weight) / (n_docs + weight) > 0.5 dropped from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(dropped, false) kept
  from f left join v using (source)
"""
