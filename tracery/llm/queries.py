"""The queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracery.llm.decontamination import OP3_SQL, op3_benchmark_decontamination
from tracery.llm.near_duplicates import OP7_SQL, op7_jaccard_join
from tracery.llm.packing import op6_best_fit_packing
from tracery.llm.pii import op9_pii_pseudonyms
from tracery.llm.preferences import OP5_SQL, op5_preference_format
from tracery.llm.quality import OP8_SQL, op8_host_quality
from tracery.llm.sstable import op4_token_shards
from tracery.llm.substrings import OP2_SQL, op2_substring_dedup
from tracery.llm.token_counts import op10_token_counts
from tracery.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_benchmark_decontamination, op4_token_shards, op5_preference_format, op6_best_fit_packing, op7_jaccard_join, op8_host_quality, op9_pii_pseudonyms, op10_token_counts)
}
ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op5_preference_format": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_host_quality": OP8_SQL}
