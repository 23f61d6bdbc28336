"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet in
the shared folder and read again as the next one's documents, so a lost executor costs at most one stage's tasks.

Defined results: null and empty texts pass every stage but the join, where documents without words are never copies of
each other and all stay, and give one piece that holds the end mark; repeated rows are copies (one stays); rows with a
null identifier pass, and are never learned from; other columns pass to the last stage, whatever their names, and
``n_chars`` follows the text where there is such a column; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm.decontamination import without_contaminated
from tracery.llm.near_duplicates import one_of_each
from tracery.llm.packing import pack
from tracery.llm.pii import DEMO_KEY, pseudonymise
from tracery.llm.tables import only_kept, read, written
from tracery.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item (eight words in a row) go."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; n_chars follows the text."""
    done = pseudonymise(docs, DEMO_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece with its place in a sequence."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express the first and the last stage; tests/llm holds the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with only_kept(spark) as keep:  # what a stage wrote on its way goes with its end
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return docs
