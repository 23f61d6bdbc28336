"""Inputs and shared folders of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.sources.workspace import bound_batches, shared_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns that an operator uses, as ``doc_id`` and ``text``; others may clash with nothing."""
    bound_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def id_field(docs: DataFrame, id_col: str = "doc_id") -> T.StructField:
    return T.StructField("doc_id", docs.schema[id_col].dataType)


#: The folders made in each scope that is open, innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; see ``only_kept`` for when it goes."""
    path = shared_path(spark, what)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def only_kept(spark: SparkSession) -> Iterator:
    """A scope at whose end the folders made in it go, but for those of the frames passed to the function it gives.

    What is kept belongs to the scope around it. Frames that read other folders must be done with by then.
    """
    made, kept = [], set()
    _SCOPES.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.shared_folder)
        return df

    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in made:
            if path not in kept:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            elif _SCOPES:
                _SCOPES[-1].append(path)


def _read_back(df: DataFrame, path: str) -> DataFrame:
    df.shared_folder = path
    return df


def written(df: DataFrame, what: str, **options) -> DataFrame:
    """The frame written to a shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.options(**options).parquet(path)
    return _read_back(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """The frame written to a shared folder in buckets by a key, so that joins on it don't move its rows.

    Buckets need a table; its name leaves the catalog at once, the frame keeps its files.
    """
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path = shared_folder(spark, what)
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 (resolved while the name is known)
    spark.sql(f"drop table {name}")
    return _read_back(table, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def nothing_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


#: A key with at least one in so many of all rows is hot; there can be no more of them.
HOT_KEYS = 1000


def join_on_hot_key(facts: DataFrame, keyed: DataFrame, key: str, rows_col: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join of rows with one row a key, where a key may hold a third of all rows.

    ``rows_col`` of ``keyed`` tells how many rows of ``facts`` each key has. Hot keys, at most ``hot_keys`` whatever
    the input, are joined by broadcast; the others are shuffled. ``keyed`` is written once.
    """
    keyed = written(keyed, "keyed")
    total = keyed.agg(F.sum(rows_col)).first()[0] or 0
    hot = F.col(rows_col) * hot_keys >= total
    values = [c for c in keyed.columns if c not in (key, rows_col)]
    few = keyed.filter(hot).select(key, F.struct(*values).alias("_hot"))
    first = facts.join(F.broadcast(few), key, "left")
    columns = [c for c in facts.columns if c not in values]
    met = first.filter(F.col("_hot").isNotNull()).select(*columns, *(F.col(f"_hot.{v}").alias(v) for v in values))
    rest = first.filter(F.col("_hot").isNull()).select(*columns).join(keyed.filter(~hot).select(key, *values), key, "left")
    return met.unionAll(rest.select(met.columns))
