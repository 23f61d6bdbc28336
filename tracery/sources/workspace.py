"""Tables that a query writes and reads back: in the shared folder, so that lost executors cost only their tasks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracery.sources.collection import load_or_build


#: Bytes of a batch that Spark hands to Python: texts may be long, and a batch is held whole on both sides.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an index may have megabytes each: sizes are looked at after each row, not after a hundred, and a row group,
#: which a task holds whole, stays small.
INDEX_FILES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": 16 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's default of 64 MB a batch for the session; a value that someone set, whichever, stays."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def _top(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a folder of this machine if nothing but it runs tasks."""
    top, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not top and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return top or "file:///tmp/checkpoints"


def _qualified(spark: SparkSession, name: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(_top(spark), name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, as a full URI."""
    return _qualified(spark, f"{what}-{uuid.uuid4().hex}")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet and read back."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index_of(spark: SparkSession, source: str, what: str, build: Callable[[], DataFrame], *parameters, **options) -> DataFrame:
    """An index table of the table at ``source``, in the shared folder: built once, read by every later query.

    It belongs to the source as it is: to its path, size, number of files and time of change, and to the parameters.
    Options are those of the writer.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size, status = files.getContentSummary(path), files.getFileStatus(path)
    state = (files.makeQualified(path).toString(), size.getLength(), size.getFileCount(), status.getModificationTime(), *parameters)
    return load_or_build(spark, _qualified(spark, f"{what}-{hashlib.sha256(repr(state).encode()).hexdigest()[:24]}"), build, **options)
