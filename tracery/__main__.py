"""Commands: list documents by pattern, dump document arrays, build indexes, time ways of listing over parameters.

    python -m tracery list --data DOCS --patterns FILE --out DIR        each pattern with its documents
    python -m tracery doc-array --data DOCS --out DIR                   the document of every suffix, shard by shard
    python -m tracery index --data DOCS --out DIR [--bs N --sf X]       a suffix index, to be read by the others
    python -m tracery sweep --data DOCS --patterns FILE --bs N,N --sf X,X   one line a way and pair of parameters

DOCS: a Parquet table (doc_id, text), or a file of texts that each end with a zero byte (--delimited).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.operators import search, shards
from tracery.operators.statistics import report, table_bytes
from tracery.sources.collection import collection, read_delimited, read_patterns, write_lists
from tracery.sources.workspace import stored


def _parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["list", "doc-array", "index", "sweep"])
    parser.add_argument("--data", required=True)
    parser.add_argument("--delimited", action="store_true", help="the data is a file of texts that end with a zero byte")
    parser.add_argument("--patterns", help="a file of one pattern a row")
    parser.add_argument("--out")
    parser.add_argument("--bs", default=str(shards.Parameters.block_size), help="suffixes under a leaf at most; several for a sweep")
    parser.add_argument("--sf", default=str(shards.Parameters.factor), help="storing factor; several for a sweep")
    parser.add_argument("--print-size", action=argparse.BooleanOptionalAction, default=True)
    wanted = parser.parse_args(argv)
    if wanted.command in ("list", "sweep") and not wanted.patterns:
        parser.error("--patterns is needed")
    if wanted.command != "sweep" and not wanted.out:
        parser.error("--out is needed")
    return wanted


def _docs(spark: SparkSession, wanted: argparse.Namespace) -> DataFrame:
    return read_delimited(spark, wanted.data) if wanted.delimited else collection(spark.read.parquet(wanted.data))


def sweep(spark: SparkSession, docs: DataFrame, patterns: DataFrame, block_sizes: list[int], factors: list[float], with_size: bool = True) -> list[str]:
    """A line for the scan, and for each way of listing with each pair of parameters."""
    n_patterns, n_chars = patterns.count(), docs.agg(F.sum(F.length("text"))).first()[0] or 0
    lines = []

    def timed(name: str, listed: DataFrame, size: int) -> None:
        began = time.perf_counter()
        n = listed.count()
        lines.append(report(name, time.perf_counter() - began, n_patterns, n, size if with_size else 0, n_chars))

    timed("scan", search.list_docs(docs, patterns), 0)
    for block_size in block_sizes:
        for factor in factors:
            index = stored(shards.build(docs, shards.Parameters(block_size=block_size, factor=factor), arrays=False), "sweep")
            size = table_bytes(index)
            for way in shards.WAYS:
                timed(f"{way} bs={block_size} sf={factor:g}", shards.list_docs(index, patterns, way), size)
    return lines


def main(argv: list[str] | None = None) -> None:
    wanted = _parsed(argv)
    spark = SparkSession.builder.appName("tracery").getOrCreate()
    docs = _docs(spark, wanted)
    block_sizes, factors = [int(x) for x in wanted.bs.split(",")], [float(x) for x in wanted.sf.split(",")]
    parameters = shards.Parameters(block_size=block_sizes[0], factor=factors[0])
    if wanted.command == "list":
        patterns = read_patterns(spark, wanted.patterns)
        write_lists(search.lists_by_pattern(search.list_docs(docs, patterns), patterns), wanted.out)
    elif wanted.command == "doc-array":
        shards.suffixes_of(shards.build(docs, parameters, arrays=False)).select("shard", "sa", "doc_id").write.parquet(wanted.out)
    elif wanted.command == "index":
        shards.build(docs, parameters, arrays=False).write.parquet(wanted.out)
    else:
        for line in sweep(spark, docs, read_patterns(spark, wanted.patterns), block_sizes, factors, wanted.print_size):
            print(line)


if __name__ == "__main__":
    main()
