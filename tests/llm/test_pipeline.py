"""The whole pipeline against a plain version of its stages, and the queries against their SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.conftest import docs_of  # noqa: E402
from tests.llm.test_windows import plain_classes, plain_decontamination  # noqa: E402
from tracery.llm import toxicity  # noqa: E402
from tracery.llm.pii import DEMO_KEY, pseudonymise  # noqa: E402
from tracery.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tracery.llm.tables import read, written  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    table = {r["doc_id"]: r for r in docs.collect()}
    kept, results = list(table), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(before, read(spark, SF, "labels")).collect()}
            kept = [d for d in kept if not scores[d]]
        elif name == "jaccard_join":
            kept = sorted({c for _, _, c in plain_classes([(d, table[d]["text"]) for d in kept])[0]})
        elif name == "decontamination":
            items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert all(len(t.split()) >= 8 for _, t in items)
            kept = [d for d, _, _, found in plain_decontamination([(d, table[d]["text"]) for d in kept], items) if not found]
        elif name == "pii":
            results = {r["doc_id"]: r["text"] for r in pseudonymise(read(spark, SF, "documents"), DEMO_KEY).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {d: results[d] for d in kept}
            assert any(results[d] != table[d]["text"] for d in kept)
        if name != "packing":
            assert docs.schema == read(spark, SF, "documents").schema
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(kept)
    assert {r["doc_id"] for r in docs.collect()} == set(kept)
    assert 100 < len(kept) < len(table)
    whole = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_odd_rows_and_tables(spark, tmp_path, odd_texts):
    """Nulls in any column, empty and very long texts, repeated rows, other columns with clashing names, an empty table."""
    item = " ".join(f"b{i}" for i in range(12))
    tables = {
        "benchmark": spark.createDataFrame([(1, item), (None, None)], "item_id long, text string"),
        "labels": spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, None, 1), (5, None, None)], "doc_id long, quality int, toxic int"),
    }
    texts = [f"word{i} stands here with river{i} and stone{i} " + ("moron scum" if i % 4 == 0 else "garden") for i in range(60)]
    texts += [*odd_texts, f"x {item} y", "mail me at ann@example.org now", "mail me at ann@example.org now"]
    full = docs_of(spark, texts, [*range(len(texts) - 2), 7, None]).withColumn("lang", F.lit(None).cast("string"))
    for name, docs in (("full", full), ("empty", full.limit(0)), ("bare", full.select("doc_id", "text"))):
        for table, df in {**tables, "documents": docs}.items():
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        sf_dir = f"{tmp_path}/{name}"
        kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, written(f(spark, kept, sf_dir), stage)
            assert kept.schema == before.schema
        packed = corpus_pipeline.run(spark, sf_dir)
        rows = [tuple(r) for r in packed.select("doc_id", "piece", "sequence_id", "offset", "length").collect()]
        if name == "empty":
            assert rows == []
            continue
        said = {r["text"] for r in kept.collect()}
        assert {None, "", "x"} <= said and not any(t and (item in t or "ann@" in t or "moron" in t) for t in said)
        assert kept.filter("text like 'one two three%'").count() == 1 and kept.filter("text like 'mail me%'").count() == 1
        assert {r[0] for r in rows} == {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    assert got == sorted(repr(tuple(r[names.index(c)] for c in order)) for r in cursor.fetchall())
