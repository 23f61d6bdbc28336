import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracery.__main__ import main
from tracery.plans.ranks import globally_ranked
from tracery.sources import collection as c
from tracery.sources.collection import read_patterns


def test_delimited_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "TATA"), (2, "LÄTA\nx"), (3, "AAAA")], "doc_id long, text string")
    c.write_delimited(docs, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data == "TATA\0LÄTA\nx\0AAAA\0".encode()
    (tmp_path / "data").write_bytes(data)
    assert rows(c.read_delimited(spark, str(tmp_path / "data"))) == rows(docs)
    (tmp_path / "bad").write_bytes(b"a\x01b\0")
    with pytest.raises(Exception, match="reserved"):
        c.read_delimited(spark, str(tmp_path / "bad")).collect()


def test_patterns_and_lists(spark, tmp_path):
    (tmp_path / "patterns").write_text("TA\n\nA\n")
    assert rows(c.read_patterns(spark, str(tmp_path / "patterns"))) == [(1, "TA"), (3, "A")]
    c.write_lists(spark.createDataFrame([("TA", [1, 2])], "pattern string, docs array<long>"), str(tmp_path / "lists"))
    assert "".join(p.read_text() for p in (tmp_path / "lists").glob("part-*")) == "TA\t1 2\n"


def test_load_or_build(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert c.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert built == [1]


def test_header(spark):
    df = spark.createDataFrame([("# number=10 length=20 file=x",)], "h string")
    assert df.select(c.header_field(F.col("h"), "number"), c.header_field(F.col("h"), "length")).first() == (10, 20)
    with pytest.raises(Exception, match="no forbidden"):
        df.select(c.header_field(F.col("h"), "forbidden")).collect()


def test_ranks_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert all(r["x"] == r["rank"] for r in globally_ranked(df, "x").collect())


def test_files_are_numbered_by_name(spark, tmp_path):
    (tmp_path / "many").mkdir()
    sizes = [3, 50, 1, 20, 7]
    for i, n in enumerate(sizes):
        (tmp_path / "many" / f"part-{i}.txt").write_text("".join(f"{i}-{k}\n" for k in range(n)))
    got = read_patterns(spark, str(tmp_path / "many")).orderBy("pattern_id").collect()
    assert [r["pattern"] for r in got] == [f"{i}-{k}" for i, n in enumerate(sizes) for k in range(n)]
    assert [r["pattern_id"] for r in got] == list(range(1, sum(sizes) + 1))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "docs").write_bytes(b"TATA\0LATA\0AAAA\0")
    (tmp_path / "patterns").write_text("TA\nLT\nA\n")
    where = ["--data", str(tmp_path / "docs"), "--delimited", "--patterns", str(tmp_path / "patterns")]
    main(["list", *where, "--out", str(tmp_path / "lists")])
    lines = sorted(line for p in (tmp_path / "lists").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ["A\t1 2 3", "LT\t", "TA\t1 2"]
    main(["doc-array", *where, "--out", str(tmp_path / "array")])
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "array")).orderBy("shard", "sa").collect()].count(3) == 4
    main(["index", *where, "--out", str(tmp_path / "index"), "--bs", "2", "--sf", "1.5"])
    assert spark.read.parquet(str(tmp_path / "index")).count() >= 1
    capsys.readouterr()
    main(["sweep", *where, "--bs", "2,8", "--sf", "4"])
    shown = capsys.readouterr().out.splitlines()
    assert len(shown) == 9 and shown[0].startswith("scan: ") and any(line.startswith("nodes bs=8 sf=4: ") for line in shown)
    with pytest.raises(SystemExit):
        main(["list", "--data", "x", "--out", "y"])
