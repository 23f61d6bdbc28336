import pytest
from pyspark.sql import functions as F


def docs_of(spark, texts, ids=None):
    """Documents with further columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("block", "node", "tie", "host", "score", "row", "token", "n", "rank", "words", "rest"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def found(df, *columns):
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated, and not ASCII."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    return [None, "", " \n\t ", "x", long, "one two three", "one two three", "é ü 漢字 😀\x0bz", "a" * 5000, "A b c"]
