import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that operators use for their own columns
                     T.StructField("score", T.StringType()), T.StructField("start", T.StringType()), T.StructField("fingerprint", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("row", T.StringType()), T.StructField("th", T.StringType())])


def as_docs(spark, rows):
    """(doc_id, text) pairs as a table of documents with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, repeated rows and ids, ties, blanks of many kinds, a very long text."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "A.B", "x y"]
    base = " ".join(rnd.choices(vocab, k=120))
    rows = [(1, None), (2, ""), (3, "   "), (None, "null id here"), (4, base), (5, base), (6, base + " tail one"), (6, base + " tail one"),
            (6, "same id other text"), (7, "a  b\t c\r\n\n d  "), (8, " ".join(rnd.choices(vocab, k=30_000))), (9, "x " * 400),
            (10, "\n".join([base] * 3)), (11, base.upper()), (12, "one"), (13, "one"), (14, "<|endoftext|> ’s don't 12 3²")]
    for i in range(20, 60):
        t = " ".join(rnd.choices(vocab, k=rnd.randint(1, 200)))
        rows.append((i, t if rnd.random() < 0.6 else t[: len(t) // 2] + " " + base[rnd.randint(0, 50) :]))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return as_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_rows(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
