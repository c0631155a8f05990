"""Helpers shared by the operators: intermediate tables, row keys, byte-level words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.session import ensure_checkpoint_dir

#: Bytes that separate words where a word is ASCII letters, ASCII digits and everything beyond ASCII.
_ALNUM = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: bytes.translate table: A-Z to a-z, every other ASCII byte that is no word byte to a space.
WORD_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _ALNUM else 0x20 for b in range(256))
#: bytes.translate table: A-Z to a-z, all else unchanged.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/sylva-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders that no returned DataFrame reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def row_keys(id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("k1", "k2")) -> list:
    """Two 64-bit columns that tell rows apart by id and text, never null; exact repeats of a row share them."""
    i, t = F.col(id_col), F.col(text_col)
    return [F.xxhash64(i, t).alias(names[0]), F.xxhash64(F.lit(1), t, i).alias(names[1])]
