"""A1-A4: table scans and their shape/preview/column-info reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.frame import Frame, split_target

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
               target: str | None = None, id_cols=("row_id",)) -> Frame:
    """A1: header CSV (types inferred unless a schema is given) or Parquet; last column = target."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    else:
        df = reader.format(fmt).load(path)
    # pandas reads NaN and empty cells alike as missing: turn NaN into null once, here.
    df = df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name)
                     if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                     for f in df.schema.fields])
    return split_target(df, target, id_cols)


def shape(fr: Frame) -> DataFrame:
    """A2: rows, number of features, target name."""
    return fr.df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(fr.p).cast("int").alias("n_features"), F.lit(fr.target_col).alias("target"))


def preview(fr: Frame, n: int = 5, order_by=None) -> DataFrame:
    """A3: first n rows; Spark has no row order, so the order is made explicit."""
    keys = order_by or list(fr.id_cols) or [fr.df.columns[0]]
    return fr.df.orderBy(*keys).limit(n)


def column_info(fr: Frame) -> DataFrame:
    """A4: name, dtype, non-null count per column, in one aggregate pass."""
    cols = fr.df.columns
    counts = fr.df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"{i}, c{i}" for i in range(len(cols)))
    long = counts.selectExpr(f"stack({len(cols)}, {stack}) as (pos, non_null)")
    spark = fr.df.sparkSession
    meta = spark.createDataFrame(
        [(i, c, fr.df.schema[c].dataType.simpleString()) for i, c in enumerate(cols)],
        "pos int, column string, dtype string")
    # meta is bounded by the number of columns
    return long.join(F.broadcast(meta), "pos").select("pos", "column", "dtype", "non_null")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file written by ``sinks.write_results`` as CSV."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
