"""Shared pieces of the registered queries: rounding and the standard analysis chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.stats import exact_mean
from sylva.operators.importance import variable_importance
from sylva.sources import fixtures as fx

DIGITS = 6


def snap(c, digits: int = DIGITS):
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE operations in Spark and DuckDB,
    so equal inputs give bit-equal outputs (``round`` differs between engines on ties)."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Snap every double column to a decimal grid (the oracle snaps the same way)."""
    return df.select(*[snap(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def emb_vi(spark, sf) -> DataFrame:
    """Statistical importance of the 64 embedding dimensions (classification on label)."""
    return variable_importance(fx.emb_wide(spark, sf), w_model=0.0, w_stat=1.0)


def line_multi_vi(spark, sf) -> DataFrame:
    fr = fx.line_multi(spark, sf)
    numeric = fr.with_df(fr.df, [c for c in fr.feature_cols if c != "l_linestatus"])
    return variable_importance(numeric, w_model=0.0, w_stat=1.0)


def board(errors: DataFrame) -> DataFrame:
    """A leaderboard per model derived from the error table (B-9)."""
    from sylva.functions.naming import family
    return errors.groupBy("model").agg(
        F.count_distinct("rep").cast("int").alias("features"),
        F.avg(F.when(F.col("error") < 150, 1.0).otherwise(0.0)).alias("train_accuracy"),
        F.avg(F.when(F.col("error") < 100, 1.0).otherwise(0.0)).alias("test_accuracy"),
        (F.sum("error") / 1000.0).alias("train_time"),
    ).withColumn("type", family(F.col("model")))


def model_errors(errors: DataFrame) -> DataFrame:
    return errors.groupBy("model").agg(exact_mean(F.col("error")).alias("error"))
