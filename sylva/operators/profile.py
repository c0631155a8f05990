"""Profiling aggregates, each a bounded number of passes over the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.frame import Frame, numeric_cols
from sylva.functions.stats import exact_mean, exact_quantiles, pearson_pairs, quantile_frame, to_long

QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per numeric column.

    Moments come from one wide aggregate (partial aggregation map-side); the
    quartiles from the distributed exact order-statistic search.
    """
    cols = list(cols or numeric_cols(df))
    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), exact_mean(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()  # one row
    known = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    plain = all(v[2] is None or not math.isnan(v[2]) for v in known.values())  # a NaN would be its column's largest value
    moments = spark.createDataFrame([(i, c, *[row[f"{k}{i}"] for k in ("n", "m", "s", "lo", "hi")]) for i, c in enumerate(cols)],
                                    "idx int, feature string, n long, mean double, std double, min double, max double")
    quartiles = exact_quantiles(to_long(df, [], cols), "feature", "value", list(QUARTILES), stats=known if plain else None)
    qs = quantile_frame(spark, quartiles, "feature", QUARTILES, keys=cols)
    return moments.join(qs, "feature").select("idx", "feature", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def target_summary(fr: Frame) -> DataFrame:
    """Describe of the target; its range is ``min``/``max``."""
    return describe(fr.df, [fr.target_col])


def target_distribution(df: DataFrame, col: str) -> DataFrame:
    """Class -> count and share of non-null rows, most frequent first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).count()
    # the class table is tiny (one row per class): a global window is fine here
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("value", "count", (F.col("count") / total).alias("share"))


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with at least one missing value, with count and percentage."""
    cols = list(cols or df.columns)
    dtypes = dict(df.dtypes)

    def missing(c):
        x = F.col(c)
        cond = x.isNull() | F.isnan(x) if dtypes[c] in ("double", "float") else x.isNull()
        return F.sum(F.when(cond, 1).otherwise(0)).alias(f"m{cols.index(c)}")

    wide = df.agg(F.count(F.lit(1)).alias("n"), *[missing(c) for c in cols])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("n", f"stack({len(cols)}, {stack}) as (column, missing)")
    return long.where("missing > 0").select(
        "column", F.col("missing").cast("bigint").alias("missing"),
        (F.col("missing") / F.col("n") * 100.0).alias("percentage"))


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (nulls compare equal, as in pandas)."""
    grouped = df.groupBy(*df.columns).count()
    return grouped.agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("duplicates"),
        ((F.col("n_rows") - F.col("n_distinct")) / F.col("n_rows") * 100.0).alias("percentage"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson for every numeric pair, pairwise-complete, as a long table (a, b, corr).

    Partial sums per pair (``pearson_pairs``), however many columns; the matrix is mirrored
    and the diagonal is 1 (null for a constant column), as pandas prints it.
    """
    half = pearson_pairs(df, list(cols or numeric_cols(df)))
    return half.union(half.where("a != b").select("b", "a", "corr"))


def target_correlation(fr: Frame, k: int = 10) -> DataFrame:
    """Signed correlation of each numeric feature with the target, largest first, top k."""
    feats = [c for c in numeric_cols(fr.df) if c in fr.feature_cols]
    long = pearson_pairs(fr.df, feats, fr.target_col).select(F.col("a").alias("feature"), "corr")
    return long.orderBy(F.desc_nulls_last("corr"), "feature").limit(k)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed; empty bins kept."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    width = (hi - lo) / bins
    idx = (F.lit(0) if hi == lo else
           F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).count()
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """C11: quartiles, 1.5 IQR whiskers (furthest points inside the fences), outlier count."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    qmap = exact_quantiles(df.select(F.lit(col).alias("k"), x.alias("v")), "k", "v", list(QUARTILES))
    q1, q2, q3 = (qmap[(col, q)] for q in QUARTILES)
    if q1 is None:
        return spark.createDataFrame([], "q1 double, median double, q3 double, iqr double, "
                                         "lower_whisker double, upper_whisker double, n_outliers bigint")
    iqr = q3 - q1
    lo_f, hi_f = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    inside = (x >= F.lit(lo_f)) & (x <= F.lit(hi_f))
    return df.agg(
        F.min(F.when(inside, x)).alias("lower_whisker"), F.max(F.when(inside, x)).alias("upper_whisker"),
        F.sum(F.when(x.isNotNull() & ~inside, 1).otherwise(0)).cast("bigint").alias("n_outliers"),
    ).select(F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
             F.lit(iqr).alias("iqr"), "lower_whisker", "upper_whisker", "n_outliers")
