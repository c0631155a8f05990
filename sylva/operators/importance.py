"""Statistical variable importance, blending and ranking.

Per-feature statistics are computed in one long-form pass
``(feature, value, label)``: partial aggregates per (feature, class) are
combined map-side, so a class or feature holding a third of the rows is just a
bigger partial sum, never a bigger group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.frame import CLASSIFICATION, Frame, detect_problem_type
from sylva.functions.stats import pearson_pairs, to_long

# Fixed values of the reference's importance blend.
VI_THRESHOLD = 0.01
W_MODEL = 0.5
W_STAT = 0.5
F_SCALE = 1000.0


def long_frame(fr: Frame) -> DataFrame:
    """(feature, value, label) for every feature of the frame."""
    lab = F.col(fr.target_col).cast("string").alias("label")
    src = fr.df.select(*[F.col(c).cast("double").alias(c) for c in fr.feature_cols], lab)
    return src.unpivot(["label"], list(fr.feature_cols), "feature", "value")


def anova_f(long: DataFrame) -> DataFrame:
    """One-way ANOVA F of value across label groups, per feature.

    Null when the within-group variance is zero (constant feature)."""
    g = (long.where(F.col("value").isNotNull() & F.col("label").isNotNull())
         .groupBy("feature", "label")
         .agg(F.count("value").alias("n"), F.avg("value").alias("m"),
              (F.var_pop("value") * F.count("value")).alias("ssw")))
    w = Window.partitionBy("feature")  # one row per class: bounded by the number of classes
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum("ssw").alias("ssw"))
    f = (F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(
        F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return s.select("feature", f.alias("f_stat"))


def abs_pearson(fr: Frame) -> DataFrame:
    """|corr(feature, y)| per feature, null-safe, partial sums per feature."""
    return pearson_pairs(fr.df, list(fr.feature_cols), fr.target_col).select(F.col("a").alias("feature"), F.abs("corr").alias("abs_corr"))


def normalize(scores: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Divide by the column total when it is positive (missing scores count as 0).

    The score table has one row per feature, so a whole-table window is bounded."""
    out = out or col
    x = F.coalesce(F.col(col), F.lit(0.0))
    total = F.sum(x).over(Window.partitionBy())
    return scores.withColumn(out, F.when(total > 0, x / total).otherwise(x))


def feature_index(fr: Frame) -> DataFrame:
    spark = fr.df.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(fr.feature_cols)], "feature string, idx int")


def statistical_scores(fr: Frame) -> DataFrame:
    """The statistical half of E5: F/1000 (classification) or |r| (regression)."""
    kind = detect_problem_type(fr)
    if kind == CLASSIFICATION:
        return anova_f(long_frame(fr)).select("feature", (F.col("f_stat") / F_SCALE).alias("vi_stat_raw"))
    return abs_pearson(fr).select("feature", F.col("abs_corr").alias("vi_stat_raw"))


def variable_importance(fr: Frame, w_model: float = W_MODEL, w_stat: float = W_STAT,
                        model_scores: DataFrame | None = None) -> DataFrame:
    """vi = w_model * normalised model importance + w_stat * normalised statistic.

    ``model_scores`` is ``(feature, vi_model_raw)`` from a forest (E1); rows are
    ranked by vi descending, feature position breaking ties.
    """
    idx = feature_index(fr)
    stat = statistical_scores(fr) if w_stat > 0 else idx.select("feature", F.lit(0.0).alias("vi_stat_raw"))
    t = idx.join(stat, "feature", "left")
    if model_scores is not None:
        t = t.join(model_scores, "feature", "left")
    else:
        t = t.withColumn("vi_model_raw", F.lit(0.0))
    t = normalize(t, "vi_stat_raw", "vi_stat")
    t = normalize(t, "vi_model_raw", "vi_model")
    vi = F.lit(w_model) * F.col("vi_model") + F.lit(w_stat) * F.col("vi_stat")
    t = t.withColumn("vi", vi)
    rank = F.row_number().over(Window.orderBy(F.desc("vi"), "idx"))  # one row per feature
    return t.select("feature", "idx", "vi_model", "vi_stat", "vi", rank.alias("rank"))


def vi_stats(vi: DataFrame) -> DataFrame:
    """Median, mean and population std of the importance scores."""
    return vi.agg(F.median("vi").alias("median"), F.avg("vi").alias("mean"), F.stddev_pop("vi").alias("std"),
                  F.count(F.lit(1)).alias("n"))


def top_features(vi: DataFrame, k: int = 15) -> DataFrame:
    """The k most important features."""
    return vi.where(F.col("rank") <= k)
