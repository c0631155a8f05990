"""M1-M5, M7: adaptive muting of weak features on the (bounded) importance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.importance import VI_THRESHOLD

LEVELS = ("no", "moderate", "aggressive")
MIN_FEATURES = 5


def mute(vi: DataFrame, level: str = "moderate", floor: float = VI_THRESHOLD,
         min_features: int = MIN_FEATURES, fallback_all: bool = False) -> DataFrame:
    """M1-M4: flag ``kept`` and the final ``threshold`` on an importance table.

    no -> 0; moderate -> max(floor, mean); aggressive -> max(floor, median).
    Fewer than ``min_features`` survivors keep the top ``min_features`` and the
    threshold becomes the last kept score (M2); with ``min_features=0`` and
    ``fallback_all`` an empty selection keeps everything (M4).
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    w = Window.partitionBy()  # the importance table has one row per feature
    base = {"no": F.lit(0.0),
            "moderate": F.greatest(F.lit(floor), F.avg("vi").over(w)),
            "aggressive": F.greatest(F.lit(floor), F.median("vi").over(w))}[level]
    t = vi.withColumn("t0", base)
    t = t.withColumn("n_pass", F.sum(F.when(F.col("vi") >= F.col("t0"), 1).otherwise(0)).over(w))
    t = t.withColumn("n_all", F.count(F.lit(1)).over(w))
    short = F.col("n_pass") < F.lit(min_features)
    kept = F.when(short, F.col("rank") <= F.lit(min_features)).otherwise(F.col("vi") >= F.col("t0"))
    if fallback_all:
        kept = F.when(F.col("n_pass") == 0, F.lit(True)).otherwise(kept)
    fifth = F.min(F.when(F.col("rank") <= F.lit(min_features), F.col("vi"))).over(w)
    thr = F.when(short & (F.col("n_all") > 0) & F.lit(min_features > 0), fifth).otherwise(F.col("t0"))
    if fallback_all:
        thr = F.when(F.col("n_pass") == 0, F.col("t0")).otherwise(thr)
    return t.select(*vi.columns, kept.alias("kept"), thr.alias("threshold"))


def mute_report(muted: DataFrame) -> DataFrame:
    """M5: counts and percentages of kept and muted features, and the threshold."""
    return muted.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.col("kept").cast("int")).cast("bigint").alias("n_kept"),
        F.max("threshold").alias("threshold"),
    ).select("n_total", "n_kept", (F.col("n_total") - F.col("n_kept")).alias("n_muted"),
             (F.col("n_kept") / F.col("n_total") * 100.0).alias("pct_kept"),
             ((F.col("n_total") - F.col("n_kept")) / F.col("n_total") * 100.0).alias("pct_muted"),
             "threshold")


def muting_schedule(vi: DataFrame) -> DataFrame:
    """M7: progressive muting drops the i weakest features at step i+1.

    Stored compactly: a feature with ascending rank r is kept for steps 1..r,
    so the (step, feature) membership is ``step <= last_step`` (O(p) rows)."""
    asc = F.row_number().over(Window.orderBy("vi", F.desc("idx")))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return vi.select("feature", "idx", "vi", asc.alias("last_step"), n.alias("n_features"))


def kept_features(muted: DataFrame) -> list[str]:
    """Surviving features in importance order (a bounded collect: one row per feature)."""
    return [r["feature"] for r in muted.where("kept").orderBy("rank").select("feature").collect()]
