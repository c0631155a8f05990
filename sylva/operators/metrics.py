"""Model metrics as plain aggregates over (label, prediction).

Each takes an optional ``group`` (e.g. ``["model"]``) so a whole bake-off is
scored in one job over a long prediction table.  The confusion table is
bounded by groups x classes^2, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              group: list[str] | None = None) -> DataFrame:
    g = list(group or [])
    return pred.groupBy(*g, F.col(label).alias("y"), F.col(prediction).alias("p")).count()


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           group: list[str] | None = None) -> DataFrame:
    """Accuracy, error, support-weighted precision / recall / F1 (0/0 -> 0)."""
    g = list(group or [])
    conf = confusion(pred, label, prediction, g)
    by_true = conf.groupBy(*g, F.col("y").alias("cls")).agg(
        F.sum("count").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("count"))
                                              .otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(*g, F.col("p").alias("cls")).agg(F.sum("count").alias("npred"))
    per = by_true.join(by_pred, [*g, "cls"], "left")
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("npred"), F.lit(0)), F.lit(0.0))
    rec = F.col("tp") / F.col("support")
    f1 = F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0))
    per = per.select(*g, "support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    out = per.groupBy(*g).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.sum(F.col("support") * F.col("prec")).alias("wp"), F.sum(F.col("support") * F.col("rec")).alias("wr"),
        F.sum(F.col("support") * F.col("f1")).alias("wf"))
    return out.select(
        *g, "n", (F.col("correct") / F.col("n")).alias("accuracy"),
        (1 - F.col("correct") / F.col("n")).alias("error"),
        (F.col("wp") / F.col("n")).alias("precision"), (F.col("wr") / F.col("n")).alias("recall"),
        (F.col("wf") / F.col("n")).alias("f1_score"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       group: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R^2 = 1 - SSE/SST."""
    g = list(group or [])
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    r = y - p
    out = pred.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"),
        F.sum(r * r).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return out.select(*g, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"))


def auc_ovr(scores: DataFrame, label: str = "label", score: str = "score", cls: str = "cls",
            group: list[str] | None = None) -> DataFrame:
    """One-vs-rest ROC-AUC per class and its macro mean (Mann-Whitney, ties count 1/2).

    Input is long: one row per (row, class) with that class's score (any number).
    Counts are first combined per distinct (class, score) and sorted by ranges of (class, score), so equal scores lie in one partition.  A
    partition adds up, for each class it holds, positives, negatives and positives times the negatives below them there; the negatives of
    earlier partitions come in by prefix sums over these few rows.
    """
    g = list(group or [])
    pos = (F.col(label) == F.col(cls)).cast("long")
    per = scores.groupBy(*g, cls, F.col(score).alias("s")).agg(F.sum(pos).alias("np"), F.sum(1 - pos).alias("nn"))
    keys = [*g, cls]
    dealt = per.withColumn("_k", F.xxhash64(*keys)).repartitionByRange(*keys, "s").sortWithinPartitions(*keys, "s")
    told = T.StructType([*[per.schema[c] for c in keys], T.StructField("part", T.IntegerType()), T.StructField("n_pos", T.LongType()), T.StructField("n_neg", T.LongType()),
                         T.StructField("u", T.DoubleType())])
    totals = dealt.select(*keys, "_k", "np", "nn").mapInArrow(_rank_sums(told, len(keys)), told)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per class and partition
    whole = totals.withColumn("below", F.coalesce(F.sum("n_neg").over(earlier), F.lit(0)))
    per_cls = whole.groupBy(*keys).agg(F.sum(F.col("u") + F.col("n_pos").cast("double") * F.col("below")).alias("u"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return per_cls.select(*keys, (F.col("u") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"))


def _rank_sums(schema: T.StructType, n_keys: int):
    """From sorted rows (keys, their hash, positives, negatives): sums for each key of a partition, one row each."""
    def run(batches):
        part, now, first, sums = TaskContext.get().partitionId(), None, None, [0, 0, 0.0]

        def row():
            return pa.RecordBatch.from_arrays([*first.columns[:n_keys], pa.array([part], pa.int32()), pa.array([sums[0]], pa.int64()), pa.array([sums[1]], pa.int64()), pa.array([sums[2]], pa.float64())], names=schema.names)

        for batch in batches:
            key, pos, neg = (batch.column(n_keys + i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and key[a] != now:
                    yield row()
                    sums = [0, 0, 0.0]
                if now is None or key[a] != now:
                    now, first = key[a], batch.slice(a, 1)
                below = sums[1] + np.cumsum(neg[a:b]) - neg[a:b]
                sums = [sums[0] + int(pos[a:b].sum()), sums[1] + int(neg[a:b].sum()), sums[2] + float((pos[a:b] * (below + 0.5 * neg[a:b])).sum())]
        if now is not None:
            yield row()

    return run


def auc_macro(per_class: DataFrame, group: list[str] | None = None) -> DataFrame:
    g = list(group or [])
    return per_class.groupBy(*g).agg(F.avg("auc").alias("roc_auc"))
