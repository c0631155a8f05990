"""Write a results table under the reference's file-name rule."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def results_name(source: Column) -> Column:
    """``results_<stem>.csv`` where the stem is the source name without '.csv'."""
    return F.concat(F.lit("results_"), F.replace(source, F.lit(".csv"), F.lit("")), F.lit(".csv"))


def results_name_py(source: str) -> str:
    return "results_" + source.replace(".csv", "") + ".csv"


def write_results(df: DataFrame, out_dir: str, source_name: str, fmt: str = "csv") -> str:
    """A5: leaderboards are small (one row per model), so one output file is fine."""
    path = os.path.join(out_dir, results_name_py(source_name))
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path
