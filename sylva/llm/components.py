"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns a and b, longs): root is the component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour; both are
    aggregates with a partial step and joins that can be split, so a node with very many links is no single task's
    work.  Rounds are written to the shared folder; the table ends as one star per component.
    """
    spark = links.sparkSession
    start = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, path = saved(start, "links")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        new, new_path = saved(small, "links")
        discard(spark, path)
        now, path = new, new_path
