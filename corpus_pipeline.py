"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm import decontaminate, line_dedup, packing, quality, simhash
from sylva.llm.common import fresh, saved

#: A document goes if it is likelier junk than not.
REJECT_BELOW = 0.5
LINE_RUN = 3
SHINGLE, BITS = 3, 3
SEQUENCE, END_ID = 2048, 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: No SQL can express the classifier, XXH64 fingerprints or best fit; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from three of four labelled rows, as op1 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    score = fresh(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= REJECT_BELOW).drop(score)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; a document of which nothing is left goes."""
    stat = fresh(docs, "lines")
    left = line_dedup.remove_repeated_runs(docs, LINE_RUN, out_col=stat)
    left = left.where((F.col(f"{stat}.n_removed") == 0) | (F.col(f"{stat}.n_removed") < F.col(f"{stat}.n_real"))).drop(stat)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id."""
    return simhash.keep_one(docs, SHINGLE, BITS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    hits = fresh(docs, "hits")
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits)
    return found.where(~decontaminate.contaminated(F.col(f"{hits}.n_hit"), F.col(f"{hits}.n_words"))).drop(hits)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed by best fit."""
    return packing.best_fit(docs, VOCABULARY, SEQUENCE, END_ID)


STAGES = [("quality classifier", quality_filter), ("line dedup", line_filter), ("SimHash near-dedup", near_duplicate_filter),
          ("benchmark decontamination", benchmark_filter), ("best-fit packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = saved(docs, f"stage-{i}")
    return docs
