"""Quality classifier (operator 1): hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, digits and all beyond ASCII, and runs of other characters that are no blanks (so
marks that junk repeats are words too).  Words and pairs of words are hashed into ``2**BITS`` features; all pairs of
a word with itself are one feature.  A text's vector holds the bias with 1 and its n different features with ``1 / sqrt(n)``
each, and its score is a sparse dot product through the logistic function.

Training reads labelled rows only, at most about ``max_rows`` of them (a documented bound: rows are drawn by a hash of the id).
Rows are dealt by hash into a fixed number of shards.  In each round, every shard makes one pass of FTRL-proximal updates (per feature
learning rates, L1 and L2) from the same state, one row at a time in a fixed order, and the driver averages the shards' states:
``shards * 2**BITS`` numbers, whatever the input.

Defined results: null and empty texts have no feature but the bias and a score from that; a label other than 0 or 1, or null, is not used;
rows repeated in labels or documents count each; without labels of both kinds all scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sylva.llm.bytespans import Block, blocks, byte_prefix, prefix, span_hash
from sylva.llm.common import saved

BITS = 18
SHARDS = 4
#: Rounds: enough for about UPDATES updates, within these limits.
ROUNDS, UPDATES = (4, 40), 60_000
MAX_ROWS = 24_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.1

#: 0 blank, 1 letters, digits and beyond ASCII, 2 other.
_KIND = np.array([0 if b == 0x20 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Different hashed features of a block's rows, row after row, and where each row's begin (and the end).

    Feature 0 is the bias; every row has it.
    """
    n = len(block.start)
    kind = _KIND[block.data]
    begins = np.zeros(len(kind) + 1, dtype=bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    begins[block.start[block.start < block.end]] = True
    a = np.flatnonzero(begins[:-1])
    row = np.searchsorted(block.start, a, side="right") - 1
    b = np.minimum(np.append(a[1:], len(kind)), block.end[row])
    real = kind[a] > 0 if len(a) else np.zeros(0, dtype=bool)
    a, b, row = a[real], b[real], row[real]
    one = span_hash(byte_prefix(block.data), a, b)
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = span_hash(prefix(one), pair, pair + 2)
    two[one[pair] == one[pair + 1]] = 1
    mask = np.uint64((1 << BITS) - 1)
    base = np.arange(n, dtype=np.uint64) << np.uint64(BITS)
    # 1 to 2**BITS - 1 are words' features
    keys = [base, (row.astype(np.uint64) << np.uint64(BITS)) | np.maximum(one & mask, 1), (row[pair].astype(np.uint64) << np.uint64(BITS)) | np.maximum(two & mask, 1)]
    found = np.unique(np.concatenate(keys))
    return (found & mask).astype(np.int64), np.searchsorted(found, np.append(base, np.uint64(n) << np.uint64(BITS)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The FTRL-proximal solution for a state."""
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    return w


def values(count: int) -> np.ndarray:
    """The vector's numbers for a row with so many features, the bias first."""
    out = np.full(count, 1 / math.sqrt(max(1, count - 1)))
    out[0] = 1
    return out


def one_pass(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """Updates the state by each row (features, label)."""
    for x, y in rows:
        value = values(len(x))
        w = weights(z[x], n[x])
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(value @ w)))))
        g = (p - y) * value
        step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
        z[x] += g - step * w
        n[x] += g * g


def train(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from the labelled rows for which ``use`` (a condition on the id) holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.where(use)
    total = known.count()
    place = F.xxhash64(F.lit(11), "id")
    if total > max_rows:
        known = known.where(F.pmod(place, F.lit(1 << 30)) < int(max_rows / total * (1 << 30)))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")
            .select("text", "label", F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64(F.lit(12), "id", "text").alias("place")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(0)):
                x, at = features(block)
                found += np.split(x.astype(np.int32), at[1:-1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], names=["x", "label", "shard", "place"])

    sample, _ = saved(rows.mapInArrow(hashed, "x array<int>, label int, shard int, place long"), "labelled")
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return z
    for _ in range(min(ROUNDS[1], max(ROUNDS[0], UPDATES // sum(counts.values())))):
        state = docs.sparkSession.sparkContext.broadcast((z, n))

        def shard_pass(table: pa.Table) -> pa.Table:
            z, n = (v.copy() for v in state.value)  # noqa: B023
            table = table.sort_by("place")
            x = table.column("x").combine_chunks()
            flat, at = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            one_pass([(flat[at[i] : at[i + 1]].astype(np.int64), y) for i, y in enumerate(table.column("label").to_pylist())], z, n)
            return pa.table({"z": pa.array([z], pa.list_(pa.float64())), "n": pa.array([n], pa.list_(pa.float64()))})

        states = sample.groupBy("shard").applyInArrow(shard_pass, "z array<double>, n array<double>").toArrow()
        state.destroy()  # else every round leaves its state on the driver's and the executors' disks
        z, n = (np.mean([states.column(c)[i].values.to_numpy() for i in range(states.num_rows)], axis=0) for c in ("z", "n"))
    return weights(z, n)


def score(docs: DataFrame, model: np.ndarray, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score column from 0 to 1."""
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            out = [np.zeros(0)]
            for block in blocks(batch.column(at)):
                x, ends = features(block)
                sums = np.add.reduceat(w[x], ends[:-1]) - w[0]
                out.append(1 / (1 + np.exp(-w[0] - sums / np.sqrt(np.maximum(1, np.diff(ends) - 1)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*docs_columns, out_col])

    docs_columns = docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
