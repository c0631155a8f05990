"""Approximate nearest neighbours (operator 7): stable projections in a kd-tree, stopped by a chi-square test.

Unit vectors are projected on a few Gaussian directions.  The squared distance of two projections over the squared distance
of the vectors is chi-square distributed with as many degrees of freedom, so once projected
neighbours are farther than ``d * sqrt(quantile)``, with ``d`` the distance of the worst neighbour kept,
a nearer vector is left out with probability at most ``1 - confidence`` each.

* The upper kd-tree is fitted on a bounded sample (``SAMPLE`` projected points); each of its leaves is a
  group of about ``LEAF`` vectors, and every vector is in one.
* A query searches its own leaf first, which bounds ``d``; then all other leaves whose box is within the
  stopping radius.  Inside a leaf a lower kd-tree gives buckets by distance; buckets, and points in them, beyond the radius are not
  verified, and the radius shrinks with ``d``.
* A task holds one leaf's vectors; queries stream past them in batches.

Equal vectors are one point that carries its ``k + 1`` smallest ids, all that can ever be among the k nearest;
equal query vectors are searched once.

Defined results: vectors that are null, of another length than most, zero, or hold null or non-finite components, and rows
with a null id, take no part; rows that repeat id and vector are one; a query has fewer than k
neighbours only if there are fewer candidates; ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.llm.common import saved

DIRECTIONS = 8
CONFIDENCE = 0.99
LEAF = 16_384
BUCKET = 128
SAMPLE = 131_072
SEED = 7


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for j in range(1, degrees // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projected(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors' products with the fixed Gaussian directions."""
    directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIRECTIONS))
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ directions


class Tree:
    """A kd-tree's splits (heap order), and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, 2**depth - 1), dtype=np.int64)
        self.value = np.zeros(len(self.axis))
        self.low = np.full((2**depth, points.shape[1]), -np.inf)
        self.high = np.full((2**depth, points.shape[1]), np.inf)
        self._split(points, 0, 0)

    def _split(self, points: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            return
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.value[node] = axis, value
        width = 2 ** (self.depth - level)
        first = (node + 1 - 2**level) * width
        left, right = slice(first, first + width // 2), slice(first + width // 2, first + width)
        self.high[left, axis] = np.minimum(self.high[left, axis], value)
        self.low[right, axis] = np.maximum(self.low[right, axis], value)
        goes_left = points[:, axis] <= value
        self._split(points[goes_left], 2 * node + 1, level + 1)
        self._split(points[~goes_left], 2 * node + 2, level + 1)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def distance(self, point: np.ndarray) -> np.ndarray:
        """From a point to every leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.sqrt((gap * gap).sum(axis=1))


class Leaf:
    """The vectors of one leaf, in buckets of a lower kd-tree."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        at = projected(vectors)
        tree = Tree(at, max(0, math.ceil(math.log2(max(1, len(at)) / BUCKET))))
        bucket = tree.leaf(at)
        order = np.argsort(bucket, kind="stable")
        self.vectors, self.at, self.ids = vectors[order], at[order], [ids[i] for i in order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.bounds = np.searchsorted(bucket[order], np.arange(2**tree.depth + 1))
        self.tree = tree

    def search(self, query: np.ndarray, most: int, distance: float, stop: float) -> list[tuple[float, int]]:
        """The ``most`` nearest (-cosine, id), no farther than ``distance`` while that bounds the search."""
        point, norm = projected(query[None])[0], math.sqrt(float((query * query).sum()))
        gaps = self.tree.distance(point)
        best: list[tuple[float, int]] = []
        for b in np.argsort(gaps, kind="stable").tolist():
            if gaps[b] > distance * stop:
                break
            rows = np.arange(self.bounds[b], self.bounds[b + 1])
            rows = rows[np.sqrt(((self.at[rows] - point) ** 2).sum(axis=1)) <= distance * stop]
            if not len(rows):
                continue
            scores = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
            if len(best) == most:
                good = scores >= -best[-1][0]
                rows, scores = rows[good], scores[good]
            best += [(-s, i) for s, r in zip(scores.tolist(), rows.tolist(), strict=True) for i in self.ids[r]]
            best = sorted(best)[:most]
            if len(best) == most:
                distance = min(distance, math.sqrt(max(0.0, 2 + 2 * best[-1][0])))
        return best


def _valid(id_col: str, vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(points: DataFrame, queries: DataFrame, most: int, stop: float) -> DataFrame:
    """(q1, q2, id, score) from the leaf that each query names."""
    both = points.select("leaf", F.lit(0).alias("kind"), "vector", "ids", F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2"), F.lit(0.0).alias("bound")).unionByName(
        queries.select("leaf", F.lit(1).alias("kind"), "vector", F.array().cast("array<bigint>").alias("ids"), "q1", "q2", "bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vectors, ids, built = None, [], [], None
        for batch in batches:
            out = []
            leaves, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            matrix, listed = _matrix(batch.column(2)), batch.column(3).to_pylist()
            for i, (leaf, kind) in enumerate(zip(leaves, kinds, strict=True)):
                if leaf != number:
                    number, vectors, ids, built = leaf, [], [], None
                if kind == 0:
                    vectors.append(matrix[i])
                    ids.append(listed[i])
                    continue
                if built is None and vectors:
                    built = Leaf(np.array(vectors), ids)
                    vectors, ids = [], []
                if built is not None:
                    q = (batch.column(4)[i].as_py(), batch.column(5)[i].as_py())
                    out += [(*q, v, -s) for s, v in built.search(matrix[i], most, batch.column(6)[i].as_py(), stop)]
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.float64())], names=["q1", "q2", "id", "score"])

    return both.repartition("leaf").sortWithinPartitions("leaf", "kind").mapInArrow(run, "q1 long, q2 long, id long, score double")


def _nearest(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def nearest(table: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): by cosine, each query's k nearest among all other ids."""
    spark = table.sparkSession
    raw = F.col(vector_col).cast("array<float>")
    sizes = table.where(raw.isNotNull()).groupBy(F.size(raw).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    rows = table.select(F.col(id_col).alias("id"), raw.alias("vector"), is_query.alias("asks")).where(_valid("id", F.col("vector"), size)) \
                .groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    rows, _ = saved(rows, "vectors")
    most = k + 1
    by_id = Window.partitionBy("vector").orderBy("id")
    distinct = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= most).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct, _ = saved(distinct, "points")
    total = distinct.count()

    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    drawn = distinct.select("vector").where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE).toArrow().column("vector").combine_chunks()
    sample = projected(_matrix(drawn)) if len(drawn) else np.zeros((0, DIRECTIONS))
    tree = Tree(sample, max(0, math.ceil(math.log2(max(1, total) / LEAF))))
    stop = math.sqrt(chi_square_quantile(CONFIDENCE, DIRECTIONS))

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = tree.leaf(projected(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    points = distinct.mapInArrow(with_leaf, "vector array<float>, ids array<bigint>, leaf int")
    asked = rows.where("asks").groupBy("vector").agg(F.min("id").alias("q1")).select("vector", "q1", F.xxhash64("vector").alias("q2"))
    asked, _ = saved(asked.mapInArrow(with_leaf, "vector array<float>, q1 long, q2 long, leaf int"), "queries")
    home, _ = saved(_nearest(_search(points, asked.withColumn("bound", F.lit(float("inf"))), most, stop), most), "home")
    worst = home.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    bound = F.when(F.col("n") == most, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).otherwise(F.lit(float("inf")))

    def other_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, near = projected(_matrix(batch.column(0))), []
            for point, leaf, distance in zip(at, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = np.flatnonzero(tree.distance(point) <= distance * stop)
                near.append(found[found != leaf])
            row = pa.array(np.repeat(np.arange(len(near)), [len(x) for x in near]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(row) for i in (0, 1, 2)), pa.array(np.concatenate(near).astype(np.int32)), batch.column(4).take(row)], names=["vector", "q1", "q2", "leaf", "bound"])

    away = (asked.join(worst, ["q1", "q2"], "left").select("vector", "q1", "q2", "leaf", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
            .mapInArrow(other_leaves, "vector array<float>, q1 long, q2 long, leaf int, bound double"))
    best = _nearest(home.drop("place").unionByName(_search(points, away, most, stop)), most)
    ids = rows.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("q2"), "vector")
    asker = ids.join(asked.select("vector", "q1"), "vector").select("query_id", "q1", "q2")
    order = Window.partitionBy("query_id", "q2").orderBy("place")
    return (asker.join(best, ["q1", "q2"]).where("id != query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
