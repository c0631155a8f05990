"""Operator 7 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import ann
from sylva.llm.queries import op7_ann


def brute(rows, asks, k):
    rows = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i, v in rows:
        if asks(i):
            s = np.round(x @ v / (norm * np.linalg.norm(v)), 12)
            best = sorted((-a, int(b)) for a, b in zip(s, ids) if b != i)[:k]
            out[int(i)] = [(b, -a) for a, b in best]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_quantile():
    assert abs(ann.chi_square_quantile(0.99, 8) - 20.090) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.386) < 1e-3


def test_op7_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = by_query(op7_ann(spark, sf)), brute(rows, lambda i: i % 50 == 0, 5)
    assert sorted(got) == sorted(want) and recall(got, want) >= 0.95
    score = {q: dict(v) for q, v in brute(rows, lambda i: i % 50 == 0, len(rows)).items()}
    for q, found in got.items():
        assert len(found) == 5 and all(abs(score[q][i] - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_many_leaves(spark, monkeypatch):
    """A deep upper tree, many equal vectors, small buckets."""
    monkeypatch.setattr(ann, "LEAF", 100)
    monkeypatch.setattr(ann, "BUCKET", 16)
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((30, 24))
    x = (centres[rnd.integers(0, 30, 1500)] + 0.3 * rnd.standard_normal((1500, 24))).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = by_query(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 20 == 0, 5))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    assert sorted(got) == sorted(want) and recall(got, want) >= 0.95
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 1.0]), (100, None), (10, [2.0, 0.0])]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = by_query(ann.nearest(table, F.col("vec_id") % 50 == 0, 5))
    assert got.keys() == {0, 50}
    assert [i for i, _ in got[0]] == [8, 10, 9, 50]
    assert [i for i, _ in got[50]] == [9, 0, 8, 10]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert ann.nearest(table.where("vec_id = 0"), F.col("vec_id") % 50 == 0, 5).count() == 0
