"""Property tests: splits, normalisation, muting rules, order statistics, invariance."""

import math

import numpy as np
from pyspark.sql import functions as F

from sylva.functions.stats import exact_quantiles, kth_values
from sylva.operators import compare, muting, prepare
from sylva.plans.common import emb_vi
from sylva.sources import fixtures as fx


def test_split_disjoint_and_sized(spark, sf):
    fr = fx.line_reg(spark, sf)
    flagged = prepare.split(fr, 0.2, 42)
    n = fr.df.count()
    agg = flagged.agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t"),
                      F.count_distinct("row_id").alias("d")).first()
    assert agg["n"] == n and agg["d"] == n
    assert agg["t"] == math.ceil(0.2 * n)


def test_split_partition_invariant(spark, sf):
    fr = fx.line_reg(spark, sf)
    a = prepare.split(fr.with_df(fr.df.repartition(1)), 0.2, 42).where("is_test").select("row_id")
    b = prepare.split(fr.with_df(fr.df.repartition(7)), 0.2, 42).where("is_test").select("row_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stratified_split_per_class(spark, sf):
    fr = fx.line_multi(spark, sf)
    flagged = prepare.split(fr, 0.2, 42, stratify=True)
    for r in flagged.groupBy("l_returnflag").agg(F.count("*").alias("n"),
                                                 F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r["t"] == math.floor(0.2 * r["n"] + 0.5)


def test_sample_split_size(spark, sf):
    fr = fx.line_reg(spark, sf)
    n = fr.df.count()
    t = prepare.sample_split(fr, 150, 0.7, 42).where("is_train").count()
    assert t == min(150, math.floor(0.7 * n))


def test_kth_values_exact(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(size=3000), 3)  # many ties
    df = spark.createDataFrame([("a", float(v)) for v in vals], "k string, v double")
    ranks = [0, 1, 17, 1499, 1500, 2999]
    got = kth_values(df, [("a", r) for r in ranks], buckets=16, pick_limit=64)
    s = np.sort(vals)
    for r in ranks:
        assert got[("a", r)] == s[r]
    q = exact_quantiles(df, "k", "v", [0.25, 0.5, 0.75])
    for p in (0.25, 0.5, 0.75):
        assert abs(q[("a", p)] - np.quantile(vals, p)) < 1e-12


def test_importance_normalised(spark, sf):
    vi = emb_vi(spark, sf)
    agg = vi.agg(F.sum("vi").alias("s"), F.min("vi").alias("m"), F.count("*").alias("n")).first()
    assert abs(agg["s"] - 1.0) < 1e-9 and agg["m"] >= 0 and agg["n"] == 64


def test_mute_floor_keeps_five(spark, sf):
    vi = emb_vi(spark, sf)
    for level in muting.LEVELS:
        kept = muting.mute(vi, level).where("kept").count()
        assert kept >= 5


def test_relative_error_min_is_one(spark, sf):
    errs = fx.event_errors(spark, sf).groupBy("model").agg(F.avg("error").alias("error"))
    rel = compare.relative_errors(errs)
    assert abs(rel.agg(F.min("relative_error")).first()[0] - 1.0) < 1e-12
    assert rel.where("rank = 1").first()["medal"] == "gold"


def test_noise_expansion_shape_and_determinism(spark, sf):
    fr = fx.line_reg(spark, sf)
    a = prepare.expand_with_noise(fr.with_df(fr.df.repartition(1)), 40, 0.5, 42)
    b = prepare.expand_with_noise(fr.with_df(fr.df.repartition(5)), 40, 0.5, 42)
    assert a.p == 40 and len(a.df.columns) == 42
    cols = ["row_id", "nz0005", "nz0039"]
    assert a.df.select(*cols).exceptAll(b.df.select(*cols)).count() == 0


def test_constant_feature_scores_zero(spark, sf):
    from sylva.operators.importance import variable_importance
    vi = variable_importance(fx.const_col(spark, sf), w_model=0.0, w_stat=1.0)
    row = vi.where("feature = 'const_one'").first()
    assert row["vi"] == 0.0


def test_auc_any_scores(spark):
    """One-vs-rest AUC per group, for scores of any size that pile up on few values."""
    from sylva.operators.metrics import auc_ovr
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(0, 2)), float(c), float(s)) for g in ("a", "b") for c in (0, 1)
            for s in np.concatenate([rng.normal(size=150) * 9 - 4, np.full(150, 0.5)])]
    got = {(r.g, r.cls): r.auc for r in auc_ovr(spark.createDataFrame(rows, "g string, label double, cls double, score double"), group=["g"]).collect()}
    assert len(got) == 4
    for (g, c), auc in got.items():
        pos, neg = ([s for h, y, k, s in rows if h == g and k == c and (y == c) == side] for side in (True, False))
        want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert abs(auc - want) < 1e-9


def test_split_hash_guess_and_dedupe(spark):
    """Equal rows keep the smallest id; a wrong guess changes no order statistic."""
    from sylva.frame import Frame
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", 1)], "row_id int, x string, y int")
    assert sorted(map(tuple, prepare.drop_duplicates(Frame(df, ("x",), "y", ("row_id",), None)).df.collect())) == [(1, "a", 1), (2, "b", 1)]
    base = spark.range(5000).selectExpr("'k' AS k", "cast(id AS double) AS v")
    for guess in ((0.0, 10.0), (2400.0, 2600.0), (4000.0, 4999.0)):
        assert kth_values(base, [("k", 2500)], pick_limit=64, guess={("k", 2500): guess})[("k", 2500)] == 2500.0


def test_one_hot_vector(spark):
    from sylva.frame import Frame
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "row_id int, x string")
    got = {r.row_id: r.one_hot.toArray().tolist() for r in prepare.one_hot_vector(Frame(df, ("x",), "x", ("row_id",), None), "x").collect()}
    assert got == {1: [0, 0], 2: [0, 1], 3: [1, 0], 4: [0, 0]}


def test_progressive_runs_every_step(spark):
    """A row for each step asked for, beyond 50 features too."""
    from sylva.models.registry import Learner
    from sylva.models.rlt import progressive_muting
    from sylva.models import rlt

    def constant(task, n_trees):
        return Learner("RandomForest", lambda train: lambda df: df.select("row_id", "label", F.lit(0.0).alias("prediction")))

    p = 53
    rows = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(p)], float(i % 2)) for i in range(12)], "row_id int, x array<double>, label double")
    vi = spark.createDataFrame([(f"f{i}", i, float(i), i) for i in range(p)], "feature string, idx int, vi double, rank int")
    given, rlt.importance = rlt.importance, lambda *a, **k: vi
    try:
        steps = [0, 50, 51, 52]
        out = progressive_muting(rows, rows, [f"f{i}" for i in range(p)], "classification", steps=steps, with_time=False, learner=constant)
        assert sorted(r.variables_kept for r in out.collect()) == [1, 2, 3, 53]
    finally:
        rlt.importance = given


def _parts(flagged, flag="is_test"):
    """How often each row is in either part."""
    from collections import Counter
    out = Counter()
    for r in flagged.collect():
        out[tuple(v for c, v in r.asDict().items() if c != flag), r[flag]] += 1
    return out


def test_split_is_exact_where_ids_repeat(spark):
    """Rows out are rows in and exactly k of them are test rows: with one id only, ids repeated in groups, and rows equal altogether."""
    from sylva.frame import Frame
    one = [(7, float(i), "a") for i in range(40)]
    groups = [(i // 9, float(i), "ab"[i % 2]) for i in range(90)]
    equal = [(3, 1.0, "a")] * 53 + [(3, 1.0, "b")] * 24
    for rows in (one, groups, equal, equal + one + groups):
        df = spark.createDataFrame(rows, "row_id long, v double, c string").repartition(5)
        fr = Frame(df, ("v",), "c", ("row_id",), "classification")
        for stratify in (False, True):
            got = _parts(prepare.split(fr, 0.2, 42, stratify=stratify))
            seen = {}
            for (row, _), n in got.items():
                seen[row] = seen.get(row, 0) + n
            assert seen == {row: rows.count(row) for row in set(rows)}
            test = {c: sum(n for (row, t), n in got.items() if t and row[2] == c) for c in "ab"}
            if stratify:
                assert test == {c: math.floor(0.2 * sum(r[2] == c for r in rows) + 0.5) for c in "ab"}
            else:
                assert sum(test.values()) == math.ceil(0.2 * len(rows))
        drawn = _parts(prepare.sample_split(fr, 15, 0.7, 42), "is_train")
        assert sum(n for (_, t), n in drawn.items() if t) == 15 and sum(drawn.values()) == len(rows)
