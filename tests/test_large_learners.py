"""Learners of tables that no task holds: counted cells, boosting on them, Newton steps, draws without wide temporaries."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sylva.models import bounded, logistic
from sylva.models.cells import cells, unpacked
from sylva.models.registry import boosting, l1_logistic, l2_logistic


def _table(spark, n=900, seed=0, classes=None):
    """Few different values a feature, so that every cut lies between neighbours for MLlib and for us."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(-5, 6, n) / 4, rng.integers(0, 3, n)]).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * x[:, 2] + rng.normal(size=n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    rows = [(i, [float(c) for c in v], float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double").withColumn("features", array_to_vector("x")).cache()


def _by_id(df, column):
    return np.array([r[0] for r in df.orderBy("row_id").select(column).collect()], dtype=float)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_on_cells_is_mllibs(spark, monkeypatch, task):
    table = _table(spark, classes=2 if task == "classification" else None)
    est = (GBTClassifier if task == "classification" else GBTRegressor)(maxIter=13, maxDepth=3, stepSize=0.1, seed=42)
    want = est.fit(table).transform(table)
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 0)
    score = boosting(task, 13, 3, 0.1).fit(table)
    assert hasattr(score, "__self__")  # the cells' model, not MLlib's
    got = score(table)
    np.testing.assert_allclose(_by_id(got, "prediction"), _by_id(want, "prediction"), rtol=1e-6, atol=1e-6)
    if task == "classification":
        from pyspark.ml.functions import vector_to_array
        np.testing.assert_allclose(_by_id(got, F.col("probability")[1]), _by_id(want.withColumn("probability", vector_to_array("probability")), F.col("probability")[1]), rtol=1e-6)


def test_boosting_on_cells_for_three_classes(spark, monkeypatch):
    table = _table(spark, classes=3)
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 0)
    got = boosting("classification", 12, 3, 0.3).fit(table)(table)
    assert (_by_id(got, "prediction") == _by_id(table, "label")).mean() > 0.8
    assert got.select(F.size("probability")).distinct().collect() == [(3,)]


def test_rows_of_equal_bins_are_one_cell(spark):
    """What a round reads does not grow with the rows once the grid's cells are met."""
    table = _table(spark, 400, classes=2).select("x", "label")
    points = [np.array([2.5, 7.5]), np.array([0.0]), np.array([0.5])]
    sizes = []
    for times in (1, 7):
        many = table.crossJoin(spark.range(times)).drop("id")
        stats = np.concatenate([s for batch in cells(many, points, True).toArrow().to_batches() for _, s, _ in unpacked(batch, np.uint8, 3)])
        assert stats[:, 1].sum() == 400 * times
        sizes.append(len(stats))
    assert sizes[0] == sizes[1] <= 3 * 2 * 2 * 2


@pytest.mark.parametrize("x, y", [([1.0, None], 0.0), ([1.0, 2.0], None)])
def test_nulls_are_refused_not_learned_from(spark, x, y):
    rows = spark.createDataFrame([(x, y), ([1.0, 2.0], 1.0)], "x array<double>, label double")
    for make in (lambda: cells(rows, [np.array([1.5])] * 2, True), lambda: logistic.fit(rows)):
        with pytest.raises(Exception, match="must not be null"):
            make()


@pytest.mark.parametrize("l1, l2", [(0.02, 0.0), (0.0, 0.01), (0.0, 0.0)])
def test_newton_reaches_the_optimum(spark, l1, l2):
    table = _table(spark, classes=2)
    w, b = logistic.fit(table, l1, l2)
    x, y = np.array([r.x for r in table.collect()]), np.array([r.label for r in table.collect()])
    g = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y) + l2 * w
    for slope, weight in zip(g, w, strict=True):
        assert abs(slope + l1 * np.sign(weight)) < 1e-5 if weight else abs(slope) <= l1 + 1e-5
    est = LogisticRegression(elasticNetParam=1.0 if l1 else 0.0, regParam=l1 or l2, standardization=False, maxIter=1000, tol=1e-12)
    model = est.fit(table)
    np.testing.assert_allclose([*w, b], [*model.coefficients, model.intercept], rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("learner", [l1_logistic, l2_logistic])
def test_logistic_of_large_tables_scores_as_mllib(spark, monkeypatch, learner):
    table = _table(spark, classes=2)
    want = learner().fit(table)(table)
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 0)
    score = learner().fit(table)
    assert len(score.weights) == 3  # by Newton steps
    np.testing.assert_allclose(_by_id(score(table), F.col("probability")[1]), _by_id(want, F.col("probability")[1]), atol=2e-3)


def test_readers_of_a_large_split_do_not_shuffle(spark, sf, monkeypatch):
    from sylva.plans.catalog import _assembled_split
    from sylva.sources import fixtures as fx
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 0)
    train, test = _assembled_split(fx.line_reg(spark, sf))
    for part in (train, test):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()


def test_draws_by_32_bit_numbers_and_the_sine_series():
    from sylva.functions.hashing import MASK32, STRIDE, TWO_32
    from sylva.operators.prepare import _np_cos_turn, _np_gaussians, _np_mix32
    rk, js = np.array([0, 1, 77, 2**32 - 1, 123456789]), np.arange(5, 500)
    def u(c):
        x = (rk.astype(np.uint64)[:, None] + c.astype(np.uint64) * np.uint64(STRIDE)) & np.uint64(MASK32)
        return (_np_mix32(x).astype(float) + 0.5) / TWO_32
    want = np.sqrt(-2.0 * np.log(u(js * 2))) * np.cos(2.0 * math.pi * u(js * 2 + 1))
    np.testing.assert_allclose(_np_gaussians(rk, js), want, rtol=0, atol=1e-14)
    turn = np.linspace(0, 1, 10_001)
    np.testing.assert_allclose(_np_cos_turn(turn), np.cos(2 * math.pi * turn), rtol=0, atol=2e-15)


def test_forest_on_cells_is_grown_from_all_rows(spark, monkeypatch):
    """Large tables of classes: the same forest for any layout, of counted cells; pure leaves, MLlib's accuracy, cuts at MLlib's places."""
    from sylva.models import forest
    from sylva.models.registry import random_forest
    table = _table(spark, 1200, classes=3)
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 0)
    scores = [random_forest("classification", 20, "sqrt", 3).fit(t) for t in (table.repartition(5), table.coalesce(1))]
    shown = [sorted((r.tree, tuple(r.feat), tuple(r.thr), tuple(r.value)) for r in s.model.subtrees.collect()) for s in scores]
    assert shown[0] == shown[1] and len(shown[0]) == 20 and scores[0].model.importances.sum() == pytest.approx(1)
    got = scores[0](table)
    assert got.columns == ["row_id", "label", "prediction", "probability"] and got.count() == 1200
    assert (_by_id(got, "prediction") == _by_id(table, "label")).mean() > 0.85
    middles = [np.unique(np.array([r.x for r in table.collect()])[:, j]) for j in range(3)]
    for _, feat, thr, _ in shown[0]:
        for f, t in zip(feat, thr):
            assert f < 0 or t in ((middles[f][1:] + middles[f][:-1]) / 2)
    monkeypatch.setattr(forest, "held", lambda *_: False)  # too many cells: MLlib's
    assert not hasattr(random_forest("classification", 3, "sqrt", 3).fit(table), "model")


def test_cell_weights_are_bootstrap_sums(spark, monkeypatch):
    """A cell of many rows has the weight of as many Poisson(1) draws: root shares spread as a bootstrap's."""
    from sylva.models import forest
    rows = spark.range(4000).selectExpr("id AS row_id", "array(CAST(id % 4 AS double)) AS x", "CAST(id % 4 >= 2 AS double) AS label")
    model = forest.fit(rows, 2, 200, None, 30, 128, 42)
    share = np.array([r.value[0] for r in model.subtrees.collect()])
    assert abs(share.mean() - 0.5) < 0.003 and 0.6 < share.std() / np.sqrt(0.25 / 4000) < 1.4


def test_trees_in_groups_score_alike(spark):
    """A forest of more nodes than may be sent is scored by groups of trees, without a join of rows and subtrees."""
    from sylva.models.extra_trees import ExtraTrees
    table = _table(spark, 500, classes=3).drop("features")
    model = ExtraTrees("classification", 4, seed=2, local_rows=200).fit(table)
    assert 1 <= max(len(g) for g in model._groups(model.n_nodes // 2)) < 4
    want = {r.row_id: r.probability for r in model.transform(table).collect()}
    out = model.transform(table, broadcast_nodes=model.n_nodes // 2)
    assert out.columns == [*table.columns, "probability", "prediction"] and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.row_id: r.probability for r in out.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_the_root_is_read_once_for_all_trees(spark, monkeypatch):
    """Ranges of the root are gathered once, not once a tree, and a forest of one level deals no rows out."""
    from sylva.models import extra_trees as module
    table = _table(spark, 300, classes=2)
    seen = []
    monkeypatch.setattr(module, "saved", lambda df, name: seen.append(name) or kept(df, name))
    from sylva.session import saved as kept
    model = module.ExtraTrees("classification", 5, 3, max_depth=1, local_rows=10, n_classes=2).fit(table)
    assert seen == ["candidates", "splits"] and model.subtrees.count() == 0
    rows = [(r.x, r.label) for r in table.collect()]
    for s in model.splits.collect():
        assert s.n_left == sum(x[s.feature] <= s.threshold for x, _ in rows) and s.n_left + s.n_right == 300
        assert s.left_value[1] == pytest.approx(sum(y for x, y in rows if x[s.feature] <= s.threshold) / s.n_left)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_cells_in_one_task_are_boosted_alike(spark, monkeypatch, classes):
    """The trees over held cells are those of a job a level, and no level is a job."""
    from sylva.models import boosting as module
    table = _table(spark, 700, classes=classes or None)
    monkeypatch.setattr(module, "FOLD", 2)
    args = (table, classes, 5, 3, 0.3)
    jobs = []
    monkeypatch.setattr(module, "summed", lambda *a, of=module.summed: jobs.append(1) or of(*a))
    held = module.Boosted(*args)
    assert not jobs
    monkeypatch.setattr(module, "HELD_BYTES", 0)
    dealt = module.Boosted(*args)
    assert jobs and len(held.models) == len(dealt.models) == (3 if classes == 3 else 1)
    for a, b in zip(sum(held.models, []), sum(dealt.models, []), strict=True):
        assert a.feat.tolist() == b.feat.tolist() and a.cut.tolist() == b.cut.tolist()
        np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)


def test_three_classes_are_studied_with_whole_forests(spark, sf, monkeypatch):
    """``embedded_study_multi`` fits as many trees and rounds as the reference."""
    from sylva.models import rlt
    from sylva.models.registry import N_TREES
    from sylva.plans.catalog import QUERIES
    told = {}
    monkeypatch.setattr(rlt, "importance", lambda train, names, task, n_trees=None, **_: told.update(vi=n_trees) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        QUERIES["embedded_study_multi"](spark, sf)
    assert told == {"vi": N_TREES} == {"vi": 100}


@pytest.mark.parametrize("tries, depth, at_once", [(1, 30, 1 << 20), (2, 30, 300), (4, 3, 1 << 20)])
def test_counted_cells_grow_the_tree_of_sorted_ones(monkeypatch, tries, depth, at_once):
    """Weights added up by bin give the tree that sorting the cells gives, so more cells need not go to MLlib's forest."""
    from sylva.models import forest
    from sylva.models.extra_trees import _route
    monkeypatch.setattr(forest, "SUMS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 40, 2500), rng.integers(0, 7, 2500), np.full(2500, 3), rng.integers(0, 2, 2500)]).astype(np.uint8)
    y = ((x[:, 0] > 17).astype(int) + (x[:, 1] > 4)) % 3
    y = np.where(rng.random(2500) < 0.1, rng.integers(0, 3, 2500), y)
    w = rng.poisson(rng.integers(1, 5, 2500))
    want = bounded.grow_best(x, y.astype(float), w.astype(float), "classification", 3, tries, 1, depth, 77, 0.0)
    got = forest.grow_cells([np.ascontiguousarray(c) for c in x.T], y, w, 3, tries, depth, 77, 40)
    assert len(got[0]) == len(want[0]) > 5
    np.testing.assert_allclose(got[4], want[4])
    np.testing.assert_allclose(got[3][_route(x, *got[:3])], want[3][_route(x, *want[:3])])
    assert sorted(zip(got[0].tolist(), got[1])) == sorted(zip(want[0].tolist(), np.floor(want[1])))


def test_more_cells_than_local_numbers_stay_in_the_forest(spark, monkeypatch):
    """What a task may hold of cells is counted in bytes of bins, class and rows; they no longer go to MLlib's forest beyond ``LOCAL_NUMBERS`` numbers."""
    from sylva.models import forest
    monkeypatch.setattr(forest, "LOCAL_NUMBERS", 10, raising=False)
    rows = spark.range(3000).selectExpr("id AS row_id", "array(CAST(id % 50 AS double), CAST(id % 7 AS double)) AS x", "CAST(id % 50 >= 20 AS double) AS label")
    model = forest.fit(rows, 2, 3, None, 30, 128, 42)
    assert model is not None and {r.prediction == r.label for r in model.transform(rows).collect()} == {True}


def test_predictions_are_written_without_ids(spark, monkeypatch):
    from sylva.models import registry
    seen = []
    monkeypatch.setattr(registry, "saved", lambda df, name, **how: seen.append((name, df.columns)) or df)
    table = _table(spark, 60, classes=2)
    registry.run_models(table, table, [registry.Learner("L", lambda t: lambda df: df.select("row_id", "label", F.col("label").alias("prediction")))], "classification").collect()
    assert seen == [("predictions", ["label", "prediction", "probability", "part", "model"])]
