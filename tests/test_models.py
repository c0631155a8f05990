"""Model fits: bounds on the signal fixtures (rows/metric checks, not oracles)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.models.extra_trees import ExtraTrees, _route, grow, root_key
from sylva.models.registry import adaboost, assemble, extra_trees, lasso, random_forest, run_models
from sylva.operators import prepare
from sylva.sources import fixtures as fx


def _split(spark, sf, fixture):
    fr = fixture(spark, sf)
    flagged = prepare.split(fr, 0.2, 42)
    data = assemble(fr.with_df(flagged)).join(flagged.select("row_id", "is_test"), "row_id").cache()
    return fr, data.where(~F.col("is_test")), data.where(F.col("is_test"))


def test_grow_to_purity():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0).astype(float)
    feat, thr, left, value, imp = grow(x, y, "classification", 2, 2, 1, None, root_key(42, 0), 0)
    leaves = _route(x, feat, thr, left)
    assert (value[leaves].argmax(axis=1) == y).all()       # grown to purity: fits the training rows
    assert imp.argmax() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_same_forest_for_any_layout(spark, sf, task):
    """Where nodes are grown, how rows are dealt and how rows meet the forest change nothing; rows keep repeated ids."""
    fr, tr, te = _split(spark, sf, fx.line_bin if task == "classification" else fx.line_reg)
    tr = tr.limit(250).select("x", "label").cache()
    te = te.limit(100).select(F.lit(7).alias("row_id"), "x", "label", F.monotonically_increasing_id().alias("i")).cache()
    seen = []
    for local_rows, parts in ((40, 1), (40, 8), (10_000, 2)):
        model = ExtraTrees(task, n_trees=3, seed=3, local_rows=local_rows, min_leaf=2).fit(tr.repartition(parts))
        for nodes in (10**6, 0)[: 2 if parts == 8 else 1]:
            out = model.transform(te, broadcast_nodes=nodes)
            assert out.columns[:4] == te.columns
            rows = sorted((r.i, round(r.prediction, 6)) for r in out.collect())
            assert len(rows) == te.count()
            seen.append((rows, np.round(model.importances, 7).tolist()))
    assert all(x == seen[0] for x in seen)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_same_forest_without_anything_sent(spark, sf, task, monkeypatch):
    """With a bound of one number, rows meet candidates, splits and subtrees by joins only; the forest and its scores are the same."""
    from sylva.models import extra_trees as module

    fr, tr, te = _split(spark, sf, fx.line_bin if task == "classification" else fx.line_reg)
    tr = tr.limit(250).select("x", "label").cache()
    te = te.limit(60).select("x", "label", F.monotonically_increasing_id().alias("i")).cache()
    fit = lambda: ExtraTrees(task, n_trees=2, seed=3, local_rows=40, min_leaf=2).fit(tr)
    sent = fit()
    monkeypatch.setattr(module, "OPEN_NUMBERS", 1)
    met = fit()
    shown = lambda m: sorted((r.tree, r.node, r.feature, round(r.threshold, 9)) for r in m.splits.collect())
    assert shown(sent) == shown(met) and len(shown(met)) > 2
    scores = [sorted((r.i, round(r.prediction, 6)) for r in m.transform(te, broadcast_nodes=b).collect()) for m, b in ((sent, 10**6), (met, 10**6), (met, 0))]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == te.count()


def test_extra_trees_degenerate(spark):
    one = spark.createDataFrame([([1.0, 2.0], 1.0)] * 5, "x array<double>, label double")
    out = ExtraTrees("regression", n_trees=2).fit(one).transform(one).collect()
    assert [r.prediction for r in out] == [1.0] * 5
    out = ExtraTrees("classification", n_trees=2).fit(one).transform(one).collect()
    assert [r.prediction for r in out] == [1.0] * 5


def test_adaboost_first_stump_useless(spark):
    """No stump beats chance: the first one stays, rows are scored once each."""
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(1, [0.0], 0.0), (1, [0.0], 1.0), (2, [0.0], 0.0), (2, [0.0], 1.0)], "row_id int, x array<double>, label double")
    rows = rows.withColumn("features", array_to_vector("x"))
    assert adaboost(5, 1.0).fit(rows)(rows).count() == 4


@pytest.mark.parametrize("classes", [2, 3])
def test_adaboost_rounds_by_hand(spark, monkeypatch, classes):
    """Stumps, errors and votes' weights equal a plain loop over all cuts, also where weights are written in between."""
    from sylva.models import stumps as module

    monkeypatch.setattr(module, "FOLD", 2)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.8 * (classes - 2))) % classes
    y = np.where(rng.random(300) < 0.1, rng.integers(0, classes, 300), y)
    table = spark.createDataFrame([([float(v) for v in r], float(c)) for r, c in zip(x, y)], "x array<double>, label double").repartition(3)
    got = module.boost(table, classes, 6, 0.5, cuts=9)
    points = module.cut_points(table, 3, 9)
    for j in range(3):
        q = np.quantile(x[:, j], np.arange(1, 10) / 10)
        assert np.allclose(points[j], np.unique(q[q < x[:, j].max()]))
    w = np.ones(300)
    for stump in got:
        best = (-1.0,)
        share = lambda m: np.array([w[m & (y == c)].sum() for c in range(classes)])
        for j in range(3):
            for t in points[j]:
                a, b = share(x[:, j] <= t), share(x[:, j] > t)
                gain = (a**2).sum() / a.sum() + (b**2).sum() / b.sum() - ((a + b) ** 2).sum() / (a + b).sum()
                if gain > best[0] + 1e-9 * w.sum():
                    best = (gain, j, t, a.argmax(), b.argmax())
        assert (stump.feature, stump.left, stump.right) == (best[1], *best[3:]) and stump.threshold == pytest.approx(best[2])
        miss = np.where(x[:, stump.feature] <= stump.threshold, stump.left, stump.right) != y
        error = w[miss].sum() / w.sum()
        assert stump.error == pytest.approx(error) and stump.alpha == pytest.approx(0.5 * (np.log((1 - error) / error) + np.log(classes - 1)))
        w = w * np.exp(stump.alpha * miss)
    assert len(got) == 6


def test_adaboost_votes(spark, sf):
    """The one-projection score equals a vote counted by hand."""
    fr, tr, te = _split(spark, sf, fx.line_bin)
    score = adaboost(8, 0.5).fit(tr)
    for r in score(te.limit(50)).join(te.select("row_id", "x"), "row_id").collect():
        votes = [sum(s.alpha for s in score.stumps if (s.left if r.x[s.feature] <= s.threshold else s.right) == c) for c in (0, 1)]
        assert r.prediction == float(np.argmax(votes))


def test_extra_trees_classifier_bounds(spark, sf):
    fr, tr, te = _split(spark, sf, fx.line_bin)
    model = ExtraTrees("classification", n_trees=10, seed=1, local_rows=3000, n_classes=2).fit(tr)
    assert abs(model.importances.sum() - 1.0) < 1e-9
    assert int(np.argmax(model.importances)) == 1       # l_extendedprice carries the signal
    pred = model.transform(te)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_bakeoff_regression(spark, sf):
    fr, tr, te = _split(spark, sf, fx.line_reg)
    res = run_models(tr, te, [extra_trees("regression", n_trees=5), lasso(),
                              random_forest("regression", n_trees=10)], "regression", fr.p).collect()
    assert len(res) == 3
    for r in res:
        assert r["test_r2"] > 0.9
        assert r["train_time"] >= 0


def test_extra_trees_partition_invariant(spark, sf):
    """Classification sums are exact counts: the forest is identical on any layout."""
    fr, tr, _ = _split(spark, sf, fx.line_bin)
    a = ExtraTrees("classification", n_trees=2, seed=7, local_rows=2500, n_classes=2).fit(tr.repartition(1))
    b = ExtraTrees("classification", n_trees=2, seed=7, local_rows=2500, n_classes=2).fit(tr.repartition(5))
    assert a.n_nodes == b.n_nodes
    assert np.allclose(a.importances, b.importances)
    for table in ("splits", "subtrees"):
        rows = [sorted(map(str, getattr(m, table).drop("imp").collect())) for m in (a, b)]
        assert rows[0] == rows[1]


def test_extra_trees_regression_layout_stable(spark, sf):
    """Regression sums merge in any order; ties are broken by rule, so importances agree."""
    fr, tr, _ = _split(spark, sf, fx.line_reg)
    a = ExtraTrees("regression", n_trees=2, seed=7, local_rows=2500).fit(tr.repartition(1))
    b = ExtraTrees("regression", n_trees=2, seed=7, local_rows=2500).fit(tr.repartition(5))
    assert np.allclose(a.importances, b.importances, rtol=1e-3, atol=1e-6)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_rlt_model_is_kept_and_loaded(spark, sf, tmp_path, task):
    """All of it comes back from the path: features, combinations, upper levels, subtrees, scaling."""
    from sylva.models.rlt import RLTModel, rlt

    fr, tr, te = _split(spark, sf, fx.line_bin if task == "classification" else fx.line_reg)
    tr, te = tr.limit(300).cache(), te.limit(80).cache()
    model = rlt(task, list(fr.feature_cols), n_trees=5, top_n=4).fit(tr).model
    model.save(f"{tmp_path}/m")
    again = RLTModel.load(spark, f"{tmp_path}/m")
    assert again.features == model.features and again.forest.n_nodes == model.forest.n_nodes
    assert sorted(map(str, again.transform(te).select("row_id", "prediction").collect())) == sorted(map(str, model.transform(te).select("row_id", "prediction").collect()))
    assert again.forest.importances.tolist() == model.forest.importances.tolist()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_held_columns_grow_the_same_forest(spark, monkeypatch, task):
    """A table that is too large for a group but small as coded columns is held by the tasks: the forest of the distributed levels, for any layout; for
    importances alone no node is written."""
    from sylva.models import extra_trees as module

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 7, 3000), rng.normal(size=3000), rng.integers(0, 300, 3000) / 4, np.ones(3000)]).astype(float)
    y = x[:, 0] * x[:, 1] + x[:, 2] / 9 + rng.normal(size=3000)
    y = (y > 4).astype(float) + (y > 9) if task == "classification" else y
    table = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)], "x array<double>, label double").repartition(3).cache()
    fit = lambda **how: ExtraTrees(task, n_trees=2, seed=5, **how).fit(table)
    monkeypatch.setattr(module, "LOCAL_NUMBERS", 5000)
    held, levels, alone = fit(), fit(local_rows=1000), fit(nodes=False)
    assert held.splits.count() == 0 and held.root_state == module.LOCAL and levels.splits.count() > 0
    score = lambda m: np.array([r.prediction for r in m.transform(table).select("prediction").collect()])
    np.testing.assert_allclose(score(levels), score(held), rtol=1e-9)
    for model in (levels, alone):
        np.testing.assert_allclose(model.importances, held.importances, rtol=1e-9)
    assert alone.subtrees.selectExpr("max(size(feat))").first()[0] == 0
    with pytest.raises(ValueError, match="importances only"):
        alone.transform(table)


def test_rows_split_in_groups_grow_the_same_tree(monkeypatch):
    """Bounding the rows that are split together changes the order of nodes only."""
    from sylva.models import extra_trees as module

    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 7, 900), rng.normal(size=900), rng.integers(0, 3, 900)]).astype(float)
    for task, y in (("classification", (x[:, 0] > 3) + (rng.random(900) < 0.2).astype(float)), ("regression", x[:, 0] * x[:, 1])):
        told = []
        for rows in (1000, 40):
            monkeypatch.setattr(module, "TOGETHER", rows)
            feat, thr, left, value, imp = grow(x, y, task, 3, 2, 2, None, root_key(4, 1), 0)
            assert (np.sort(np.concatenate([left[feat >= 0], left[feat >= 0] + 1, [0]])) == np.arange(len(feat))).all()
            told.append((len(feat), value[_route(x, feat, thr, left)], imp))
        assert told[0][0] == told[1][0]
        np.testing.assert_allclose(told[1][1], told[0][1])
        np.testing.assert_allclose(told[1][2], told[0][2])


def test_columns_of_few_values_are_bytes():
    from sylva.models.extra_trees import code

    got, values = code(np.array([2.5, -1.0, 2.5, 0.0]))
    assert got.dtype == np.uint8 and values[got].tolist() == [2.5, -1.0, 2.5, 0.0]
    for odd in (np.array([1.0, np.nan]), np.arange(257.0), np.append(np.zeros(5000), np.arange(300.0))):
        assert code(odd)[1] is None
