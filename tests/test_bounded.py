"""Bounded many-model fits: exact thresholds against brute force, models together equal to models alone."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sylva.models import bounded
from sylva.models.bounded import Plan, bootstrap, fit_many, grow_best, lasso_fit
from sylva.models.extra_trees import ExtraTrees, _route, grow, root_key


def explained(y, w, task):
    """What the best leaf value explains, up to a constant."""
    if task == "classification":
        c = np.array([w[y == v].sum() for v in (0, 1)])
        return (c**2).sum() / c.sum() if c.sum() else 0.0
    return (w * y).sum() ** 2 / w.sum() if w.sum() else 0.0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(["classification", "regression"]), st.integers(1, 4))
def test_first_split_is_the_best_of_all(seed, task, min_leaf):
    rng = np.random.default_rng(seed)
    n, p = int(rng.integers(1, 60)), int(rng.integers(1, 5))
    x = np.round(rng.normal(size=(n, p)), 1)
    y = rng.integers(0, 2, n).astype(float) if task == "classification" else np.round(rng.normal(size=n), 2)
    w = rng.poisson(1, n).astype(float)
    feat, thr, left, value, imp = grow_best(x, y, w, task, 2, p, min_leaf, 1, root_key(1, 0))
    best = 0.0
    for f in range(p):
        for t in np.unique(x[w > 0, f])[:-1]:
            side = x[:, f] <= t
            if w[side].sum() >= min_leaf and w[~side].sum() >= min_leaf:
                best = max(best, explained(y[side], w[side], task) + explained(y[~side], w[~side], task) - explained(y, w, task))
    closed = w.sum() < max(2, 2 * min_leaf) or len(set(y[w > 0])) < 2
    if closed or best <= 1e-9 * max(1.0, w.sum()):
        assert len(feat) == 1
    else:
        side = x[:, feat[0]] <= thr[0]
        got = explained(y[side], w[side], task) + explained(y[~side], w[~side], task) - explained(y, w, task)
        assert got == pytest.approx(best, rel=1e-6, abs=1e-9) and imp.sum() == pytest.approx(best, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("block", [1, 1 << 19])
def test_trees_grow_to_purity(monkeypatch, block):
    monkeypatch.setattr(bounded, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 5)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    w = rng.poisson(1, 400).astype(float)
    feat, thr, left, value, _ = grow_best(x, y, w, "classification", 2, 2, 1, None, root_key(7, 3))
    leaf = _route(x, feat, thr, left)
    assert (value[leaf].argmax(axis=1) == y)[w > 0].all() and len(feat) > 30
    for node in np.unique(leaf):
        mine = (leaf == node) & (w > 0)
        assert value[node, 1] == pytest.approx((w * y)[mine].sum() / w[mine].sum())


def test_bootstrap_weights_are_poisson():
    w = np.concatenate([bootstrap(np.arange(20_000) * 7919 % 2**32, t) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_lasso_is_optimal():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 200)) * rng.uniform(0.5, 2, 200)
    y = 3 * x[:, 0] - 2 * x[:, 5] + rng.normal(size=80) + 4
    w, b = lasso_fit(x, y, 0.1, tol=1e-10)
    r = y - x @ w - b
    pull = x.T @ r / 80
    assert abs(r.mean()) < 1e-9 and (np.abs(pull) <= 0.1 + 1e-6).all()
    assert np.allclose(pull[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-6) and 0 < (w != 0).sum() < 80


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 6)), 3)
    y = 2 * x[:, 0] - x[:, 3] + 0.1 * rng.normal(size=120)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(120)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double")


PLANS = [Plan("a", "et", 6, min_leaf=2), Plan("b", "rf", 6, mtry=2), Plan("c", "boost", 8, max_depth=3, rate=0.3, l2=1.0), Plan("d", "lasso"),
         Plan("e", "et", 6, keep=(3, 0), pairs=((0, 3, 0.5, -0.5),)), Plan("f", "rf", 6, keep=(0, 1, 5))]


def by_model(fitted, df):
    out = {}
    for r in fitted.predictions(df).collect():
        out.setdefault(r.model, {})[r.row_id] = r.prediction
    return out


def test_models_together_equal_models_alone(spark, table):
    together = by_model(fit_many(table.repartition(5), PLANS, "regression"), table)
    for plan in PLANS:
        assert by_model(fit_many(table.coalesce(1), [plan], "regression"), table)[plan.name] == pytest.approx(together[plan.name])
    alone = ExtraTrees("regression", 6, min_leaf=2).fit(table).transform(table)
    assert {r.row_id: r.prediction for r in alone.collect()} == pytest.approx(together["a"], rel=1e-9)
    view = table.withColumn("x", F.array(F.col("x")[3], F.col("x")[0], 0.5 * F.col("x")[0] - 0.5 * F.col("x")[3]))
    assert {r.row_id: r.prediction for r in ExtraTrees("regression", 6).fit(view).transform(view).collect()} == pytest.approx(together["e"], rel=1e-9)
    truth = {r.row_id: r.label for r in table.collect()}
    for name in "abcde":
        assert np.mean([(together[name][i] - truth[i]) ** 2 for i in truth]) < 1.0


def test_boosting_by_hand(table):
    """Each tree fits what the ones before leave; leaf values are sums over weight plus penalty."""
    fitted = fit_many(table, [Plan("c", "boost", 1, max_depth=1, rate=0.3, l2=1.0)], "regression")
    rows = table.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    tree = fitted.table.first()
    side = x[:, tree.feat[0]] <= tree.thr[0]
    rest = y - y.mean()
    assert tree.value[1] == pytest.approx(0.3 * rest[side].sum() / (side.sum() + 1))
    assert tree.value[2] == pytest.approx(0.3 * rest[~side].sum() / ((~side).sum() + 1))


@pytest.mark.parametrize("held", [10**9, 0])
def test_classes_and_large_forests(spark, table, monkeypatch, held):
    """Shares sum to one; scoring forest by forest gives the same as one pass."""
    monkeypatch.setattr(bounded, "HELD_NODES", held)
    rows = table.withColumn("label", (F.col("label") > 0).cast("double") + (F.col("label") > 2).cast("double"))
    fitted = fit_many(rows, [Plan("f", "rf", 5), Plan("g", "rf", 5, keep=(0, 3))], "classification", 3)
    got = {(r.model, r.row_id): (r.prediction, r.probability) for r in fitted.predictions(rows).collect()}
    assert len(got) == 240 and all(sum(p) == pytest.approx(1) and p[int(k)] == max(p) for k, p in got.values())
    monkeypatch.setattr(bounded, "HELD_NODES", 10**9)
    again = {(r.model, r.row_id): (r.prediction, r.probability) for r in fitted.predictions(rows).collect()}
    assert all(got[i][0] == again[i][0] and got[i][1] == pytest.approx(again[i][1]) for i in got)


def test_too_large_tables_are_refused(table, monkeypatch):
    monkeypatch.setattr(bounded, "LOCAL_NUMBERS", 100)
    assert not bounded.fits(table)
    with pytest.raises(ValueError, match="at most"):
        fit_many(table, PLANS[:1], "regression")


def test_nested_forests_of_progressive_muting_equal_separate_ones(spark, sf):
    from sylva.models.rlt import progressive_muting
    from sylva.plans.catalog import _assembled_split
    from sylva.sources import fixtures as fx

    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    tr, te = tr.limit(300).cache(), te.limit(200).cache()
    names = list(fr.feature_cols)
    together = {r.step: (r.variables_kept, r.test_accuracy) for r in progressive_muting(tr, te, names, "classification", n_trees=6, with_time=False).collect()}
    assert sorted(together) == [1, 2, 3, 4, 5]
    for step in (1, 4):
        one = progressive_muting(tr, te, names, "classification", [step - 1], 6, with_time=False).collect()
        assert [(r.variables_kept, r.test_accuracy) for r in one] == [together[step]]


def test_wide_rows_are_scored_where_they_are_made(spark, sf):
    """The noise columns and the scores come from one function over batches, with the same numbers as from a wide DataFrame."""
    from dataclasses import replace

    from sylva.operators import prepare
    from sylva.sources import fixtures as fx
    fr = fx.line_reg(spark, sf)
    fr = replace(fr, df=fr.df.limit(300).localCheckpoint().withColumn("label", F.col("revenue") / 1000), target_col="label")
    made = prepare.noise_rows(fr, 20, 0.5, 42, chunk=64, block=10)
    wide = prepare.expand_with_noise(fr, 20, 0.5, 42, as_array="x").df
    assert sorted(made.select("x", "row_id").rows().collect()) == sorted(wide.select("x", "row_id").collect())
    fitted = fit_many(wide.limit(60), PLANS[:4], "regression")
    once = fitted.predictions(made)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert by_model(fitted, made) == by_model(fitted, wide)


def test_model_nmin_scores_both_forests_in_one_pass(spark, sf):
    """One reader of the wide test rows, however many models."""
    from sylva.plans import catalog
    tr, te, names = catalog._part3(spark, sf)
    assert len(names) == 500 and {"row_id", "label", "x"} <= set(te.columns)
    got = {r.model: r for r in catalog.model_nmin(spark, sf).collect()}
    assert sorted(got) == ["ET-nmin=2", "ET-nmin=n^1/3=5"] and all(r.features == 500 and r.max_depth is None for r in got.values())
    model = ExtraTrees("regression", 100, min_leaf=5).fit(tr).transform(te.rows())
    rmse = model.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert got["ET-nmin=n^1/3=5"].rmse == pytest.approx(rmse, rel=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_compared_trees_give_the_leaves_of_a_walk(seed):
    """Trees of different depth together, single leaves, NaN, numbers on a threshold, kept features and pairs."""
    rng = np.random.default_rng(seed)
    n, p = int(rng.integers(1, 80)), int(rng.integers(1, 6))
    x, y = np.round(rng.normal(size=(n, p)), 1), np.round(rng.normal(size=n), 1)
    w = rng.poisson(1, n).astype(float)
    trees = [grow(x, y, "regression", 0, p, 1 + t % 3, None, root_key(1, t), 0)[:3] for t in range(3)]
    trees += [grow_best(x, y, w, "regression", 0, p, 1, depth, root_key(1, 9), 0.0)[:3] for depth in (0, 2, None)]
    seen = np.concatenate([x, rng.normal(size=(20, p)), np.full((1, p), np.nan)])
    if any((f >= 0).any() for f, _, _ in trees):
        found = list(bounded.Compared(trees).leaves(Plan("a", "et").columns(np.ascontiguousarray(seen.T)), len(seen)))
        assert len(found) == len(trees) and all(np.array_equal(leaf, _route(seen, *t)) for leaf, t in zip(found, trees, strict=True))
    plan = Plan("b", "et", keep=(p - 1, 0), pairs=((0, p - 1, 0.3, -0.7),))
    column, view = plan.columns(np.ascontiguousarray(seen.T)), plan.view(seen)
    assert all(np.array_equal(column(f), view[:, f], equal_nan=True) for f in range(3))


def test_trees_are_grouped_in_order_and_large_ones_walked():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(600, 3)), rng.normal(size=600)
    large, little = grow(x, y, "regression", 0, 3, 1, None, root_key(1, 0), 0), grow(x[:100], y[:100], "regression", 0, 3, 1, None, root_key(1, 1), 0)
    trees = [(i, *(little if i != 2 else large)[:4]) for i in range(60)]
    groups = list(bounded._groups(trees))
    assert [t[0] for g, _ in groups for t in g] == list(range(60))
    assert [c is None for _, c in groups].count(True) == 1 and [t[0] for t in groups[1][0]] == [2]
    assert len(groups) > 3 and all(len(c.thr) <= bounded.SPLITS_AT_ONCE for _, c in groups if c is not None)
