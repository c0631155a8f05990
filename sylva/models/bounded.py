"""Many models on one bounded training table: the table is sent once, models and trees are fitted side by side on executors.

A study fits dozens of models on a few rows (H15, H19), nested forests on the same rows (M6), or a hundred trees on a table that one task can
hold.  Fitting them one after another as distributed jobs leaves the cluster idle, so here the *work* is dealt instead of the rows: the unit is a few trees
of one model, or a model whose trees follow one another.  The training table may hold at most ``LOCAL_NUMBERS`` numbers; that is counted before
anything is collected, and larger tables are refused (``fits``), for which the distributed learners are there.

* ``Plan``: what a model sees and how it is grown: positions of the features it keeps, linear combinations it adds, the kind of split.
* Random forests and boosting search every threshold between neighbouring values (no bins) and grow to purity unless told otherwise;
  bootstrap weights are Poisson draws, a hash of the row's key and the tree's number, so a forest is the same on any cluster.
* ``Fitted.score``: one pass over the (possibly large) test rows scores every model; a model's features are made per block of rows.  Small trees
  are not walked: thresholds are compared with whole columns (``Compared``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.frame import Made
from sylva.functions.hashing import MASK32, STRIDE, TWO_32
from sylva.models.extra_trees import (LOCAL, LOCAL_NUMBERS, SPLITS, TIE_RTOL, ExtraTreesModel, _batch, _lists, _matrix, _route, _struct, _terminal,
                                      child_keys, draws, grow, root_key)
from sylva.operators.prepare import _np_mix32
from sylva.session import saved

#: Trees of one unit, and nodes that may go to every task in scoring.
TREES_PER_UNIT = 4
HELD_NODES = 4_000_000
#: Numbers (rows times features) that the search for thresholds takes at once.
BLOCK_NUMBERS = 1 << 19
#: Leaves of a tree that is scored by comparing columns (a byte tells the leaf), splits compared at once, and rows of a block.
SMALL_LEAVES = 256
SPLITS_AT_ONCE = 2048
SCORED_ROWS = 4096
POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(13)])
MODELS = "model int, tree int, node long, feat array<int>, thr array<double>, left array<int>, value array<double>, imp array<double>"


@dataclass
class Plan:
    """How one model is fitted.

    ``kind``: et (random thresholds), rf (best thresholds on bootstrap weights), boost (best thresholds on residuals, one tree after
    another) or lasso.  ``keep``: positions of the features it sees (None: all), ``pairs``: added columns ``w1 * x[i] + w2 * x[j]``."""

    name: str
    kind: str
    n_trees: int = 100
    mtry: int | None = None
    min_leaf: int = 1
    max_depth: int | None = None
    seed: int = 42
    rate: float = 0.1
    l2: float = 0.0
    alpha: float = 0.1
    keep: tuple[int, ...] | None = None
    pairs: tuple[tuple[int, int, float, float], ...] = ()
    features: list[str] = field(default_factory=list)

    def view(self, x: np.ndarray) -> np.ndarray:
        out = x if self.keep is None else x[:, list(self.keep)]
        if not self.pairs:
            return out
        return np.concatenate([out, *((w1 * x[:, i] + w2 * x[:, j])[:, None] for i, j, w1, w2 in self.pairs)], axis=1)

    def columns(self, columns: np.ndarray):
        """The columns of ``view`` one at a time, from all features as rows."""
        kept = range(len(columns)) if self.keep is None else self.keep

        def column(f: int) -> np.ndarray:
            if f < len(kept):
                return columns[kept[f]]
            i, j, w1, w2 = self.pairs[f - len(kept)]
            return w1 * columns[i] + w2 * columns[j]

        return column

    def width(self, p: int) -> int:
        return (p if self.keep is None else len(self.keep)) + len(self.pairs)

    def tries(self, p: int, task: str) -> int:
        """Features tried at a node: the square root for classes, all for numbers, unless given."""
        w = self.width(p)
        return max(1, min(w, int(self.mtry or (math.sqrt(w) if task == "classification" else w))))


def fits(df: DataFrame, features: str = "x") -> bool:
    """Whether the table has few enough numbers to be held by one task."""
    facts = df.agg(F.count("*").alias("n"), F.max(F.size(features)).alias("p")).first()
    return facts.n * ((facts.p or 0) + 2) <= LOCAL_NUMBERS


# ------------------------------------------------------------------ bootstrap weights
def bootstrap(rk: np.ndarray, tree: int) -> np.ndarray:
    """Poisson(1) draws of rows with 32-bit keys, for one tree."""
    x = (rk.astype(np.uint64) + np.uint64(tree) * np.uint64(STRIDE)) & np.uint64(MASK32)
    u = (_np_mix32(x).astype(np.float64) + 0.5) / TWO_32
    return np.searchsorted(POISSON_CDF, u, side="right").astype(np.float64)


# ------------------------------------------------------------------ best thresholds
def _sums(y: np.ndarray, w: np.ndarray, task: str, k: int) -> np.ndarray:
    """Additive statistics of each row: weights by class, or weight, sum and sum of squares."""
    if task == "classification":
        out = np.zeros((len(y), k))
        out[np.arange(len(y)), y.astype(np.int64)] = w
        return out
    return np.stack([w, w * y, w * y * y], axis=1)


def _purity(stats: np.ndarray, task: str, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight and what the best leaf value explains: a split's gain is the children's minus the parent's."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n = stats.sum(axis=-1) if task == "classification" else stats[..., 0]
        top = (stats * stats).sum(axis=-1) if task == "classification" else stats[..., 1] ** 2
        return n, np.where(n > 0, top / (n + l2), 0.0)


def _leaf(stats: np.ndarray, task: str, l2: float) -> np.ndarray:
    if task == "classification":
        return stats / np.maximum(stats.sum(axis=-1, keepdims=True), 1e-300)
    return (stats[:, 1] / np.maximum(stats[:, 0] + l2, 1e-300))[:, None]


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """For each feature the rows by value."""
    return np.argsort(x.T, axis=1, kind="stable").astype(np.int32)


def grow_best(x, y, w, task, k, mtry, min_leaf, max_depth, key, l2: float = 0.0, order=None):
    """A tree with the best threshold of ``mtry`` features a node that are not constant there; arrays as from ``grow``.

    A level at a time, for blocks of features at once; ``order``: ``sorted_rows`` if known; rows of weight 0 take no part.  Gains within
    rounding noise of the best count as tied: the first feature wins, and its lowest threshold."""
    p, columns, sums = x.shape[1], np.ascontiguousarray(x.T), _sums(y, w, task, k)
    order = sorted_rows(x) if order is None else order
    order = order[np.repeat((w > 0)[None, :], p, axis=0)[np.arange(p)[:, None], order]].reshape(p, -1)
    keys, start, depth, first = np.array([key], dtype=np.int64), np.array([0]), 0, 0
    feat, thr, left, value, imp = [], [], [], [], np.zeros(p)
    while len(keys):
        n_nodes, m = len(keys), order.shape[1]
        if not m:  # no feature, or no row drawn
            stats = sums.sum(axis=0, keepdims=True)
            for column, v in zip((feat, thr, left, value), (np.array([-1]), np.zeros(1), np.array([-1]), _leaf(stats, task, l2)), strict=True):
                column.append(v)
            break
        size = np.diff(np.append(start, m))
        a = np.repeat(np.arange(n_nodes), size)
        stats = np.add.reduceat(sums[order[0]], start, axis=0)
        n, whole = _purity(stats, task, l2)
        noise = TIE_RTOL * (n if task == "classification" else np.abs(stats[:, 2]))
        ends = start + size - 1
        usable = (np.take_along_axis(columns, order[:, ends], axis=1) > np.take_along_axis(columns, order[:, start], axis=1)).T
        ranks = np.argsort(draws(keys, p)[0], axis=1, kind="stable")
        chosen = np.take_along_axis(usable, ranks, axis=1)
        tried = np.zeros((n_nodes, p), dtype=bool)
        np.put_along_axis(tried, ranks, chosen & (np.cumsum(chosen, axis=1) <= mtry), axis=1)
        tried[_terminal(stats, task, depth, min_leaf, max_depth)] = False
        gains, cuts = np.full((p, n_nodes), -np.inf), np.zeros((p, n_nodes))
        same = a[1:] == a[:-1]
        block = max(1, BLOCK_NUMBERS // m)
        wanted = np.flatnonzero(tried.any(axis=0))
        for at in range(0, len(wanted), block):
            fs = wanted[at : at + block]
            o = order[fs]
            v = np.take_along_axis(columns[fs], o, axis=1)
            there = sums[o]
            cum = np.cumsum(there, axis=1)
            f, place = np.nonzero((v[:, 1:] > v[:, :-1]) & same & tried[a[:-1]][:, fs].T)
            if not len(place):
                continue
            node = a[place]
            lower = cum[f, place] - (cum[f, start[node]] - there[f, start[node]])
            nl, one = _purity(lower, task, l2)
            nr, two = _purity(stats[node] - lower, task, l2)
            gain = np.where((nl >= min_leaf) & (nr >= min_leaf), one + two - whole[node], -np.inf)
            group = f * n_nodes + node
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            top = np.repeat(np.maximum.reduceat(gain, begin), np.diff(np.append(begin, len(group))))
            spot = np.flatnonzero((gain >= top - noise[node]) & np.isfinite(gain))
            which, lowest = np.unique(group[spot], return_index=True)
            spot = spot[lowest]
            low, high = v[f[spot], place[spot]], v[f[spot], place[spot] + 1]
            middle = low + (high - low) / 2
            gains[fs[which // n_nodes], which % n_nodes] = top[spot]
            cuts[fs[which // n_nodes], which % n_nodes] = np.where(middle < high, middle, low)
        top = gains.max(axis=0) if p else np.full(n_nodes, -np.inf)
        best_f = np.argmax(gains >= top - noise, axis=0)
        split = np.flatnonzero(top > noise)
        best_f[np.setdiff1d(np.arange(n_nodes), split)] = -1
        best_t = np.where(best_f >= 0, cuts[best_f, np.arange(n_nodes)], 0.0)
        np.add.at(imp, best_f[split], top[split])
        lefts = np.full(n_nodes, -1)
        lefts[split] = first + n_nodes + 2 * np.arange(len(split))
        for column, v in zip((feat, thr, left, value), (best_f, best_t, lefts, _leaf(stats, task, l2)), strict=True):
            column.append(v)
        first, depth = first + n_nodes, depth + 1
        if not len(split):
            break
        rank = np.full(n_nodes, -1)
        rank[split] = np.arange(len(split))
        moving = np.flatnonzero(best_f[a] >= 0)
        node, rows = rank[a[moving]], order[0, moving]
        side = np.zeros(len(y), dtype=np.int8)
        side[rows] = columns[best_f[a[moving]], rows] > best_t[a[moving]]
        child_size = np.bincount(2 * node + side[rows], minlength=2 * len(split))
        child_start = np.cumsum(child_size) - child_size
        # every feature's order is cut alike: rows go left or right within their node and keep their order
        node_start, right_start = child_start[0::2][node], child_start[1::2][node]
        old = np.arange(len(moving))
        new = np.empty((p, len(moving)), dtype=order.dtype)
        for at in range(0, p, block):
            o = order[at : at + block][:, moving]
            right = side[o].astype(np.int64)
            passed = np.cumsum(right, axis=1) - right  # rows gone right before, from the level's begin
            passed = passed - passed[:, node_start]
            np.put_along_axis(new[at : at + block], np.where(right > 0, right_start + passed, old - passed), o, axis=1)
        order, start = new, child_start
        keys = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], axis=1).ravel()
    return [np.concatenate(c) for c in (feat, thr, left, value)] + [imp]


def lasso_fit(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 1000, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Coordinate descent on ``|y - Xw - b|^2 / 2n + alpha |w|``; stops by the dual gap, relative to ``y``'s squares."""
    mean, base = x.mean(axis=0), float(y.mean())
    x, r = x - mean, y - base
    n, square, w = len(y), (x * x).sum(axis=0), np.zeros(x.shape[1])
    goal = tol * float(r @ r)
    for _ in range(rounds):
        largest = 0.0
        for j in np.flatnonzero(square > 0).tolist():
            old = w[j]
            part = float(x[:, j] @ r) + square[j] * old
            w[j] = math.copysign(max(abs(part) - n * alpha, 0.0), part) / square[j]
            if w[j] != old:
                r -= (w[j] - old) * x[:, j]
                largest = max(largest, abs(w[j] - old))
        if largest <= tol * max(np.abs(w).max(), 1e-300):
            dual = float(np.abs(x.T @ r).max())
            share = n * alpha / dual if dual > n * alpha else 1.0
            gap = 0.5 * float(r @ r) * (1 + share * share) + n * alpha * float(np.abs(w).sum()) - share * float(r @ (r + x @ w))
            if gap <= goal:
                break
    return w, base - float(mean @ w)


# ------------------------------------------------------------------ scoring
def _levels(feat: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, int, int]] | None:
    """Of each level its splits, first node and end; None where nodes are not numbered a level at a time, children side by side."""
    out, first, end = [], 0, 1
    while first < end:
        splits = first + np.flatnonzero(feat[first:end] >= 0)
        out.append((splits, first, end))
        if not np.array_equal(left[splits], end + 2 * np.arange(len(splits))):
            return None
        first, end = end, end + 2 * len(splits)
    return out if first == len(feat) else None


def small(feat: np.ndarray, left: np.ndarray) -> bool:
    """Whether ``Compared`` takes the tree."""
    return int((feat < 0).sum()) <= SMALL_LEAVES and _levels(feat, left) is not None


class Compared:
    """The leaves of many rows in some small trees ``(feat, thr, left)``, the same as by ``_route``.

    Every threshold is compared with its feature's whole column; then, from the deepest level up, a node takes the leaf of its right or left
    child.  Both run over neighbouring numbers, where a walk looks up single ones."""

    def __init__(self, trees: list[tuple]):
        levels = [_levels(f, left) for f, _, left in trees]
        feat, thr, self.levels = [], [], []
        at = 0
        for depth in range(max(len(x) for x in levels)):  # a level of all trees together
            split = np.concatenate([f[x[depth][1] : x[depth][2]] >= 0 for (f, _, _), x in zip(trees, levels, strict=True) if depth < len(x)])
            leaf = np.concatenate([(np.cumsum(f < 0) - 1)[x[depth][1] : x[depth][2]] for (f, _, _), x in zip(trees, levels, strict=True) if depth < len(x)])
            mine = [(f[x[depth][0]], t[x[depth][0]]) for (f, t, _), x in zip(trees, levels, strict=True) if depth < len(x)]
            feat += [f for f, _ in mine]
            thr += [t for _, t in mine]
            splits, leaves = np.flatnonzero(split), np.flatnonzero(~split)
            self.levels.append((len(split), splits, at + np.arange(len(splits)), leaves, leaf[leaves].astype(np.uint8)[:, None]))
            at += len(splits)
        feat, thr = np.concatenate(feat), np.concatenate(thr)
        by_feature = np.argsort(feat, kind="stable")
        place = np.argsort(by_feature)
        self.levels = [(size, splits, place[nth], leaves, numbers) for size, splits, nth, leaves, numbers in reversed(self.levels)]
        self.thr = thr[by_feature][:, None]
        features, start = np.unique(feat[by_feature], return_index=True)
        self.spans = list(zip(features.tolist(), start.tolist(), [*start[1:].tolist(), len(feat)], strict=True))
        self.nodes = [np.flatnonzero(f < 0) for f, _, _ in trees]

    def leaves(self, column, n: int) -> Iterator[np.ndarray]:
        """Of each tree the leaf of every row; ``column(f)``: a feature's numbers of the ``n`` rows."""
        right = np.empty((len(self.thr), n), dtype=bool)
        for f, a, b in self.spans:
            np.greater(column(f)[None, :], self.thr[a:b], out=right[a:b])
        mask = right.view(np.uint8)
        np.negative(mask, out=mask)  # all bits of a byte
        below = None
        for size, splits, places, leaves, numbers in self.levels:
            here = np.empty((size, n), dtype=np.uint8)
            here[leaves] = numbers
            if len(splits):  # children of a level's splits lie side by side, in their order
                pick = below[0::2] ^ below[1::2]
                pick &= mask[places]
                pick ^= below[0::2]
                here[splits] = pick
            below = here
        for nodes, leaf in zip(self.nodes, below, strict=True):
            yield nodes[leaf]


def _groups(trees: list[tuple]) -> Iterator[tuple[list[tuple], Compared | None]]:
    """Neighbouring trees (tree, feat, thr, left, value) that are scored together, in their order; None: trees that are walked."""
    at = 0
    while at < len(trees):
        end, splits, compared = at, 0, small(trees[at][1], trees[at][3])
        while end < len(trees) and (end == at or splits + int((trees[end][1] >= 0).sum()) <= SPLITS_AT_ONCE) and small(trees[end][1], trees[end][3]) == compared:
            splits += int((trees[end][1] >= 0).sum())
            end += 1
        yield trees[at:end], Compared([t[1:4] for t in trees[at:end]]) if compared and splits else None
        at = end


# ------------------------------------------------------------------ fitting
def _fit_unit(plan: Plan, number: int, trees: list[int], x, y, rk, task, k) -> Iterator[tuple]:
    """Rows of MODELS.  The value of a tree's node is class shares or a mean; lasso's only row holds the weights and the intercept."""
    view = plan.view(x)
    tries = plan.tries(x.shape[1], task)
    if plan.kind == "lasso":
        w, b = lasso_fit(view, y, plan.alpha)
        yield number, 0, 0, np.array([-1]), np.array([b]), np.array([-1]), w, np.abs(w)
    elif plan.kind == "et":
        shift, scale = (0.0, 1.0) if task == "classification" else (float(y.mean()), float(y.std()) or 1.0)
        for t in trees:
            key = root_key(plan.seed, t)
            feat, thr, left, value, imp = grow(view, (y - shift) / scale, task, k, tries, plan.min_leaf, plan.max_depth, key, 0)
            yield number, t, key, feat, thr, left, (value if task == "classification" else value * scale + shift).ravel(), imp
    else:
        order = sorted_rows(view)
        if plan.kind == "rf":
            for t in trees:
                key = root_key(plan.seed, t)
                feat, thr, left, value, imp = grow_best(view, y, bootstrap(rk, t), task, k, tries, plan.min_leaf, plan.max_depth, key, 0.0, order)
                yield number, t, key, feat, thr, left, value.ravel(), imp
        else:
            rest, one = y - y.mean(), np.ones(len(y))
            for t in range(plan.n_trees):
                key = root_key(plan.seed, t)
                feat, thr, left, value, imp = grow_best(view, rest, one, "regression", 0, view.shape[1], plan.min_leaf, plan.max_depth, key, plan.l2, order)
                value = plan.rate * value
                rest = rest - value[_route(view, feat, thr, left), 0]
                yield number, t, key, feat, thr, left, value.ravel(), imp


def fit_many(train: DataFrame, plans: list[Plan], task: str, n_classes: int = 0, key: str = "row_id", seed: int = 42) -> Fitted:
    """Fits all plans on a table that ``fits``: ``x``, ``label`` and a row key for the bootstrap."""
    from sylva.functions.hashing import hash_u32
    spark = train.sparkSession
    if not fits(train):
        raise ValueError(f"a bounded fit takes at most {LOCAL_NUMBERS} numbers")
    table = train.select("x", F.col("label").cast("double").alias("y"), (hash_u32(F.col(key), F.lit(seed)) if key in train.columns else F.lit(0).cast("long")).alias("rk")).toArrow()
    x, y, rk = _matrix(table.column("x")), table.column("y").to_numpy(), table.column("rk").to_numpy()
    order = np.lexsort(np.column_stack([x, y, rk]).T[::-1]) if len(y) else np.arange(0)  # one order of rows for any layout
    held = spark.sparkContext.broadcast((x[order], y[order], rk[order]))
    units = [(i, t) for i, plan in enumerate(plans) for t in (range(0, plan.n_trees, TREES_PER_UNIT) if plan.kind in ("et", "rf") else [0])]
    # models whose trees follow one another take longest and come first
    units.sort(key=lambda u: plans[u[0]].kind != "boost")
    dealt = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(units)], "unit int, model int, tree int").repartitionByRange(max(1, len(units)), "unit")
    schema = _struct(MODELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("model").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                trees = list(range(t, min(t + TREES_PER_UNIT, plans[i].n_trees)))
                for number, tree, node, feat, thr, left, value, imp in _fit_unit(plans[i], i, trees, *held.value, task, n_classes):
                    yield _batch(schema, [number], [tree], [node], *[_lists(np.asarray(v)[None], kind) for v, kind in
                                 ((feat.astype(np.int32), pa.int32()), (thr, None), (left.astype(np.int32), pa.int32()), (value, None), (imp, None))])

    with_nodes = saved(dealt.mapInArrow(run, schema), "models")
    held.destroy()
    return Fitted(plans, task, n_classes, x.shape[1], with_nodes, float(y.mean()) if len(y) else 0.0)


class Fitted:
    """Models of ``fit_many``: ``table`` has a row per tree."""

    def __init__(self, plans, task, n_classes, p, table, base):
        self.plans, self.task, self.n_classes, self.p, self.table, self.base = plans, task, n_classes, p, table, base

    def n_features(self, i: int) -> int:
        return self.plans[i].width(self.p)

    def score(self, df: DataFrame | Made, features: str = "x", keep: bool = True) -> DataFrame:
        """The rows of ``df`` with ``scores``: for every plan its predicted number, or its class shares; in one pass.

        ``keep``: with their features, which else do not leave the task."""
        nodes = self.table.agg(F.sum(F.size("feat"))).first()[0] or 0
        if nodes > HELD_NODES:
            raise ValueError("too many nodes to hold in every task; fit fewer models at once")
        plans, task, base, at = self.plans, self.task, self.base, df.columns.index(features)
        held = df.sparkSession.sparkContext.broadcast(self.table.drop("imp", "node").toArrow())
        width = self.n_classes if task == "classification" else 1
        told = [i for i, c in enumerate(df.columns) if keep or i != at]
        schema = T.StructType([*(df.schema.fields[i] for i in told), T.StructField("scores", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models: dict[int, list] = {}
            for r in held.value.to_batches(256):
                for i in range(r.num_rows):
                    feat, thr, left, value = (r.column(c)[i].values.to_numpy() for c in ("feat", "thr", "left", "value"))
                    models.setdefault(r.column("model")[i].as_py(), []).append((r.column("tree")[i].as_py(), feat, thr, left, value))
            for trees in models.values():
                trees.sort(key=lambda t: t[0])
            groups = {m: list(_groups(models[m])) for m, plan in enumerate(plans) if plan.kind != "lasso"}

            def scores(x: np.ndarray) -> np.ndarray:
                out, columns = np.zeros((len(x), len(plans) * width)), np.ascontiguousarray(x.T)
                for m, plan in enumerate(plans):
                    mine = slice(m * width, (m + 1) * width)
                    if plan.kind == "lasso":
                        _, _, intercept, _, w = models[m][0]
                        out[:, mine] = (plan.view(x) @ w + intercept[0])[:, None]
                        continue
                    total, seen = np.zeros((len(x), width)), plan.columns(columns)
                    for trees, compared in groups[m]:
                        if compared is None:
                            view = plan.view(x)
                            found = (_route(view, *t[1:4]) for t in trees)
                        else:
                            found = compared.leaves(seen, len(x))
                        for (*_, value), leaf in zip(trees, found, strict=True):
                            total += value.reshape(-1, width)[leaf]
                    out[:, mine] = total + base if plan.kind == "boost" else total / len(models[m])
                return out

            for batch in batches:
                for first in range(0, batch.num_rows, SCORED_ROWS):
                    part = batch.slice(first, SCORED_ROWS)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in told), _lists(scores(_matrix(part.column(at))))], names=schema.names)

        return df.mapInArrow(run, schema)

    def model(self, i: int) -> ExtraTreesModel:
        """One forest as a model of its own, whose scoring is bounded however many nodes it has."""
        plan, mine = self.plans[i], self.table.where(F.col("model") == i).drop("model")
        if plan.kind not in ("et", "rf"):
            raise ValueError("only a forest's trees are averaged")
        imp = np.zeros(plan.width(self.p))
        shares = (mine.select("tree", F.posexplode("imp").alias("f", "g")).withColumn("t", F.sum("g").over(Window.partitionBy("tree")))
                  .where("t > 0").groupBy("f").agg(F.sum(F.col("g") / F.col("t")).alias("v")).collect())  # a row per feature
        for r in shares:
            imp[r.f] = r.v
        k = self.n_classes if self.task == "classification" else 0
        size = mine.agg(F.sum(F.size("feat"))).first()[0] or 0
        return ExtraTreesModel(self.task, plan.width(self.p), k, plan.n_trees, plan.seed, self.table.sparkSession.createDataFrame([], SPLITS), mine, LOCAL,
                               [0.0] * (k or 1), size, imp / imp.sum() if imp.sum() > 0 else imp)

    def column(self, i: int) -> Column:
        """The features of plan i from the full ``x``."""
        x, plan = F.col("x"), self.plans[i]
        kept = range(self.p) if plan.keep is None else plan.keep
        return F.array(*[x[j] for j in kept], *[F.lit(w1) * x[a] + F.lit(w2) * x[b] for a, b, w1, w2 in plan.pairs])

    def predictions(self, df: DataFrame | Made) -> DataFrame:
        """Long form: row_id, label, model (its name), prediction and, for classes, probability.  All plans in one pass where their nodes may go
        to every task together; larger forests one at a time."""
        given = df.select("row_id", "x", "label")
        if (self.table.agg(F.sum(F.size("feat"))).first()[0] or 0) > HELD_NODES:
            given, out = given.rows() if isinstance(given, Made) else given, None
            for i, plan in enumerate(self.plans):
                one = self.model(i).transform(given.withColumn("x", self.column(i))).drop("x").withColumn("model", F.lit(plan.name))
                out = one if out is None else out.unionByName(one)
            return out
        scored = self.score(given, keep=False)
        names = F.array(*[F.lit(p.name) for p in self.plans])
        width = self.n_classes if self.task == "classification" else 1
        each = scored.select("row_id", "label", "scores", F.explode(F.sequence(F.lit(0), F.lit(len(self.plans) - 1))).alias("m"))
        if self.task != "classification":
            return each.select("row_id", "label", F.get(names, F.col("m")).alias("model"), F.get("scores", F.col("m")).alias("prediction"))
        each = each.select("row_id", "label", F.get(names, F.col("m")).alias("model"), F.slice("scores", F.col("m") * width + 1, F.lit(width)).alias("probability"))
        return each.select("row_id", "label", "model", (F.array_position("probability", F.array_max("probability")) - 1).cast("double").alias("prediction"), "probability")
