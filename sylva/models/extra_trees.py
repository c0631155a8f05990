"""Extra-Trees (extremely randomized trees) grown on Spark.

MLlib has no Extra-Trees.  Per node, features are visited in a random order, constant ones skipped, until ``mtry``
usable features are found; each gets a threshold uniform in [min, max] of the node; the candidate with the largest
impurity decrease (Gini / variance) that leaves at least ``min_leaf`` rows on both sides wins.  All draws are hashes of the node's
path from the root, so a forest depends on the data, the seed and its settings only: not on partitions, and not on where
a node is grown.

* **Distributed levels**, for nodes with more than ``local_rows`` rows.  Rows carry their current node of each tree.  A pass
  gathers label sums and the features' ranges per (tree, node), a group step draws the candidates, a second pass gathers the
  candidates' left sides, and a second group step picks the split.  Both group steps run on executors over one row per
  (feature | candidate, statistic); the chosen splits are a table.
* **Local finish**: the rows of a smaller node meet in one group, and the subtree below is grown there in NumPy, a whole
  level at a time.  A table that is small as a whole goes to the tasks once, and trees are dealt instead of rows.  ``local_rows`` follows from a bound on a group's numbers.
  A larger table goes there too if it takes at most ``HELD_BYTES`` with columns of few values as bytes.
* Trees are grown in batches, so that the open nodes of a level, which go to every task, stay below ``OPEN_NUMBERS``.  Where one tree's level is
  larger, rows meet candidates and splits by joins on the node, and the driver sees their number only.
* The forest is two tables in the shared folder: splits of the distributed levels, and one row per subtree.  The driver
  gets its size and the importances, no nodes.
* Scoring sends the forest to the tasks, at most ``BROADCAST_NODES`` nodes at once: groups of trees one after another add to the rows' votes.  Where one tree
  has more, rows and subtrees (and, beyond as many, the upper levels' splits, a join a level) meet by (tree, node).
  Rows keep all their columns and are never joined by an id of theirs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.session import saved

LOCAL_NUMBERS = 4_000_000
OPEN_NUMBERS = 4_000_000
TREES_AT_ONCE = 32
TREES_TOGETHER = 3  # in a task, where the table is held
HELD_BYTES = 64_000_000  # of a table whose columns of few values are bytes
CODED_VALUES = 256
NARROW = 16  # features of a table whose columns are all compared at every level
TOGETHER = 1 << 17  # rows of the nodes that are split together
BROADCAST_NODES = 2_000_000
TIE_RTOL = 1e-9
OPEN, LEAF, LOCAL = 0, 1, 2  # a row's state in a tree; LOCAL + depth of the node

SPLITS = ("tree int, node long, depth int, feature int, threshold double, gain double, n_left double, n_right double, "
          "left_state int, right_state int, left_value array<double>, right_value array<double>")
SUBTREES = "tree int, node long, feat array<int>, thr array<double>, left array<int>, value array<double>, imp array<double>"


# ------------------------------------------------------------------ draws
def _mix(x):
    """A 64-bit finaliser (public constants)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def root_key(seed: int, tree: int) -> int:
    return int(_mix(_mix(np.uint64(seed)) + np.uint64(tree + 1)).astype(np.int64))


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    """Keys of the left (0) or right (1) children."""
    return _mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(side + 1)).astype(np.int64)


def draws(keys: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node and feature: a key of the random order, and a uniform number."""
    k, f = keys.astype(np.uint64)[:, None], np.arange(p, dtype=np.uint64)[None, :]
    order = _mix(_mix(k + f * np.uint64(2)) ^ k)
    u = _mix(_mix(k + f * np.uint64(2) + np.uint64(1)) ^ k)
    return order, ((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


# ------------------------------------------------------------------ rules shared by both phases
def _impurity(stats: np.ndarray, task: str):
    """(..., K) class counts or (..., 3) [n, sum, sum of squares] -> rows, impurity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if task == "classification":
            n = stats.sum(axis=-1)
            frac = stats / n[..., None]
            imp = 1.0 - np.nansum(frac * frac, axis=-1)
        else:
            n = stats[..., 0]
            imp = np.maximum(stats[..., 2] / n - (stats[..., 1] / n) ** 2, 0.0)
    return n, np.where(n > 0, imp, 0.0)


def _value(stats: np.ndarray, task: str) -> np.ndarray:
    """Class shares or mean, (..., width)."""
    n = stats.sum(axis=-1) if task == "classification" else stats[..., 0]
    top = stats if task == "classification" else stats[..., 1:2]
    return top / np.maximum(n, 1)[..., None]


def _terminal(stats, task, depth, min_leaf, max_depth):
    n, imp = _impurity(stats, task)
    out = (n < 2) | (n < 2 * min_leaf) | (imp <= 1e-12)
    return out if max_depth is None else out | (np.asarray(depth) >= max_depth)


def _candidates(low, high, order, u, mtry):
    """(A, m) candidate features (-1: none) and thresholds."""
    a, p = low.shape
    perm = np.argsort(order, axis=1, kind="stable")
    usable = np.take_along_axis(high > low, perm, axis=1)
    rank = np.cumsum(usable, axis=1)
    rows, cols = np.nonzero(usable & (rank <= mtry))
    cand = np.full((a, min(mtry, p)), -1, dtype=np.int64)
    cand[rows, rank[rows, cols] - 1] = perm[rows, cols]
    safe = np.maximum(cand, 0)
    lo, hi = np.take_along_axis(low, safe, axis=1), np.take_along_axis(high, safe, axis=1)
    return cand, lo + np.take_along_axis(u, safe, axis=1) * (hi - lo)


def _node_stats(y, a, task, k, n_nodes):
    if task == "classification":
        return np.bincount(a * k + y.astype(np.int64), minlength=n_nodes * k).reshape(n_nodes, k).astype(np.float64)
    return np.stack([np.bincount(a, weights=w, minlength=n_nodes) for w in (None, y, y * y)], axis=1).astype(np.float64)


def _left_stats(x, y, a, cand, thr, task, k, n_nodes):
    """Left-side label statistics per (node, candidate): (A, m, K) or (A, m, 3)."""
    m = cand.shape[1]
    feature = cand[a]
    go = ((np.take_along_axis(x, np.maximum(feature, 0), axis=1) <= thr[a]) & (feature >= 0)).astype(np.float64)
    slot = a[:, None] * m + np.arange(m)[None, :]
    if task == "classification":
        index = (slot * k + y.astype(np.int64)[:, None]).ravel()
        return np.bincount(index, weights=go.ravel(), minlength=n_nodes * m * k).reshape(n_nodes, m, k)
    parts = [np.bincount(slot.ravel(), weights=(go * w[:, None]).ravel(), minlength=n_nodes * m) for w in (np.ones_like(y), y, y * y)]
    return np.stack(parts, axis=1).reshape(n_nodes, m, 3)


def _best(total, left, cand, task, min_leaf):
    """Best valid candidate per node (-1: none) and its decrease.

    Candidates within rounding noise of the best (relative to the node's impurity) count as tied and the first wins, so sums merged
    in any order pick the same split.
    """
    n, imp = _impurity(total, task)
    nl, il = _impurity(left, task)
    nr, ir = _impurity(total[:, None, :] - left, task)
    gain = n[:, None] * imp[:, None] - nl * il - nr * ir
    gain = np.where((cand >= 0) & (nl >= min_leaf) & (nr >= min_leaf), gain, -np.inf)
    if not gain.shape[1]:
        return np.full(len(gain), -1), np.zeros(len(gain))
    top = gain.max(axis=1, keepdims=True)
    noise = TIE_RTOL * (np.abs(np.where(np.isfinite(top), top, 0.0)) + (n * imp)[:, None])
    b = np.argmax(gain >= top - noise, axis=1)
    best = gain[np.arange(len(gain)), b]
    return np.where(np.isfinite(best), b, -1), np.where(np.isfinite(best), best, 0.0)


# ------------------------------------------------------------------ local growth
def grow(x, y, task, k, mtry, min_leaf, max_depth, key, depth, in_order: bool = False, nodes: bool = True):
    """The subtree of one node: feat (-1: leaf), thr, left (right is left + 1), value, importances."""
    n, p = x.shape
    if n and not in_order:
        if task != "classification":  # sums run in one order for any row order: equal labels are equal summands; counts are exact
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
    if n and 0 < p <= max(NARROW, 2 * mtry):
        cols, tables = zip(*(code(x[:, j]) for j in range(p)), strict=True)
        return grow_columns(list(cols), list(tables), y.astype(np.int32) if task == "classification" else y, task, k, mtry, min_leaf, max_depth, key, depth, nodes)
    keys, rows, start = np.array([key], dtype=np.int64), np.arange(n), np.array([0])
    feat, thr, left, value, imp, first = [], [], [], [], np.zeros(p), 0
    while len(keys):
        n_nodes = len(keys)
        a = np.repeat(np.arange(n_nodes), np.diff(np.append(start, len(rows))))
        xa, ya = x[rows], y[rows]
        stats = _node_stats(ya, a, task, k, n_nodes)
        b, gain = np.full(n_nodes, -1), np.zeros(n_nodes)
        going = np.flatnonzero(~_terminal(stats, task, depth, min_leaf, max_depth))
        cand, cut = np.zeros((n_nodes, 1), dtype=np.int64), np.zeros((n_nodes, 1))
        if len(going):  # leaves need no candidates
            if len(going) < n_nodes:
                rank = np.full(n_nodes, -1)
                rank[going] = np.arange(len(going))
                mine = rank[a] >= 0
                rows, xa, ya, a = rows[mine], xa[mine], ya[mine], rank[a[mine]]
                start = np.searchsorted(a, np.arange(len(going)))
            some, some_cut = _candidates(np.minimum.reduceat(xa, start, axis=0), np.maximum.reduceat(xa, start, axis=0), *draws(keys[going], p), mtry)
            best, best_gain = _best(stats[going], _left_stats(xa, ya, a, some, some_cut, task, k, len(going)), some, task, min_leaf)
            a = going[a]
            b[going], gain[going] = np.where(best >= 0, 0, -1), best_gain
            at = np.maximum(best, 0)
            cand[going, 0], cut[going, 0] = some[np.arange(len(going)), at], some_cut[np.arange(len(going)), at]
        split = np.flatnonzero(b >= 0)
        f, t = np.full(n_nodes, -1), np.zeros(n_nodes)
        f[split], t[split] = cand[split, b[split]], cut[split, b[split]]
        np.add.at(imp, f[split], gain[split])
        lefts = np.full(n_nodes, -1)
        lefts[split] = first + n_nodes + 2 * np.arange(len(split))
        for column, v in zip((feat, thr, left, value), (f, t, lefts, _value(stats, task)), strict=True):
            column.append(v)
        first, depth = first + n_nodes, depth + 1
        moving = f[a] >= 0
        rows, a = rows[moving], a[moving]
        rank = np.full(n_nodes, -1)
        rank[split] = np.arange(len(split))
        child = 2 * rank[a] + (x[rows, f[a]] > t[a])
        by_child = np.argsort(child, kind="stable")
        rows = rows[by_child]
        start = np.searchsorted(child[by_child], np.arange(2 * len(split)))
        keys = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], axis=1).ravel()
    return [np.concatenate(c) for c in (feat, thr, left, value)] + [imp]


def code(column: np.ndarray, most: int = CODED_VALUES) -> tuple[np.ndarray, np.ndarray | None]:
    """A column of at most ``most`` different values as their numbers in order (bytes) with the values; others (and such with NaN) as they are."""
    values = np.unique(column[: 4 * most])
    if len(values) <= most:
        values = np.unique(column)
    if len(values) > most or np.isnan(values).any():
        return np.ascontiguousarray(column), None
    return np.searchsorted(values, column).astype(np.uint8), values


def _level(cols, tables, y, size, keys, depth, task, k, mtry, min_leaf, max_depth):
    """One level of some nodes whose rows lie together: label statistics, feature (-1: leaf), threshold and gain of each node, and, for the rows of nodes that
    are split, which lie left."""
    p, n_nodes = len(cols), len(size)
    start = np.cumsum(size) - size
    if task == "classification":
        slot = y.astype(np.int64) if n_nodes == 1 else np.repeat(np.arange(n_nodes) * k, size) + y
        stats = np.bincount(slot, minlength=n_nodes * k).reshape(n_nodes, k).astype(np.float64)
    else:
        slot = np.repeat(np.arange(n_nodes), size)  # a node's numbers are added up in the order of its rows, as in ``grow``
        stats = _node_stats(y, slot, task, k, n_nodes)
    feat, thr, gain = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
    going = np.flatnonzero(~_terminal(stats, task, depth, min_leaf, max_depth))
    if not len(going):
        return stats, feat, thr, gain, None, None
    kept = None
    if len(going) < n_nodes:  # rows of leaves take no further part
        stay = np.zeros(n_nodes, dtype=bool)
        stay[going] = True
        kept = np.flatnonzero(np.repeat(stay, size))
        cols, y, size = [c[kept] for c in cols], y[kept], size[going]
        start = np.cumsum(size) - size
        slot = np.repeat(np.arange(len(going)), size)
        if task == "classification":
            slot = slot * k + y
    low, high = np.empty((len(going), p)), np.empty((len(going), p))
    for f, (c, values) in enumerate(zip(cols, tables, strict=True)):
        for side, out in ((np.minimum, low), (np.maximum, high)):
            got = side.reduceat(c, start)
            out[:, f] = got if values is None else values[got]
    cand, cut = _candidates(low, high, *draws(keys[going], p), mtry)
    m = cand.shape[1]
    left = np.zeros((len(going), m, stats.shape[1]))
    sides = []
    for f, (c, values) in enumerate(zip(cols, tables, strict=True)):
        node, nth = np.nonzero(cand == f)
        bound = np.full(len(going), -np.inf)
        bound[node] = cut[node, nth]
        if values is not None:  # a value is at most the threshold where its number is below that of the first larger value
            bound = np.searchsorted(values, bound, side="right").astype(np.int16)
            go = c < (bound[0] if len(going) == 1 else np.repeat(bound, size))
        else:
            go = c <= (bound[0] if len(going) == 1 else np.repeat(bound, size))
        sides.append(go)
        if not len(node):
            continue
        if task == "classification":
            told = np.bincount(slot[go], minlength=len(going) * k).reshape(-1, k)
        else:
            part = go.astype(np.float64)
            told = [np.bincount(slot, weights=part, minlength=len(going))]
            for _ in range(2):
                part *= y
                told.append(np.bincount(slot, weights=part, minlength=len(going)))
            told = np.stack(told, axis=1)
        left[node, nth] = told[node]
    best, best_gain = _best(stats[going], left, cand, task, min_leaf)
    split = np.flatnonzero(best >= 0)
    chosen = np.full(len(going), -1)
    chosen[split] = cand[split, best[split]]
    feat[going], gain[going] = chosen, best_gain
    thr[going[split]] = cut[split, best[split]]
    lies = np.zeros(len(y), dtype=bool)
    for f, go in enumerate(sides):
        mine = chosen == f
        if mine.any():
            lies |= go if len(going) == 1 else go & np.repeat(mine, size)
    if len(split) < len(going):
        stays = np.flatnonzero(np.repeat(chosen >= 0, size))
        kept, lies = stays if kept is None else kept[stays], lies[stays]
    return stats, feat, thr, gain, kept, lies


def _parted(cols, y, kept, lies, size):
    """Rows of split nodes (``size``: their rows) by child, left before right, in their order; the children's sizes."""
    went = np.flatnonzero(lies)
    if len(size) == 1:
        order, sizes = np.concatenate([went, np.flatnonzero(~lies)]), np.array([len(went), len(lies) - len(went)])
    else:
        before = np.cumsum(size) - size
        n_left = np.searchsorted(went, before + size) - np.searchsorted(went, before)
        sizes = np.stack([n_left, size - n_left], axis=1).ravel()
        start = np.cumsum(sizes) - sizes
        order = np.empty(len(lies), dtype=np.int64)
        for rows, n, to in ((went, n_left, start[0::2]), (np.flatnonzero(~lies), size - n_left, start[1::2])):
            order[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(len(rows))] = rows
    if kept is not None:
        order = kept[order]
    return [c[order] for c in cols], y[order], sizes


def grow_columns(cols, tables, y, task, k, mtry, min_leaf, max_depth, key, depth, nodes: bool = True):
    """``grow`` over columns, which ``code`` may have made bytes (``tables``: their values).

    Rows of a node lie together in every column, so that a level reads neighbouring numbers.  Nodes of more than ``TOGETHER`` rows are split by themselves,
    and the small ones in groups of about as many, one group after another: what a level holds does not grow with the table.  Without ``nodes`` only the importances are kept."""
    p, n = len(cols), len(y)
    imp, n_made, told = np.zeros(p), 1, []
    if not n:
        stats = np.zeros((1, k if task == "classification" else 3))
        return [np.array([-1]), np.zeros(1), np.array([-1]), _value(stats, task), imp]
    stack = [(cols, y, np.array([n]), np.array([key], dtype=np.int64), np.array([0]), depth)]
    del cols, y
    while stack:
        cols, y, size, keys, at, depth = stack.pop()
        if len(size) > 1 and len(y) > TOGETHER:
            group = (np.cumsum(size) - size) // TOGETHER
            first = np.flatnonzero(np.diff(group, prepend=-1))
            if len(first) == 1:
                first = np.arange(len(size))
            ends, row = [*first[1:].tolist(), len(size)], np.append(np.cumsum(size) - size, len(y))
            for a, b in zip(first.tolist(), ends, strict=True):
                stack.append(([c[row[a] : row[b]] for c in cols], y[row[a] : row[b]], size[a:b], keys[a:b], at[a:b], depth))
            continue
        stats, feat, thr, gain, kept, lies = _level(cols, tables, y, size, keys, depth, task, k, mtry, min_leaf, max_depth)
        split = np.flatnonzero(feat >= 0)
        np.add.at(imp, feat[split], gain[split])
        if nodes:
            left = np.full(len(size), -1)
            left[split] = n_made + 2 * np.arange(len(split))
            told.append((at, feat.astype(np.int32), thr, left.astype(np.int32), _value(stats, task)))
        if len(split):
            cols, y, sizes = _parted(cols, y, kept, lies, size[split])
            below = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], axis=1).ravel()
            stack.append((cols, y, sizes, below, n_made + np.arange(2 * len(split)), depth + 1))
            n_made += 2 * len(split)
    if not nodes:
        return [np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros((0, 1)), imp]
    place = np.argsort(np.concatenate([t[0] for t in told]))
    return [np.concatenate([t[i] for t in told])[place] for i in range(1, 5)] + [imp]


def _route(x, feat, thr, left) -> np.ndarray:
    """The leaf of each row in one subtree."""
    n, p = x.shape
    at, flat = np.zeros(n, dtype=np.int64), np.ascontiguousarray(x).ravel()
    rows, now = np.arange(n), np.zeros(n, dtype=np.int64)
    while len(rows):
        f = feat[now]
        ends = f < 0
        if ends.any():
            at[rows[ends]] = now[ends]
            going = ~ends
            rows, now, f = rows[going], now[going], f[going]
        now = left[now] + (flat[rows * p + f] > thr[now])
    return at


# ------------------------------------------------------------------ Arrow helpers
def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(matrix: np.ndarray, kind=None) -> pa.Array:
    n, w = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def _batch(schema: T.StructType, *columns) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _subtree(tree: int, key: int, feat, thr, left, value, imp) -> pa.RecordBatch:
    """A row of SUBTREES."""
    columns = ((feat.astype(np.int32), pa.int32()), (thr, None), (left.astype(np.int32), pa.int32()), (value.ravel(), None), (imp, None))
    return _batch(_struct(SUBTREES), [tree], [key], *[_lists(v[None], kind) for v, kind in columns])


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    schema = _struct(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
    return pa.Table.from_batches([_batch(schema, *(list(c) for c in columns))])


def _struct(ddl: str) -> T.StructType:
    """The type of a column list; works in tasks, where no session is."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    kinds |= {f"array<{k}>": T.ArrayType(v) for k, v in kinds.items()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class _Splits:
    """Splits of the distributed levels, by tree, for vectorised routing."""

    def __init__(self, table: pa.Table):
        self.by_tree = {}
        tree = table.column("tree").to_numpy()
        for t in np.unique(tree):
            part = table.filter(pa.array(tree == t)).sort_by("node")
            numbers = [part.column(c).to_numpy() for c in ("node", "feature", "threshold", "left_state", "right_state")]
            self.by_tree[int(t)] = (*numbers, _matrix(part.column("left_value")), _matrix(part.column("right_value")))

    def advance(self, tree: int, x, node, state, value=None) -> np.ndarray:
        """Moves open rows one level down (in place); which rows moved.  Open rows without a split become leaves."""
        open_ = np.flatnonzero(state == OPEN)
        if not len(open_):
            return open_
        if tree not in self.by_tree:
            state[open_] = LEAF
            return open_[:0]
        keys, feature, threshold, left_state, right_state, left_value, right_value = self.by_tree[tree]
        at = np.minimum(np.searchsorted(keys, node[open_]), len(keys) - 1)
        has = keys[at] == node[open_]
        state[open_[~has]] = LEAF
        open_, at = open_[has], at[has]
        right = x[open_, feature[at]] > threshold[at]
        old = node[open_]
        node[open_] = np.where(right, child_keys(old, 1), child_keys(old, 0))
        state[open_] = np.where(right, right_state[at], left_state[at])
        if value is not None:
            value[open_] = np.where(right[:, None], right_value[at], left_value[at])
        return open_


class ExtraTreesModel:
    def __init__(self, task, n_features, n_classes, n_trees, seed, splits, subtrees, root_state, root_value, n_nodes, importances, shift=0.0, scale=1.0):
        self.task, self.n_features, self.n_classes, self.n_trees, self.seed = task, n_features, n_classes, n_trees, seed
        self.splits, self.subtrees, self.root_state, self.root_value = splits, subtrees, root_state, root_value
        self.n_nodes, self.importances, self.shift, self.scale = n_nodes, importances, shift, scale

    def save(self, path: str) -> None:
        """The forest as two Parquet tables and one line of facts below ``path``, which driver and executors share."""
        self.splits.write.parquet(f"{path}/splits")
        self.subtrees.write.parquet(f"{path}/subtrees")
        facts = {"task": self.task, "n_features": self.n_features, "n_classes": self.n_classes, "n_trees": self.n_trees, "seed": self.seed, "root_state": int(self.root_state),
                 "root_value": self.root_value, "n_nodes": int(self.n_nodes), "importances": [float(v) for v in self.importances], "shift": self.shift, "scale": self.scale}
        self.splits.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")

    @staticmethod
    def load(spark, path: str) -> ExtraTreesModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first().value)
        importances = np.array(facts.pop("importances"))
        return ExtraTreesModel(**facts, importances=importances, splits=spark.read.schema(SPLITS).parquet(f"{path}/splits"), subtrees=spark.read.schema(SUBTREES).parquet(f"{path}/subtrees"))

    def feature_importances(self, spark, names) -> DataFrame:
        """``(feature, vi_model_raw)`` for the importance blend."""
        return spark.createDataFrame([(n, float(v)) for n, v in zip(names, self.importances, strict=True)], "feature string, vi_model_raw double")

    def transform(self, df: DataFrame, features: str = "x", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
        """The rows of ``df`` with ``prediction`` (and ``probability``, an array, for classification)."""
        if not self.n_nodes:
            raise ValueError("the forest was grown for its importances only")
        groups = self._groups(broadcast_nodes)
        if groups:
            votes = df
            for i, trees in enumerate(groups):
                votes = self._votes_by_broadcast(votes, features, trees)
                if i + 1 < len(groups):  # so that one group's nodes are held at a time
                    votes = saved(votes, "votes")
        else:
            votes = self._votes_by_join(df, features, self.splits.count() > broadcast_nodes)
        mean = F.transform("_votes", lambda v: v / F.lit(float(self.n_trees)))
        if self.task == "classification":
            return (votes.withColumn("probability", mean).drop("_votes")
                    .withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")))
        return votes.withColumn("prediction", mean[0] * F.lit(self.scale) + F.lit(self.shift)).drop("_votes")

    def _groups(self, broadcast_nodes: int) -> list[list[int]]:
        """The trees in groups of at most so many nodes, which may go to every task together; none if one tree alone has more."""
        if self.n_nodes <= broadcast_nodes:
            return [list(range(self.n_trees))]
        if not broadcast_nodes:
            return []
        nodes = self.subtrees.select("tree", F.size("feat").alias("n")).union(self.splits.select("tree", F.lit(2).alias("n"))).groupBy("tree").agg(F.sum("n").alias("n"))
        sizes = {r.tree: r.n for r in nodes.collect()}  # a row per tree
        groups, size = [[]], 0
        for t in range(self.n_trees):
            mine = sizes.get(t, 0) + 1
            if mine > broadcast_nodes:
                return []
            if size + mine > broadcast_nodes:
                groups.append([])
                size = 0
            groups[-1].append(t)
            size += mine
        return groups

    def _top(self, trees: list[int] | None = None):
        """Routes rows of a matrix through the distributed levels of one tree."""
        splits = self.splits if trees is None else self.splits.where(F.col("tree").between(trees[0], trees[-1]))
        held = splits.sparkSession.sparkContext.broadcast(splits.toArrow())  # trees x rows / local_rows nodes
        seed, root_state, root_value = self.seed, self.root_state, self.root_value

        def top():
            splits = _Splits(held.value)

            def route(tree: int, x):
                node, state = np.full(len(x), root_key(seed, tree)), np.full(len(x), root_state)
                value = np.tile(np.asarray(root_value, dtype=np.float64), (len(x), 1))
                while len(splits.advance(tree, x, node, state, value)):
                    pass
                return node, state, value

            return route

        return top

    def _votes_by_broadcast(self, df: DataFrame, features: str, group: list[int]) -> DataFrame:
        """``df`` with the votes of a group of neighbouring trees, added to those there are."""
        top, at, given = self._top(group), df.columns.index(features), "_votes" in df.columns
        held = df.sparkSession.sparkContext.broadcast(self.subtrees.where(F.col("tree").between(group[0], group[-1])).drop("imp").toArrow())
        schema = T.StructType([*(f for f in df.schema.fields if f.name != "_votes"), T.StructField("_votes", T.ArrayType(T.DoubleType()))])
        width = len(self.root_value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            route, trees = top(), {}
            for r in held.value.to_batches(1024):
                for i, (t, node) in enumerate(zip(r.column("tree").to_pylist(), r.column("node").to_pylist(), strict=True)):
                    feat, thr, left, value = (r.column(c)[i].values.to_numpy() for c in ("feat", "thr", "left", "value"))
                    trees.setdefault(t, []).append((node, feat, thr, left, value.reshape(-1, width)))
            for batch in batches:
                x = _matrix(batch.column(at))
                votes = _matrix(batch.column("_votes")).copy() if given else np.zeros((len(x), width))
                for t in group if len(x) else ():
                    node, state, value = route(t, x)
                    for key, feat, thr, left, values in trees.get(t, ()):
                        rows = np.flatnonzero((node == key) & (state >= LOCAL))
                        value[rows] = values[_route(x[rows], feat, thr, left)]
                    votes += value
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), _lists(votes)], names=schema.names)

        return df.mapInArrow(run, schema)

    def _routed(self, rows: DataFrame, features: str) -> DataFrame:
        """(tree, node, kind, _row, x, value) of rows at every tree, one join a level with the splits, for forests whose splits are too many to send."""
        trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(root_key(self.seed, t)).cast("long").alias("node")) for t in range(self.n_trees)])).alias("t")
        value = F.array(*[F.lit(float(v)) for v in self.root_value])
        at = rows.select("_row", F.col(features).alias("x"), trees).select("t.tree", "t.node", F.lit(self.root_state).alias("state"), "_row", "x", value.alias("value"))
        schema = at.schema

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, value = _matrix(batch.column("x")), _matrix(batch.column("value")).copy()
                node, state = batch.column("node").to_numpy().copy(), batch.column("state").to_numpy().copy()
                has = np.asarray(batch.column("feature").is_valid()) & (state == OPEN)
                state[(state == OPEN) & ~has] = LEAF
                rows = np.flatnonzero(has)
                f, v, l, r = (batch.column(c).fill_null(0).to_numpy()[rows] for c in ("feature", "threshold", "left_state", "right_state"))
                right = x[rows, f.astype(np.int64)] > v
                node[rows] = np.where(right, child_keys(node[rows], 1), child_keys(node[rows], 0))
                state[rows] = np.where(right, r, l)
                for side, c in ((right, "right_value"), (~right, "left_value")):
                    mine = rows[side]
                    if len(mine):
                        value[mine] = _matrix(batch.column(c).take(pa.array(mine)))
                yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array(node), pa.array(state), batch.column("_row"), batch.column("x"), _lists(value)], names=schema.names)

        for (depth,) in sorted(tuple(r) for r in self.splits.select("depth").distinct().collect()):  # a row per level
            level = self.splits.where(F.col("depth") == depth).select("tree", F.col("node").alias("_n"), "feature", "threshold", "left_state", "right_state", "left_value", "right_value")
            key = F.when(F.col("state") == OPEN, F.col("node")).otherwise(F.xxhash64("_row"))  # others meet nothing and spread
            at = saved(at.withColumn("_n", key).join(level, ["tree", "_n"], "left").select(*schema.names, *level.columns[2:]).mapInArrow(step, schema), "routed")
        local = F.col("state") >= LOCAL
        zero = F.array(*[F.lit(0.0)] * len(self.root_value))
        return at.select("tree", "node", F.when(local, 1).otherwise(2).alias("kind"), "_row", "x", F.when(local, zero).otherwise(F.col("value")).alias("value"))

    def _votes_by_join(self, df: DataFrame, features: str, levels: bool = False) -> DataFrame:
        """Rows and subtrees meet by (tree, node); a subtree comes first and the rows stream past it.  ``levels``: rows meet the splits of the upper
        levels by joins as well."""
        top, n_trees, width = None if levels else self._top(), self.n_trees, len(self.root_value)
        rows = saved(df.withColumn("_row", F.monotonically_increasing_id()), "scored-rows")
        order = _struct(f"{SUBTREES}, kind int, _row long, x array<double>").names
        told = "tree int, node long, kind int, _row long, x array<double>, value array<double>"

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            route = top()
            for batch in batches:
                x, ids = _matrix(batch.column(1)), batch.column(0)
                for t in range(n_trees) if len(x) else ():
                    node, state, value = route(t, x)
                    local = state >= LOCAL
                    value[local] = 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(node), pa.array(np.where(local, 1, 2).astype(np.int32)), ids, _lists(x), _lists(value)],
                        names=["tree", "node", "kind", "_row", "x", "value"])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = sub = None
            for batch in batches:
                ids, votes = [], []
                kinds = np.array(batch.column("kind").to_pylist())
                place = list(zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist(), strict=True))
                bounds = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1] or kinds[i] != kinds[i - 1]), len(place)]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    if kinds[a] == 0:
                        key = place[a]
                        feat, thr, left, value = (batch.column(c)[a].values.to_numpy() for c in ("feat", "thr", "left", "value"))
                        sub = (feat, thr, left, value.reshape(-1, width))
                    elif place[a] == key:
                        x = _matrix(batch.column("x").slice(a, b - a))
                        ids += batch.column("_row").slice(a, b - a).to_pylist()
                        votes.append(sub[3][_route(x, *sub[:3])])
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(np.concatenate(votes))], names=["_row", "value"])

        given = self._routed(rows, features) if levels else rows.select("_row", F.col(features).alias("x")).mapInArrow(spread, told)
        done = given.where("kind = 2").select("_row", "value")
        empty = {c: F.lit(None).cast(t) for c, t in (("feat", "array<int>"), ("thr", "array<double>"), ("left", "array<int>"), ("value", "array<double>"), ("imp", "array<double>"))}
        asked = given.where("kind = 1").drop("value").withColumns(empty).select(order)
        trees = self.subtrees.withColumns({"kind": F.lit(0), "_row": F.lit(0).cast("long"), "x": F.array().cast("array<double>")}).select(order)
        met = trees.union(asked).repartition("tree", "node").sortWithinPartitions("tree", "node", "kind").mapInArrow(finish, "_row long, value array<double>")
        total = done.union(met).groupBy("_row").agg(F.array(*[F.sum(F.col("value")[i]) for i in range(width)]).alias("_votes"))
        return rows.join(total, "_row").drop("_row")


class ExtraTrees:
    """``fit(df)`` expects ``x array<double>`` and ``label double`` (classes 0..K-1)."""

    def __init__(self, task: str, n_trees: int = 100, mtry: int | None = None, min_leaf: int = 1, max_depth: int | None = None,
                 seed: int = 42, local_rows: int | None = None, n_classes: int | None = None, nodes: bool = True):
        """``nodes=False``: the forest is grown for its importances only, and its subtrees' nodes are not written."""
        self.task, self.n_trees, self.mtry, self.min_leaf = task, n_trees, mtry, max(1, min_leaf)
        self.max_depth, self.seed, self.local_rows, self.n_classes, self.nodes = max_depth, seed, local_rows, n_classes, nodes

    def fit(self, df: DataFrame, features: str = "x", label: str = "label") -> ExtraTreesModel:
        spark, task, seed = df.sparkSession, self.task, self.seed
        data = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"))
        facts = data.agg(F.max(F.size("x")).alias("p"), F.count("*").alias("n"), F.max("y").alias("top"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        p, n = facts.p or 0, facts.n
        shift, scale, k = 0.0, 1.0, 0
        if task == "classification":
            k = self.n_classes or int(facts.top or 0) + 1
        else:
            shift, scale = float(facts.m or 0.0), float(facts.s or 0.0) or 1.0  # well-conditioned sums
            data = data.select("x", ((F.col("y") - F.lit(shift)) / F.lit(scale)).alias("y"))
        self._k, self._width = k, (k if task == "classification" else 3)
        self._m = max(1, min(p, int(self.mtry or (math.sqrt(p) if task == "classification" else p)))) if p else 1
        local_rows = self.local_rows or max(1000, LOCAL_NUMBERS // (p + 1))
        open_nodes = 2 * n // local_rows + 1
        per_batch = max(1, min(self.n_trees, TREES_AT_ONCE, OPEN_NUMBERS // max(1, open_nodes * (2 * p + self._m * self._width))))
        data = data.repartition(max(spark.sparkContext.defaultParallelism, n * (p + 1) // LOCAL_NUMBERS + 1)).persist()  # in turn: equal rows spread

        if task == "classification":
            total = {int(r.y): r["count"] for r in data.groupBy("y").count().collect()}  # a row per class
            stats = np.array([total.get(c, 0) for c in range(k)], dtype=np.float64)
        else:
            s = data.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).first()
            stats = np.array([n, s.s or 0.0, s.q or 0.0])
        root_state = LEAF if p == 0 or _terminal(stats[None], task, 0, self.min_leaf, self.max_depth)[0] else OPEN if n > local_rows else LOCAL
        splits, subtrees = [], []
        if root_state != LEAF:
            held = self._coded(data, p, n) if root_state == OPEN and not self.local_rows else None
            if held is not None:
                root_state = LOCAL
                subtrees.append(self._grow_dealt(spark, *held))
            elif root_state == LOCAL:
                subtrees.append(self._grow_held(data, p))
            for first in range(0, self.n_trees if root_state == OPEN else 0, per_batch):
                trees = list(range(first, min(first + per_batch, self.n_trees)))
                top, low = self._grow_batch(data, trees, p, local_rows, root_state)
                splits += top
                subtrees.append(low)
        data.unpersist()

        def together(parts, ddl):
            out = parts[0] if parts else spark.createDataFrame([], ddl)
            for x in parts[1:]:
                out = out.union(x)
            return out

        top, low = together(splits, SPLITS), together(subtrees, SUBTREES)
        gains = (top.select("tree", "feature", "gain").union(low.select("tree", F.posexplode("imp").alias("feature", "gain")))
                 .groupBy("tree", "feature").agg(F.sum("gain").alias("g")))
        totals = gains.groupBy("tree").agg(F.sum("g").alias("t"))
        shares = gains.join(totals, "tree").where("t > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("v")).collect()  # a row per feature
        imp = np.zeros(p)
        for r in shares:
            imp[r.feature] = r.v
        imp = imp / imp.sum() if imp.sum() > 0 else imp
        size = (low.agg(F.sum(F.size("feat")).alias("n")).first().n or 0) if self.nodes else 0
        return ExtraTreesModel(task, p, k, self.n_trees, seed, top, low, root_state, [float(v) for v in _value(stats[None], task)[0]],
                               size + 2 * top.count() + self.n_trees if self.nodes else 0, imp, shift, scale)

    def _grow_held(self, data: DataFrame, p: int) -> DataFrame:
        """The trees of a table of at most ``local_rows`` rows: it goes to the tasks once and the trees are dealt, so that no row is shuffled per tree."""
        m = self._m
        table = data.toArrow()
        x, y = _matrix(table.column("x")), table.column("y").to_numpy()
        order = np.lexsort(np.column_stack([x, y]).T[::-1])
        x, y = x[order], y[order]
        if p > max(NARROW, 2 * m):
            return self._grow_dealt(data.sparkSession, x, None, y)
        cols, tables = zip(*(code(x[:, j]) for j in range(p)), strict=True)
        return self._grow_dealt(data.sparkSession, list(cols), list(tables), y)

    def _grow_dealt(self, spark, cols, tables, y) -> DataFrame:
        """The trees of a held table: its columns as ``code`` gives them, or a matrix without ``tables``."""
        task, k, m, min_leaf, max_depth, seed, nodes = self.task, self._k, self._m, self.min_leaf, self.max_depth, self.seed, self.nodes
        held = spark.sparkContext.broadcast((cols, tables, y.astype(np.int32) if task == "classification" and tables is not None else y))
        dealt = spark.range(0, self.n_trees, 1, max(1, self.n_trees // TREES_TOGETHER))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    key, (cols, tables, y) = root_key(seed, t), held.value
                    if tables is None:
                        tree = grow(cols, y, task, k, m, min_leaf, max_depth, key, 0, in_order=True)
                    else:
                        tree = grow_columns(cols, tables, y, task, k, m, min_leaf, max_depth, key, 0, nodes)
                    yield _subtree(t, key, *tree)

        out = saved(dealt.mapInArrow(run, SUBTREES), "subtrees")
        held.destroy()
        return out

    def _coded(self, data: DataFrame, p: int, n: int):
        """The columns of a narrow table as ``code`` gives them, their values, and the labels, for the tasks to hold; none if they take more than ``HELD_BYTES``."""
        if p > max(NARROW, 2 * self._m):
            return None

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The different values of every column, NaN in their place where there are many."""
            seen = [np.zeros(0)] * p
            for batch in batches:
                x = _matrix(batch.column(0))
                for j in range(p) if len(x) else ():
                    if seen[j] is not None:
                        seen[j] = np.unique(np.concatenate([seen[j], x[:, j]]))
                        if len(seen[j]) > CODED_VALUES or np.isnan(seen[j]).any():
                            seen[j] = None
            told = [np.array([np.nan]) if v is None else v for v in seen]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(p, dtype=np.int32), [len(v) for v in told])), pa.array(np.concatenate(told))], names=["f", "v"])

        got = data.mapInArrow(few, "f int, v double").distinct().toArrow()  # at most CODED_VALUES of a column and task
        f, v = got.column("f").to_numpy(), got.column("v").to_numpy()
        tables = [np.unique(v[f == j]) for j in range(p)]
        tables = [None if len(t) > CODED_VALUES or np.isnan(t).any() else t for t in tables]
        classes = self.task == "classification"
        if n * (sum(8 if t is None else 1 for t in tables) + (4 if classes else 8)) > HELD_BYTES:
            return None

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                    cols = [x[:, j] if t is None else np.searchsorted(t, x[:, j]).astype(np.uint8) for j, t in enumerate(tables)]
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (*cols, y.astype(np.int32 if classes else np.float64))],
                                                     names=[*(f"c{j}" for j in range(p)), "y"])

        packed = data.mapInArrow(pack, ", ".join([*(f"c{j} binary" for j in range(p)), "y binary"])).toArrow()
        whole = lambda c, kind: np.frombuffer(b"".join(packed.column(c).to_pylist()), dtype=kind)
        cols, y = [whole(j, np.float64 if t is None else np.uint8) for j, t in enumerate(tables)], whole(p, np.int32 if classes else np.float64)
        if not classes:  # sums run in one order for any layout; counts are exact
            order = np.argsort(y, kind="stable")
            cols, y = [c[order] for c in cols], y[order]
        return cols, tables, y

    def _grow_batch(self, data: DataFrame, trees: list[int], p: int, local_rows: int, root_state: int) -> tuple[list[DataFrame], DataFrame]:
        """Split tables of each distributed level, and the subtrees, of a batch of trees."""
        task, k, m, width, min_leaf, max_depth, seed, nodes = self.task, self._k, self._m, self._width, self.min_leaf, self.max_depth, self.seed, self.nodes
        spark, n_trees = data.sparkSession, len(trees)
        roots = [root_key(seed, t) for t in trees]
        schema = _struct("x array<double>, y double, node array<long>, state array<int>")
        state = data.select("x", "y", F.array(*[F.lit(r).cast("long") for r in roots]).alias("node"), F.array_repeat(F.lit(root_state), n_trees).alias("state"))

        def read(batch: pa.RecordBatch):
            ints = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_trees) for c in (2, 3)]
            return _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), *ints

        def sums(visitor, names):
            """A map function: adds up, over a task's rows, what ``visitor()`` gives per (tree, node); long form."""
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, visit = {}, visitor()
                for batch in batches:
                    if batch.num_rows:
                        x, y, node, at = read(batch)
                        for i, t in enumerate(trees):
                            rows = np.flatnonzero(at[:, i] == OPEN)
                            if len(rows):
                                keys, a = np.unique(node[rows, i], return_inverse=True)
                                visit(held, t, keys, a, x[rows], y[rows])
                    if len(held) * (2 * p + m * width) > OPEN_NUMBERS:  # partial sums are added up again anyway
                        yield from told(held)
                        held = {}
                yield from told(held)

            return run

        def told(held: dict) -> Iterator[pa.RecordBatch]:
            for (t, key), (low, high, add) in held.items():
                size = len(add)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, t, dtype=np.int32)), pa.array(np.full(size, key)), pa.array(np.arange(size, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(add)], names=names)

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Left sides from rows that hold their node's candidates themselves; rows of a node lie together."""
            held = {}
            for batch in batches:
                nodes = batch.column("_n").to_numpy()
                x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
                order = np.argsort(nodes, kind="stable")
                keys, start = np.unique(nodes[order], return_index=True)
                for key, a, b in zip(keys.tolist(), start.tolist(), [*start[1:].tolist(), len(nodes)], strict=True):
                    rows = order[a:b]
                    f, v = (batch.column(c)[int(rows[0])].values.to_numpy() for c in ("feature", "threshold"))
                    cand, thr = np.full((1, m), -1, dtype=np.int64), np.zeros((1, m))
                    cand[0, : len(f)], thr[0, : len(f)] = f, v
                    add = _left_stats(x[rows], y[rows], np.zeros(len(rows), dtype=np.int64), cand, thr, task, k, 1).ravel()
                    old = held.get((trees[0], key))
                    held[trees[0], key] = (np.zeros(m * width), np.zeros(m * width), add if old is None else old[2] + add)
                if len(held) * m * width > OPEN_NUMBERS:
                    yield from told(held)
                    held = {}
            yield from told(held)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Moves rows that hold their node's split themselves."""
            for batch in batches:
                if batch.num_rows:
                    x, _, node, at = read(batch)
                    node, at = node.copy(), at.copy()
                    has = np.asarray(batch.column("feature").is_valid()) & (at[:, 0] == OPEN)
                    at[(at[:, 0] == OPEN) & ~has, 0] = LEAF
                    rows = np.flatnonzero(has)
                    f, v, l, r = (batch.column(c).fill_null(0).to_numpy()[rows] for c in ("feature", "threshold", "left_state", "right_state"))
                    right = x[rows, f.astype(np.int64)] > v
                    old = node[rows, 0]
                    node[rows, 0] = np.where(right, child_keys(old, 1), child_keys(old, 0))
                    at[rows, 0] = np.where(right, r, l)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(node), _lists(at.astype(np.int32))], names=schema.names)

        def ranges(held, t, keys, a, x, y):
            order = np.argsort(a, kind="stable")
            start = np.searchsorted(a[order], np.arange(len(keys)))
            low, high = np.minimum.reduceat(x[order], start, axis=0), np.maximum.reduceat(x[order], start, axis=0)
            stats = _node_stats(y, a, task, k, len(keys))
            for i, key in enumerate(keys.tolist()):
                zero = np.zeros(width)
                new = (np.concatenate([zero, low[i]]), np.concatenate([zero, high[i]]), np.concatenate([stats[i], np.zeros(p)]))
                old = held.get((t, key))
                held[t, key] = new if old is None else (np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), old[2] + new[2])

        def root_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The root's ranges and label sums; all trees of the batch share them."""
            held = {}
            for batch in batches:
                if batch.num_rows:
                    x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                    ranges(held, trees[0], np.array([roots[0]]), np.zeros(len(x), dtype=np.int64), x, y)
            yield from told(held)

        names = ["tree", "node", "slot", "low", "high", "total"]
        ddl = "tree int, node long, slot int, low double, high double, total double"
        cand_ddl = "tree int, node long, depth int, stats array<double>, feature array<int>, threshold array<double>"
        found, depth, sent = [], 0, []
        earlier = None
        local = root_state >= LOCAL
        while root_state == OPEN:
            if depth:  # at the root, node and state are constants
                state = state.persist()

            level_depth = depth

            def draw(table: pa.Table) -> pa.Table:
                table = table.sort_by("slot")
                low, high, total = (table.column(c).to_numpy() for c in ("low", "high", "total"))
                t, key, stats = table.column("tree")[0].as_py(), table.column("node")[0].as_py(), total[:width]
                order, u = draws(np.array([key], dtype=np.int64), p)
                cand, thr = _candidates(low[None, width:], high[None, width:], order, u, m)
                good = cand[0] >= 0
                return _table(cand_ddl, [(t, key, level_depth, stats.tolist(), cand[0][good].tolist(), thr[0][good].tolist())])

            span = F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")
            if depth:
                gathered = state.mapInArrow(sums(lambda: ranges, names), ddl).groupBy("tree", "node", "slot").agg(*span)
            else:
                every = spark.createDataFrame(list(zip(trees, roots, strict=True)), "tree int, node long")
                gathered = every.crossJoin(data.mapInArrow(root_ranges, ddl).groupBy("slot").agg(*span))
            cands = saved(gathered.groupBy("tree", "node").applyInArrow(draw, cand_ddl), "candidates")
            if earlier is not None:
                earlier.unpersist()
            # what of the open level goes to every task is counted first; beyond the bound (then a batch is one tree) rows meet it by node
            by_join = n_trees == 1 and cands.count() * 2 * m > OPEN_NUMBERS
            held_cands = None if by_join else spark.sparkContext.broadcast(cands.drop("stats", "depth").toArrow())

            def visitor(held_cands=held_cands):
                known = {(r["tree"], r["node"]): (r["feature"], r["threshold"]) for r in held_cands.value.to_pylist()}

                def lefts(held, t, keys, a, x, y):
                    cand, thr = np.full((len(keys), m), -1, dtype=np.int64), np.zeros((len(keys), m))
                    for i, key in enumerate(keys.tolist()):
                        f, v = known.get((t, key), ((), ()))
                        cand[i, : len(f)], thr[i, : len(f)] = f, v
                    stats = _left_stats(x, y, a, cand, thr, task, k, len(keys)).reshape(len(keys), -1)
                    zero = np.zeros(m * width)
                    for i, key in enumerate(keys.tolist()):
                        old = held.get((t, key))
                        held[t, key] = (zero, zero, stats[i] if old is None else old[2] + stats[i])

                return lefts

            def root_lefts(batches: Iterator[pa.RecordBatch], held_cands=held_cands) -> Iterator[pa.RecordBatch]:
                """Left sides of all trees' candidates at the root, one product a batch."""
                known = {r["tree"]: list(zip(r["feature"], r["threshold"], strict=True)) for r in held_cands.value.to_pylist()}
                place = [(t, i, *c) for t, listed in known.items() for i, c in enumerate(listed)]
                f, v = np.array([c[2] for c in place], dtype=np.int64), np.array([c[3] for c in place])
                added = np.zeros((len(place), width))
                for batch in batches:
                    if batch.num_rows and place:
                        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                        s = np.eye(k)[y.astype(np.int64)] if task == "classification" else np.stack([np.ones_like(y), y, y * y], axis=1)
                        added += (x[:, f] <= v).astype(np.float64).T @ s
                lefts = {t: np.zeros((m, width)) for t in known}
                for (t, i, *_), row in zip(place, added, strict=True):
                    lefts[t][i] = row
                zero = np.zeros(m * width)
                yield from told({(t, root_key(seed, t)): (zero, zero, add.ravel()) for t, add in lefts.items()})

            def pick(sides: pa.Table, listed: pa.Table) -> pa.Table:
                if not len(sides) or not len(listed):
                    return _table(SPLITS, [])
                c = listed.to_pylist()[0]
                left = sides.sort_by("slot").column("total").to_numpy().reshape(1, m, width)
                total = np.array([c["stats"]])
                cand, thr = np.full((1, m), -1, dtype=np.int64), np.zeros((1, m))
                cand[0, : len(c["feature"])], thr[0, : len(c["feature"])] = c["feature"], c["threshold"]
                b, gain = _best(total, left, cand, task, min_leaf)
                if b[0] < 0:
                    return _table(SPLITS, [])
                children = np.stack([left[0, b[0]], total[0] - left[0, b[0]]])
                rows, _ = _impurity(children, task)
                leaf = _terminal(children, task, c["depth"] + 1, min_leaf, max_depth)
                states = [LEAF if e else OPEN if r > local_rows else LOCAL + c["depth"] + 1 for e, r in zip(leaf, rows, strict=True)]
                values = _value(children, task).tolist()
                return _table(SPLITS, [(c["tree"], c["node"], c["depth"], int(cand[0, b[0]]), float(thr[0, b[0]]), float(gain[0]), float(rows[0]), float(rows[1]), *states, *values)])

            if by_join:
                open_rows = state.where(F.col("state")[0] == OPEN).select("x", "y", F.col("node")[0].alias("_n"))
                sides = open_rows.join(cands.select(F.col("node").alias("_n"), "feature", "threshold"), "_n").mapInArrow(met, ddl)
            else:
                sides = state.mapInArrow(sums(visitor, names), ddl) if depth else data.mapInArrow(root_lefts, ddl)
            sides = sides.groupBy("tree", "node", "slot").agg(F.sum("total").alias("total"))
            level = saved(sides.groupBy("tree", "node").cogroup(cands.groupBy("tree", "node")).applyInArrow(pick, SPLITS), "splits")
            found.append(level)
            local = local or level.where(f"left_state >= {LOCAL} or right_state >= {LOCAL}").limit(1).count() > 0
            left_open = level.where(f"left_state = {OPEN} or right_state = {OPEN}").limit(1).count()
            held_level = None if by_join else spark.sparkContext.broadcast(level.toArrow())
            sent += [b for b in (held_cands, held_level) if b is not None]

            def move(batches: Iterator[pa.RecordBatch], held_level=held_level) -> Iterator[pa.RecordBatch]:
                splits = _Splits(held_level.value)
                for batch in batches:
                    if batch.num_rows:
                        x, _, node, at = read(batch)
                        node, at = node.copy(), at.copy()
                        for i, t in enumerate(trees):
                            mine, states = node[:, i].copy(), at[:, i].copy()
                            splits.advance(t, x, mine, states)
                            node[:, i], at[:, i] = mine, states
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(node), _lists(at.astype(np.int32))], names=schema.names)

            if by_join:
                # rows that are no longer open meet nothing; keys of their own spread them
                key = F.when(F.col("state")[0] == OPEN, F.col("node")[0]).otherwise(F.xxhash64(F.monotonically_increasing_id()))
                moved = (state.withColumn("_n", key).join(level.select(F.col("node").alias("_n"), "feature", "threshold", "left_state", "right_state"), "_n", "left")
                         .select("x", "y", "node", "state", "feature", "threshold", "left_state", "right_state").mapInArrow(step, schema))
            else:
                moved = state.mapInArrow(move, schema)
            earlier, state, depth = state, moved, depth + 1
            if not left_open:
                break

        row_ddl = "tree int, node long, depth int, x array<double>, y double"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y, node, at = read(batch)
                    for i, t in enumerate(trees):
                        rows = np.flatnonzero(at[:, i] >= LOCAL)
                        if len(rows):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(node[rows, i]), pa.array((at[rows, i] - LOCAL).astype(np.int32)), _lists(x[rows]), pa.array(y[rows])],
                                names=["tree", "node", "depth", "x", "y"])

        def finish(table: pa.Table) -> pa.Table:
            t, key, at = (table.column(c)[0].as_py() for c in ("tree", "node", "depth"))
            return pa.Table.from_batches([_subtree(t, key, *grow(_matrix(table.column("x")), table.column("y").to_numpy(), task, k, m, min_leaf, max_depth, key, at, nodes=nodes))])

        if local:
            low = saved(state.mapInArrow(deal, row_ddl).groupBy("tree", "node").applyInArrow(finish, SUBTREES), "subtrees")
        else:  # no node is left to grow
            low = spark.createDataFrame([], SUBTREES)
        if earlier is not None:
            earlier.unpersist()
        for held in sent:
            held.destroy()
        return found, low
