"""Null-safe statistics and exact distributed order statistics.

``percentile``/``median`` in Spark keep a value->count map per group and merge
it in one task: exact, but unbounded when a column has billions of distinct
values.  ``kth_values`` finds exact order statistics by iterative histogram
refinement instead: every job is a scan with a map-side partial aggregate of at
most ``buckets`` rows per probe, and only rows inside a final small bucket are
ever ranked together.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation on pairwise-complete rows; null when either side is constant."""
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.covar_pop(a2, b2) / F.nullif(F.stddev_pop(a2) * F.stddev_pop(b2), F.lit(0.0))


def to_long(df: DataFrame, ids: list[str], cols: list[str], key: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide -> long (one row per id and feature), values as double."""
    src = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return src.unpivot(ids, list(cols), key, value)


def kth_values(base: DataFrame, targets: list[tuple[str, int]], buckets: int = 1024,
               pick_limit: int = 4096, stats: dict | None = None, ties: dict | None = None,
               guess: dict | None = None) -> dict[tuple[str, int], float]:
    """Exact k-th smallest values per key.

    ``base`` has columns ``k`` (string) and ``v`` (double, non-null).  ``targets``
    lists ``(key, rank)`` with 0-based ranks.  ``stats`` may give the known
    ``{key: (n, min, max)}`` (e.g. a hash range) to skip the first pass.  When
    ``ties`` is a dict it receives, per target, ``(n_below, n_equal)``: rows
    strictly below the value and rows equal to it.  ``guess`` may give, per target, a
    range that likely holds the value: one counting pass starts there if it does.
    The driver only ever holds one row per target.  Every round narrows each
    target's range to one bucket of it, so the search ends by itself.
    """
    spark = base.sparkSession
    if not targets:
        return {}
    if stats is None:
        stats = {r["k"]: (r["n"], r["mn"], r["mx"]) for r in
                 base.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("mn"),
                                       F.max("v").alias("mx")).collect()}
    state = {}
    result: dict[tuple[str, int], float] = {}
    for tid, (k, r) in enumerate(sorted(set(targets))):
        n, mn, mx = stats.get(k, (0, None, None))
        if n == 0 or r < 0 or r >= n:
            result[(k, r)] = None
            continue
        if mn == mx:
            result[(k, r)] = mn
            if ties is not None:
                ties[(k, r)] = (0, n)
            continue
        state[tid] = {"k": k, "r": r, "lo": mn, "hi": mx, "below": 0, "cnt": n}

    near = {t: guess[(s["k"], s["r"])] for t, s in state.items() if guess and (s["k"], s["r"]) in guess}
    if near:
        gdf = spark.createDataFrame([(t, state[t]["k"], float(lo), float(hi)) for t, (lo, hi) in near.items()],
                                    "tid int, k string, lo double, hi double")
        inside = F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), F.col("v"))
        for row in (base.join(F.broadcast(gdf), "k").groupBy("tid")
                    .agg(F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"), F.count(inside).alias("c"),
                         F.min(inside).alias("mn"), F.max(inside).alias("mx")).collect()):
            s = state[row["tid"]]
            if row["c"] and row["below"] <= s["r"] < row["below"] + row["c"]:
                s.update(lo=row["mn"], hi=row["mx"], below=row["below"], cnt=row["c"])
    while state:
        small = {t: s for t, s in state.items() if s["cnt"] <= pick_limit}
        large = {t: s for t, s in state.items() if t not in small}
        if small:
            tdf = spark.createDataFrame(
                [(t, s["k"], float(s["lo"]), float(s["hi"]), int(s["r"] - s["below"])) for t, s in small.items()],
                "tid int, k string, lo double, hi double, need long")
            w = Window.partitionBy("tid").orderBy("v")  # at most pick_limit rows per target
            picked = (base.join(F.broadcast(tdf), "k")
                      .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                      .withColumn("rn", F.row_number().over(w) - 1)
                      .withColumn("rk", F.rank().over(w) - 1)
                      .withColumn("eq", F.count(F.lit(1)).over(Window.partitionBy("tid", "v")))
                      .where(F.col("rn") == F.col("need"))
                      .select("tid", "v", "rk", "eq").collect())
            for row in picked:
                s = small[row["tid"]]
                result[(s["k"], s["r"])] = row["v"]
                if ties is not None:
                    ties[(s["k"], s["r"])] = (s["below"] + row["rk"], row["eq"])
            for t in small:
                state.pop(t)
        if large:
            # Targets that share a key and a range share one histogram ("probe").
            probes: dict[tuple, int] = {}
            for t, s in large.items():
                probes.setdefault((s["k"], s["lo"], s["hi"]), len(probes))
            pdf = spark.createDataFrame(
                [(pid, k, float(lo), float(hi)) for (k, lo, hi), pid in probes.items()],
                "pid int, k string, lo double, hi double")
            tdf = spark.createDataFrame(
                [(t, probes[(s["k"], s["lo"], s["hi"])], int(s["r"] - s["below"])) for t, s in large.items()],
                "tid int, pid int, need long")
            half_span = F.col("hi") * 0.5 - F.col("lo") * 0.5
            pos = (F.col("v") * 0.5 - F.col("lo") * 0.5) / half_span * buckets
            bucket = (F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), buckets - 1)
                      .otherwise(F.greatest(F.lit(0), F.least(F.floor(pos), F.lit(buckets - 1)))).cast("int"))
            hist = (base.join(F.broadcast(pdf), "k")
                    .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                    .groupBy("pid", bucket.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")))
            w = Window.partitionBy("pid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
            hist = hist.withColumn("cum", F.sum("c").over(w))
            chosen = (hist.join(F.broadcast(tdf), "pid")
                      .where((F.col("cum") - F.col("c") <= F.col("need")) & (F.col("need") < F.col("cum")))
                      .select("tid", "c", "mn", "mx", (F.col("cum") - F.col("c")).alias("before"))
                      .collect())
            for row in chosen:
                s = state[row["tid"]]
                s["below"] += row["before"]
                s["lo"], s["hi"], s["cnt"] = row["mn"], row["mx"], row["c"]
                if row["mn"] == row["mx"]:
                    result[(s["k"], s["r"])] = row["mn"]
                    if ties is not None:
                        ties[(s["k"], s["r"])] = (s["below"], row["c"])
                    state.pop(row["tid"])
    return result


def exact_mean(x: Column) -> Column:
    """Mean that no order of rows changes, where every value has at most 10 decimals: an exact decimal sum
    divided once.  Other columns get the plain average."""
    d = x.try_cast("decimal(30,10)")
    exact = F.coalesce(F.bool_and(d.cast("double") == x), F.lit(False)) & (F.count(d) == F.count(x))
    return F.when(exact, F.sum(d).cast("double") / F.count(x)).otherwise(F.avg(x))


def pearson_pairs(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """(a, b, corr) for all pairs of columns (a before or equal to b), or of each column with ``target``.

    Each task adds up, per pair, count, sums, squares and products of the rows where both are present (NumPy matrix
    products over Arrow batches); the tasks' sums meet in one aggregate.  Values are taken relative to one row's, so that
    sums stay well conditioned.  Null when a side is constant."""
    import numpy as np
    import pyarrow as pa

    names = list(cols) + ([target] if target else [])
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    first = src.first()
    base = np.array([0.0 if first is None or v is None or math.isnan(v) else v for v in (first or [0.0] * len(names))])
    p = len(names)
    i, j = (np.arange(p - 1), np.full(p - 1, p - 1)) if target else np.triu_indices(p)
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"

    def sums(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - base
            m = (~np.isnan(x)).astype(np.float64)
            x = np.where(m > 0, x, 0.0)
            xr, mr = (x[:, -1:], m[:, -1:]) if target else (x, m)
            part = [m.T @ mr, x.T @ mr, m.T @ xr, (x * x).T @ mr, m.T @ (xr * xr), x.T @ xr]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            at = (i, np.zeros_like(j)) if target else (i, j)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[at]) for t in total]],
                                             names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    s = src.mapInArrow(sums, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(square, total):  # zero within rounding: the column is constant
        v = F.col("n") * F.col(square) - F.col(total) * F.col(total)
        return F.when(v > 1e-14 * F.col("n") * F.col(square), v)

    corr = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
    label = F.array(*[F.lit(c) for c in names])
    return s.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"),
                    F.when(F.col("i") == F.col("j"), F.when(spread("sxx", "sx").isNotNull(), 1.0)).otherwise(corr).alias("corr"))


def exact_quantiles(long_df: DataFrame, key: str, value: str, probs: list[float], stats: dict | None = None,
                    **kw) -> dict[tuple[str, float], float]:
    """Exact linear-interpolated quantiles (Spark ``percentile``, DuckDB ``quantile_cont``) per key.

    ``stats`` may give the known ``{key: (n, min, max)}``."""
    base = (long_df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))
    if stats is None:
        stats = {r["k"]: (r["n"], r["mn"], r["mx"]) for r in
                 base.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect()}
    counts = {k: n for k, (n, _, _) in stats.items() if n}
    plan = defaultdict(list)
    targets = []
    for k, n in counts.items():
        for q in probs:
            h = (n - 1) * q
            lo, hi = int(math.floor(h)), int(math.ceil(h))
            plan[(k, q)] = (lo, hi, h - lo)
            targets += [(k, lo), (k, hi)]
    vals = kth_values(base, targets, stats=stats, **kw)
    out = {}
    for (k, q), (lo, hi, frac) in plan.items():
        a, b = vals.get((k, lo)), vals.get((k, hi))
        out[(k, q)] = None if a is None or b is None else a + frac * (b - a)
    return out


def quantile_frame(spark, qmap: dict, key_name: str, names: dict[float, str], keys=None) -> DataFrame:
    """Turn ``{(key, q): value}`` (bounded by keys x probs) into a small DataFrame."""
    keys = keys if keys is not None else sorted({k for k, _ in qmap})
    rows = [(k, *[qmap.get((k, q)) for q in names]) for k in keys]
    schema = f"{key_name} string, " + ", ".join(f"{n} double" for n in names.values())
    return spark.createDataFrame(rows, schema)
