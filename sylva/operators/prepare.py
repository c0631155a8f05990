"""Cleaning, encoding, scaling, reproducible splits and noise expansion.

Every random choice is a hash of (row key, seed), so splits are identical on
any cluster layout and can be reproduced by a SQL oracle.  Data-dependent
column sets (categories, labels) are resolved with one bounded collect.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.frame import Frame, Made, categorical_cols, numeric_cols
from sylva.functions.hashing import hash_key, hash_u32
from sylva.functions.stats import exact_quantiles, kth_values, to_long
from sylva.session import saved

def drop_duplicates(fr: Frame) -> Frame:
    """Remove repeated full rows (ids excluded from the comparison); of equal rows the smallest id stays."""
    cols = [c for c in fr.df.columns if c not in fr.id_cols]
    if not [c for c in fr.id_cols if c in fr.df.columns]:
        return fr.with_df(fr.df.dropDuplicates(cols))
    least = F.min(F.struct(*fr.id_cols)).alias("_id")
    kept = fr.df.groupBy(*cols).agg(least)
    return fr.with_df(kept.select(*[F.col(f"_id.{c}").alias(c) if c in fr.id_cols else F.col(c) for c in fr.df.columns]))


def duplicate_counts(fr: Frame, name: str = "removed") -> DataFrame:
    """D1's account: every row that stays (ids left out), with how many equal ones ``drop_duplicates`` removes."""
    cols = [c for c in fr.df.columns if c not in fr.id_cols]
    return fr.df.groupBy(*cols).agg((F.count(F.lit(1)) - 1).alias(name))


def impute_numeric(fr: Frame, cols: list[str] | None = None) -> Frame:
    """Fill numeric nulls with the column's exact median (target included)."""
    cols = list(cols or numeric_cols(fr.df, exclude=fr.id_cols))
    if not cols:
        return fr
    med = exact_quantiles(to_long(fr.df, [], cols), "feature", "value", [0.5])
    fill = {c: med[(c, 0.5)] for c in cols if med.get((c, 0.5)) is not None}
    exprs = [F.coalesce(F.col(c), F.lit(fill[c]).cast(fr.df.schema[c].dataType)).alias(c)
             if c in fill else F.col(c) for c in fr.df.columns]
    return fr.with_df(fr.df.select(*exprs))


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per string column; the smallest value on ties.

    Long (column, value) counts are combined map-side; ``min_by`` over
    (-count, value) keeps one row of state per column, so a hot value or a
    high-cardinality column never lands in one unbounded group.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").count()
    order = F.struct((-F.col("count")).alias("neg_count"), F.col("value").alias("value"))
    return counts.groupBy("column").agg(F.min_by("value", order).alias("mode"))


def impute_categorical(fr: Frame, cols: list[str] | None = None) -> Frame:
    """D3: fill string nulls with the column's mode."""
    cols = list(cols or categorical_cols(fr.df, exclude=fr.id_cols))
    if not cols:
        return fr
    fill = {r["column"]: r["mode"] for r in modes(fr.df, cols).collect()}  # one row per column
    exprs = [F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
             for c in fr.df.columns]
    return fr.with_df(fr.df.select(*exprs))


def categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, collected once: as many as the one-hot result has columns."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull()).distinct()
    rows = long.collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(fr: Frame, cols: list[str] | None = None) -> Frame:
    """``get_dummies(drop_first=True)``: sorted categories, first dropped,
    ``<col>_<cat>`` columns (double) appended after the other features."""
    cols = [c for c in (cols or categorical_cols(fr.df)) if c in fr.feature_cols]
    if not cols:
        return fr
    cats = categories(fr.df, cols)
    keep = [c for c in fr.feature_cols if c not in cols]
    dummies, names = [], []
    for c in cols:
        for v in cats[c][1:]:
            name = f"{c}_{v}"
            dummies.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(name))
            names.append(name)
    df = fr.df.select(*fr.id_cols, *keep, *dummies, fr.target_col)
    return Frame(df, tuple(keep + names), fr.target_col, fr.id_cols, fr.problem_type)


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the different values of a column, not null, numbered from 0 in sorted order, however many they are.

    Values are sorted by ranges; a value's code is its place in its partition and the sizes of the partitions before (a row each), so
    no task sees them all and nothing passes through the driver."""
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    placed = saved(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("_at", F.monotonically_increasing_id()), "dictionary")
    placed = placed.select("value", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth"))
    sizes = placed.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    return placed.join(sizes.select("_part", before.alias("_before")), "_part").select("value", (F.col("_before") + F.col("_nth")).alias("code"))


def one_hot_vector(fr: Frame, col: str, out: str = "one_hot") -> DataFrame:
    """D4 for a column of very many categories: one sparse vector column for the learners instead of a column per category.

    Position i is the (i + 1)-th of the sorted categories, counted from the last; the first category and null are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    sparse = one_hot_sparse(fr, col, "_sparse")
    # the encoder drops its last index: the one of the first category and of null
    indexed = sparse.withColumn("_index", F.coalesce(F.col("_sparse.size") - 1 - F.get("_sparse.indices", F.lit(0)), F.col("_sparse.size")).cast("double")).drop("_sparse")
    return OneHotEncoder(inputCol="_index", outputCol=out, dropLast=True).fit(indexed).transform(indexed).drop("_index")


def one_hot_sparse(fr: Frame, col: str, out: str = "one_hot") -> DataFrame:
    """D4 in plain columns: ``out`` is a struct of size, indices and values; index i is the (i + 2)-th of the sorted categories, the first one and null
    have none."""
    codes = dictionary(fr.df, col)
    size = codes.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("_size"))  # one row
    hot = F.col("_code") > 0
    none = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    sparse = F.struct(F.col("_size").alias("size"), F.when(hot, F.array(F.col("_code") - 1)).otherwise(none[0]).alias("indices"), F.when(hot, F.array(F.lit(1.0))).otherwise(none[1]).alias("values"))
    coded = fr.df.join(codes.withColumnsRenamed({"value": "_value", "code": "_code"}), F.col(col) == F.col("_value"), "left")
    return coded.join(F.broadcast(size)).select(*fr.df.columns, sparse.alias(out))


def encode_label(fr: Frame, label_col: str = "label") -> tuple[Frame, DataFrame | None]:
    """String target -> 0..K-1 in sorted order; numeric targets unchanged (as double).

    The classes are a table (class, label) with a row per class, joined to the rows."""
    dt = fr.df.schema[fr.target_col].dataType
    if not isinstance(dt, T.StringType):
        df = fr.df.select(*fr.id_cols, *fr.feature_cols, F.col(fr.target_col).cast("double").alias(label_col))
        return Frame(df, fr.feature_cols, label_col, fr.id_cols, fr.problem_type), None
    classes = dictionary(fr.df, fr.target_col).select(F.col("value").alias("class"), F.col("code").cast("double").alias("label"))
    df = (fr.df.join(classes.withColumnsRenamed({"class": "_class", "label": "_label"}), F.col(fr.target_col) == F.col("_class"), "left")
          .select(*fr.id_cols, *fr.feature_cols, F.col("_label").alias(label_col)))
    return Frame(df, fr.feature_cols, label_col, fr.id_cols, fr.problem_type), classes


def scaling_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s else 1.0)
    return out


def standardize(fr: Frame, fit_on: DataFrame | None = None) -> Frame:
    """(x - mean) / population std; a zero-variance column is divided by 1.

    As in the reference the statistics are fitted on all rows before the split
    unless ``fit_on`` (e.g. the training part) is given.
    """
    cols = list(fr.feature_cols)
    st = scaling_stats(fit_on if fit_on is not None else fr.df, cols)
    exprs = [((F.col(c).cast("double") - F.lit(st[c][0])) / F.lit(st[c][1])).alias(c)
             if c in st else F.col(c) for c in fr.df.columns]
    return fr.with_df(fr.df.select(*exprs))


# ------------------------------------------------------------------ splits
def split_hash(id_cols, seed) -> Column:
    """52-bit hash key of the row (exact as a double)."""
    return F.conv(F.substring(hash_key(*id_cols, F.lit(seed)), 1, 13), 16, 10).cast("bigint")


HASH_TOP = float(2 ** 52)


def smallest_k_flag(df: DataFrame, h: str, id_col: str, k_by_group: dict, group: str | None = None,
                    flag: str = "is_test", counts: dict | None = None) -> DataFrame:
    """Flag the k smallest rows of each group by hash, without a global sort; exactly k, also where ids repeat.

    The k-th smallest hash per group comes from the distributed order-statistic
    search over the known hash range; rows below it are flagged by a
    projection.  Rows that share that exact hash (equal ids) are told apart by a hash of all their columns, found by the same
    search; rows that are equal altogether are numbered by counted ranges, a count per partition, so none of this joins
    rows by an id or gathers equal rows in one task.
    """
    gcol = F.col(group).cast("string") if group else F.lit("*")
    base = df.select(gcol.alias("k"), F.col(h).cast("double").alias("v"))
    targets = [(str(g), int(k) - 1) for g, k in k_by_group.items() if k > 0]
    known = {str(g): (n, 0.0, HASH_TOP) for g, n in counts.items()} if counts else None
    # hashes are uniform: the k-th of n lies within some deviations of its expected place
    likely = {}
    for g, r in targets if counts else ():
        n = max(1, counts[g])
        q = (r + 1) / n
        wide = 5.0 * math.sqrt(q * (1 - q) / n) + 2.0 / n
        likely[(g, r)] = (max(0.0, q - wide) * HASH_TOP, min(1.0, q + wide) * HASH_TOP)
    tie_info: dict = {}
    kth = kth_values(base, targets, stats=known, ties=tie_info, guess=likely)
    spark = df.sparkSession
    thr = {g: (kth[(g, r)], r + 1) for g, r in targets if kth.get((g, r)) is not None}
    if not thr:
        return df.withColumn(flag, F.lit(False))
    th = spark.createDataFrame([(g, float(t), int(need)) for g, (t, need) in thr.items()],
                               "_k string, _t double, _need long")   # one row per group
    tagged = df.withColumn("_k", gcol).join(F.broadcast(th), "_k", "left")
    # all rows equal to the threshold are taken unless that would exceed k
    partial = {g for g, r in targets if (g, r) in tie_info and tie_info[(g, r)][0] + tie_info[(g, r)][1] > r + 1}
    below = F.coalesce(F.col(h) < F.col("_t"), F.lit(False))
    at = F.coalesce(F.col(h) == F.col("_t"), F.lit(False))
    if not partial:
        return tagged.select(*df.columns, (below | at).alias(flag))
    cut = F.coalesce(at & F.col("_k").isin(list(partial)), F.lit(False))
    rest = tagged.where(~cut).select(*df.columns, (below | at).alias(flag))
    need = {g: r + 1 - tie_info[(g, r)][0] for g, r in targets if g in partial}
    own = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 12).cast("double")
    tied = saved(tagged.where(cut).select(*df.columns, "_k", own.alias("_own")), "tied")
    return rest.unionByName(_flag_tied(tied, need, df.columns, flag))


def _flag_tied(tied: DataFrame, need: dict, columns: list[str], flag: str) -> DataFrame:
    """Flags ``need`` rows of each group ``_k``: by the hash ``_own`` of all columns, equal rows by number."""
    spark = tied.sparkSession
    info: dict = {}
    kth = kth_values(tied.select(F.col("_k").alias("k"), F.col("_own").alias("v")), [(g, n - 1) for g, n in need.items()], ties=info)
    left = {g: n - info[(g, n - 1)][0] for g, n in need.items()}  # of the rows at the threshold
    th = spark.createDataFrame([(g, float(kth[(g, n - 1)]), int(left[g])) for g, n in need.items()], "_k string, _t double, _left long")
    placed = tied.join(F.broadcast(th), "_k")  # a row per group
    apart = placed.where(F.col("_own") != F.col("_t")).select(*columns, (F.col("_own") < F.col("_t")).alias(flag))
    place = F.monotonically_increasing_id()
    same = saved(placed.where(F.col("_own") == F.col("_t")).withColumn("_at", place).withColumn("_part", F.shiftright("_at", 33)), "equal-rows")
    counts = same.groupBy("_k", "_part").count()  # a row per group and partition
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = same.join(counts.select("_k", "_part", before.alias("_before")), ["_k", "_part"])
    nth = F.row_number().over(Window.partitionBy("_k", "_part").orderBy("_at"))  # no more rows than a partition had
    return apart.unionByName(numbered.withColumn("_nth", F.col("_before") + nth).select(*columns, (F.col("_nth") <= F.col("_left")).alias(flag)))


def split(fr: Frame, test: float = 0.2, seed: int = 42, stratify: bool = False) -> DataFrame:
    """Flag ``is_test``; test = ceil(test*n) rows with the smallest hash,
    or round(test*n_c) per class when stratified.  Stratification falls back to
    the plain split when a class has fewer than two rows."""
    id_col = fr.id_cols[0]
    df = fr.df.withColumn("_h", split_hash([id_col], seed))
    if stratify:
        groups = df.groupBy(F.col(fr.target_col).cast("string").alias("g")).count()
        if groups.where("count < 2").limit(1).count() == 0 and groups.limit(1).count():
            counts = {r[0]: r[1] for r in groups.collect()}  # classes of two rows or more; a stratified target is a class
            k = {g: int(math.floor(test * n + 0.5)) for g, n in counts.items()}
            return smallest_k_flag(df, "_h", id_col, k, group=fr.target_col, counts=counts).drop("_h")
    n = df.count()
    return smallest_k_flag(df, "_h", id_col, {"*": int(math.ceil(test * n))}, counts={"*": n}).drop("_h")


def sample_split(fr: Frame, n_max: int = 150, frac: float = 0.7, seed: int = 42) -> DataFrame:
    """n_train = min(n_max, floor(frac*n)) rows drawn without replacement; the rest is test."""
    id_col = fr.id_cols[0]
    n = fr.df.count()
    n_train = min(n_max, int(math.floor(frac * n)))
    df = fr.df.withColumn("_h", split_hash([id_col], seed))
    flagged = smallest_k_flag(df, "_h", id_col, {"*": n_train}, flag="is_train", counts={"*": n})
    return flagged.drop("_h")


# ------------------------------------------------------------------ noise
def noise_source_col(j: Column, p: int, seed: int = 42) -> Column:
    """Source feature of added column j: md5('seed|j') mod p (same rule in SQL)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), j.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(p)).cast("int")


def noise_sources(p: int, target_p: int, seed: int = 42) -> list[int]:
    return [int(hashlib.md5(f"{seed}|{j}".encode()).hexdigest()[:8], 16) % p for j in range(p, target_p)]


def noise_name(j: int) -> str:
    return f"nz{j:04d}"


def _np_mix32(x):
    import numpy as np
    from sylva.functions.hashing import MASK32, MIX_MUL
    x = (((x >> np.uint64(16)) ^ x) * np.uint64(MIX_MUL)) & np.uint64(MASK32)
    x = (((x >> np.uint64(16)) ^ x) * np.uint64(MIX_MUL)) & np.uint64(MASK32)
    return (x >> np.uint64(16)) ^ x


def _np_cos_turn(u):
    """cos(2 pi u) for u in [0, 1], to 1e-15: the sine series of a quarter turn, a third of the time of NumPy's cosine."""
    import numpy as np
    a = np.abs(u - 0.5)
    a -= 0.25
    a *= 2.0 * math.pi  # cos(2 pi u) = sin(2 pi (|u - 1/2| - 1/4))
    z = a * a
    out = np.full_like(z, -1.0 / math.factorial(23))
    for k in range(21, 0, -2):
        out *= z
        out += (1.0 if k % 4 == 1 else -1.0) / math.factorial(k)
    out *= a
    return out


def _np_gaussians(rk, js):
    """Rows x columns standard normals, the NumPy twin of ``hashing.sql_stream_gaussian``."""
    import numpy as np
    from sylva.functions.hashing import MASK32, MIX_MUL, STRIDE, TWO_32
    key = (rk.astype(np.uint64) & np.uint64(MASK32)).astype(np.uint32)[:, None]

    def u(c):
        x = key + (c.astype(np.uint64) * np.uint64(STRIDE)).astype(np.uint32)[None, :]  # 32-bit numbers wrap by themselves
        for _ in range(2):
            x ^= x >> np.uint32(16)
            x *= np.uint32(MIX_MUL)
        x ^= x >> np.uint32(16)
        out = x.astype(np.float64)
        out += 0.5
        out /= TWO_32
        return out

    u1, u2 = u(js * 2), u(js * 2 + 1)
    np.log(u1, out=u1)
    u1 *= -2.0
    np.sqrt(u1, out=u1)
    u1 *= _np_cos_turn(u2)
    return u1


def noise_moments(fr: Frame, target_p: int = 500, weight: float = 0.5, seed: int = 42, chunk: int = 128) -> DataFrame:
    """(j, n, mean, std) of the columns that ``expand_with_noise`` adds, without the columns: each task keeps count, mean and
    squared deviations per column, and the tasks' numbers are merged."""
    import numpy as np
    p = fr.p
    js = np.arange(p, target_p, dtype=np.int64)
    src = np.array(noise_sources(p, target_p, seed), dtype=np.int64)
    feats = list(fr.feature_cols)
    base = fr.df.select(*[F.col(c).cast("double").alias(c) for c in feats], hash_u32(F.col(fr.id_cols[0]), F.lit(seed)).alias("_rk"))

    def fn(batches):
        import pyarrow as pa
        n, mean, m2 = 0, np.zeros(len(js)), np.zeros(len(js))
        for batch in batches:
            for s0 in range(0, batch.num_rows, chunk):
                part = batch.slice(s0, chunk)
                x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in feats]).astype(np.float64)
                v = _np_gaussians(part.column("_rk").to_numpy(zero_copy_only=False), js)
                v *= 1.0 - weight
                v += (weight * x)[:, src]
                k, m = len(v), v.mean(axis=0)
                d = m - mean
                v -= m
                m2 += np.einsum("ij,ij->j", v, v) + d * d * (n * k / (n + k))
                mean += d * (k / (n + k))
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(js.astype(np.int32)), pa.array(np.full(len(js), n, dtype=np.int64)), pa.array(mean), pa.array(m2)], names=["j", "n", "m", "m2"])

    parts = base.mapInArrow(fn, "j int, n long, m double, m2 double")  # a row per task and column
    w = Window.partitionBy("j")
    parts = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    dev = F.sum(F.col("m2") + F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    return parts.groupBy("j", "mean").agg(F.sum("n").alias("n"), dev.alias("d")).select("j", "n", "mean", F.sqrt(F.col("d") / F.col("n")).alias("std"))


def expand_with_noise(fr: Frame, target_p: int = 500, weight: float = 0.5, seed: int = 42,
                      as_array: str | None = None, chunk: int = 2048) -> Frame:
    """Append features until p = target_p; column j (p <= j < target_p) is
    weight * x[src(j)] + (1 - weight) * N(0, 1).

    The row key is one md5 of (row id, seed) in Spark; the draws per column are
    integer mixing of that key, vectorised in NumPy inside ``mapInArrow``
    (rows x new columns per Arrow batch, in chunks), so nothing is shuffled and
    the result is the same on any cluster layout.  With ``as_array`` the
    features come back as one ``array<double>`` column of that name (what the
    model fits consume); otherwise as wide ``nzNNNN`` columns."""
    p = fr.p
    if p >= target_p:
        return fr
    out_col = as_array or "_x"
    arr = noise_rows(fr, target_p, weight, seed, out_col, chunk).rows()
    names = tuple(noise_name(j) for j in range(p, target_p))
    if as_array:
        return Frame(arr, fr.feature_cols, fr.target_col, fr.id_cols, fr.problem_type)
    df = arr.select(*fr.id_cols, *fr.feature_cols, *[F.col(out_col)[j].alias(n) for j, n in zip(range(p, target_p), names)],
                    fr.target_col)
    return Frame(df, fr.feature_cols + names, fr.target_col, fr.id_cols, fr.problem_type)


def noise_rows(fr: Frame, target_p: int = 500, weight: float = 0.5, seed: int = 42, out_col: str = "x", chunk: int = 2048,
               block: int = 128) -> Made:
    """The rows of ``expand_with_noise`` with all features in ``out_col``, for readers that take them where they are made.

    Of ``chunk`` rows a batch, ``block`` are drawn at once, so that the draws stay in cache."""
    import numpy as np
    p = fr.p
    js = np.arange(p, target_p, dtype=np.int64)
    src = np.array(noise_sources(p, target_p, seed), dtype=np.int64)
    feats = list(fr.feature_cols)
    base = fr.df.select(*fr.id_cols, *[F.col(c).cast("double").alias(c) for c in feats], fr.target_col,
                        hash_u32(F.col(fr.id_cols[0]), F.lit(seed)).alias("_rk"))
    keep = [f for f in base.schema.fields if f.name != "_rk"]
    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.DoubleType(), False))])

    def fn(batches):
        import pyarrow as pa
        for batch in batches:
            for s0 in range(0, batch.num_rows, chunk):
                part = batch.slice(s0, chunk)
                n = part.num_rows
                x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in feats]).astype(
                    np.float64).reshape(n, len(feats))
                rk = part.column("_rk").to_numpy(zero_copy_only=False)
                full = np.empty((n, p + len(js)))
                full[:, :p] = x
                for b in range(0, n, block):
                    g = _np_gaussians(rk[b : b + block], js)
                    g *= 1.0 - weight
                    g += weight * x[b : b + block, src]
                    full[b : b + block, p:] = g
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * full.shape[1])
                arr = pa.ListArray.from_arrays(offsets, pa.array(full.ravel()))
                cols = [part.column(f.name) for f in keep] + [arr]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in keep] + [out_col])

    return Made(base, fn, schema)
