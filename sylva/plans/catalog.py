"""Registered queries: one per operator of the inventory, each reading the given tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``sylva.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.frame import problem_type_report
from sylva.functions.naming import variant_name
from sylva.operators import combine, compare, importance, metrics, muting, prepare, profile
from sylva.plans.common import board, emb_vi, line_multi_vi, model_errors, rounded
from sylva.sources import fixtures as fx
from sylva.sources import sinks, tables
from sylva.sources.tables import load

# --------------------------------------------------------------- A: scans


def scan_shape(spark, sf):
    return tables.shape(fx.line_reg(spark, sf))


def scan_preview(spark, sf):
    return rounded(tables.preview(fx.line_reg(spark, sf), 5))


def scan_column_info(spark, sf):
    return tables.column_info(fx.line_multi(spark, sf))


def results_name(spark, sf):
    src = load(spark, sf, "documents").select("source").distinct()
    return src.select("source", sinks.results_name(F.concat(F.col("source"), F.lit(".csv"))).alias("file"))


def detect_type(spark, sf):
    li = load(spark, sf, "lineitem")
    emb = load(spark, sf, "embeddings")
    parts = [problem_type_report(li, "l_returnflag"), problem_type_report(li, "l_linenumber"),
             problem_type_report(li, "l_quantity"), problem_type_report(emb, "label")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------- C: profile


def profile_describe(spark, sf):
    fr = fx.line_reg(spark, sf)
    return rounded(profile.describe(fr.df, list(fr.feature_cols) + [fr.target_col]))


def profile_target(spark, sf):
    return rounded(profile.target_summary(fx.line_reg(spark, sf)))


def target_distribution(spark, sf):
    return rounded(profile.target_distribution(fx.line_multi(spark, sf).df, "l_returnflag"))


def profile_missing(spark, sf):
    return rounded(profile.missing_report(fx.line_null(spark, sf).df))


def profile_missing_orders(spark, sf):
    return rounded(profile.missing_report(fx.order_null(spark, sf).df))


def profile_duplicates(spark, sf):
    return rounded(profile.duplicate_report(fx.line_dup(spark, sf)))


def profile_corr(spark, sf):
    fr = fx.line_reg(spark, sf)
    return rounded(profile.correlation_matrix(fr.df, list(fr.feature_cols) + [fr.target_col]))


def profile_target_corr(spark, sf):
    return rounded(profile.target_correlation(fx.line_reg(spark, sf), 10))


def profile_hist(spark, sf):
    return rounded(profile.histogram(fx.line_reg(spark, sf).df, "revenue", 30))


def profile_box(spark, sf):
    return rounded(profile.box_stats(fx.line_reg(spark, sf).df, "revenue"))


# --------------------------------------------------------------- D: preparation


def prep_dedupe(spark, sf):
    """D1 on all of B-7: the distinct rows, each with how many were removed for it."""
    from sylva.frame import Frame
    df = fx.line_dup(spark, sf)
    fr = Frame(df, tuple(df.columns[:-1]), df.columns[-1], (), None)
    return rounded(prepare.drop_duplicates(fr).df.join(prepare.duplicate_counts(fr), df.columns))


def prep_dedupe_ids(spark, sf):
    """D1 with ids: of rows that are equal but for the key, the smallest key stays."""
    from sylva.frame import Frame
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return prepare.drop_duplicates(Frame(df, ("o_custkey",), "o_orderstatus", ("o_orderkey",), None)).df


def prep_impute_num(spark, sf):
    return rounded(prepare.impute_numeric(fx.line_null(spark, sf)).df)


def prep_impute_cat(spark, sf):
    return rounded(prepare.impute_categorical(fx.order_null(spark, sf)).df)


def prep_onehot(spark, sf):
    return rounded(prepare.one_hot(fx.order_cat(spark, sf)).df)


def prep_label(spark, sf):
    fr, _ = prepare.encode_label(fx.line_multi(spark, sf))
    return rounded(fr.df)


def prep_label_wide(spark, sf):
    """D5 for a label of very many classes: all parts' names, numbered in sorted order."""
    codes = prepare.dictionary(load(spark, sf, "part"), "p_name")
    return load(spark, sf, "part").select("p_partkey", "p_name").join(codes, F.col("p_name") == F.col("value")).select("p_partkey", "p_name", F.col("code").alias("label"))


def prep_onehot_wide(spark, sf):
    """D4 for a column of very many categories: the customers of all orders as sparse vectors, first category dropped."""
    from sylva.frame import Frame
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    hot = prepare.one_hot_sparse(Frame(df, ("o_custkey",), "o_orderkey", ("o_orderkey",), None), "o_custkey")
    return hot.select("o_orderkey", F.col("one_hot.size").alias("size"), F.get("one_hot.indices", F.lit(0)).alias("hot_index"), F.size("one_hot.values").cast("long").alias("n_hot"))


def prep_scale(spark, sf):
    return rounded(prepare.standardize(fx.line_reg(spark, sf)).df)


def prep_split(spark, sf):
    return prepare.split(fx.line_reg(spark, sf), 0.2, 42).select("row_id", "is_test")


def prep_stratified(spark, sf):
    return prepare.split(fx.line_multi(spark, sf), 0.2, 42, stratify=True).select(
        "row_id", "l_returnflag", "is_test")


def prep_sample_anti(spark, sf):
    return prepare.sample_split(fx.line_reg(spark, sf), 150, 0.7, 42).select("row_id", "is_train")


def prep_noise(spark, sf):
    """D11 over every lineitem row: per added column, its source, count, mean and std."""
    fr = fx.line_reg(spark, sf)
    m = prepare.noise_moments(fr.with_df(_spread(fr.df)), 500, 0.5, 42)
    return rounded(m.select(F.format_string("nz%04d", F.col("j")).alias("feature"), "n", "mean", "std",
                            prepare.noise_source_col(F.col("j"), fr.p, 42).alias("src")))


# --------------------------------------------------------------- E: importance


def vi_anova(spark, sf):
    return rounded(importance.anova_f(fx.emb_long(spark, sf)))


def vi_anova_line(spark, sf):
    fr = fx.line_multi(spark, sf)
    numeric = fr.with_df(fr.df, [c for c in fr.feature_cols if c != "l_linestatus"])
    return rounded(importance.anova_f(importance.long_frame(numeric)))


def vi_pearson(spark, sf):
    return rounded(importance.abs_pearson(fx.line_reg(spark, sf)))


def vi_blend(spark, sf):
    return rounded(emb_vi(spark, sf))


def vi_stats(spark, sf):
    return rounded(importance.vi_stats(emb_vi(spark, sf)))


def vi_top(spark, sf):
    return rounded(importance.top_features(emb_vi(spark, sf), 15))


# --------------------------------------------------------------- M: muting


def mute_levels(spark, sf):
    vi = emb_vi(spark, sf)
    out = None
    for level in muting.LEVELS:
        m = muting.mute(vi, level).select("feature", F.lit(level).alias("level"), "kept", "threshold")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


def mute_floor(spark, sf):
    return rounded(muting.mute(line_multi_vi(spark, sf), "moderate").select(
        "feature", "rank", "vi", "kept", "threshold"))


def mute_nofloor(spark, sf):
    return rounded(muting.mute(emb_vi(spark, sf), "moderate", min_features=0, fallback_all=True).select(
        "feature", "kept", "threshold"))


def mute_report(spark, sf):
    return rounded(muting.mute_report(muting.mute(emb_vi(spark, sf), "moderate")))


def mute_schedule(spark, sf):
    return rounded(muting.muting_schedule(emb_vi(spark, sf)))


# --------------------------------------------------------------- G: combinations


def _emb_muted(spark, sf):
    return muting.mute(emb_vi(spark, sf), "moderate")


def pairs_banded(spark, sf):
    return rounded(combine.pair_plan_banded(_emb_muted(spark, sf)))


def pairs_capped(spark, sf):
    muted = _emb_muted(spark, sf)
    n_kept = muted.where("kept").count()
    return rounded(combine.pair_plan_banded(muted, order="asc", cap=1 * n_kept))


def pairs_positional(spark, sf):
    return rounded(combine.pair_plan_banded(_emb_muted(spark, sf), order="asc", positional=True))


def pairs_all(spark, sf):
    return rounded(combine.pair_plan_all(_emb_muted(spark, sf)))


def lc_columns(spark, sf):
    muted = _emb_muted(spark, sf)
    plan = combine.pair_plan_banded(muted)
    fr = combine.add_combinations(fx.emb_wide(spark, sf), plan, muting.kept_features(muted))
    names = [c for c in fr.feature_cols if c.startswith("LC_")]
    long = fr.df.select("row_id", *names).unpivot(["row_id"], names, "name", "value")
    return rounded(long)


# --------------------------------------------------------------- I: metrics


def metrics_clf(spark, sf):
    return rounded(metrics.classification_metrics(fx.pred_pairs(spark, sf)))


def _auc_scores(spark, sf):
    from sylva.functions.hashing import uniform
    pp = fx.pred_pairs(spark, sf)
    cls = F.explode(F.array(*[F.lit(float(k)) for k in range(3)])).alias("cls")
    return pp.select("row_id", "label", cls).withColumn(
        "score", uniform(F.col("row_id"), F.lit("auc"), F.col("cls").cast("int")))


def metrics_auc(spark, sf):
    from sylva.session import saved
    per = saved(metrics.auc_ovr(_auc_scores(spark, sf)), "auc")  # a row per class, read twice
    macro = metrics.auc_macro(per).select(F.lit(-1.0).alias("cls"), F.col("roc_auc").alias("auc"))
    return rounded(per.unionByName(macro))


def metrics_reg(spark, sf):
    fr = fx.line_reg(spark, sf)
    pred = fr.df.select(F.col("revenue").alias("label"), (F.col("l_extendedprice") * 0.95).alias("prediction"))
    return rounded(metrics.regression_metrics(pred))


def metrics_grouped(spark, sf):
    li = fx.line_base(spark, sf)
    pred = li.select("l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"),
                     (F.col("l_extendedprice") * 0.95).alias("prediction"))
    return rounded(metrics.regression_metrics(pred, group=["l_linestatus"]))


# --------------------------------------------------------------- J: result tables


def _board(spark, sf):
    return board(fx.event_errors(spark, sf))


def board_rank(spark, sf):
    return rounded(compare.leaderboard(_board(spark, sf), "test_accuracy"))


def board_best(spark, sf):
    return rounded(compare.best(_board(spark, sf), "test_accuracy"))


def board_position(spark, sf):
    return rounded(compare.position_of(_board(spark, sf), "test_accuracy"))


def board_stats(spark, sf):
    return rounded(compare.score_stats(_board(spark, sf), "test_accuracy"))


def board_improvement(spark, sf):
    return rounded(compare.improvement(_board(spark, sf), "test_accuracy"))


def _ranked(spark, sf):
    return compare.relative_errors(model_errors(fx.event_errors(spark, sf)))


def rel_error(spark, sf):
    return rounded(_ranked(spark, sf))


def rel_head_tail(spark, sf):
    return rounded(compare.head_tail(_ranked(spark, sf), 3, 2))


def top5_relative(spark, sf):
    return rounded(compare.head_tail(_ranked(spark, sf), 5, 0))


def family_summary(spark, sf):
    return rounded(compare.family_summary(_ranked(spark, sf)))


def best_per_type(spark, sf):
    return rounded(compare.best_per_type(_board(spark, sf), "test_accuracy", True))


def best_per_type_error(spark, sf):
    return rounded(compare.best_per_type(model_errors(fx.event_errors(spark, sf)), "error", False))


def rep_summary(spark, sf):
    return rounded(compare.rep_summary(fx.event_errors(spark, sf)))


def rep_matrix(spark, sf):
    from sylva.session import saved
    return compare.result_matrix(saved(compare.rep_summary(fx.event_errors(spark, sf)), "summary"))  # a row per cell, read for its columns too


def best_per_scenario(spark, sf):
    return rounded(compare.best_per_scenario(compare.rep_summary(fx.event_errors(spark, sf)), 200))


def best_per_scenario_p(spark, sf):
    return rounded(compare.best_per_scenario(compare.rep_summary(fx.event_errors(spark, sf)), None))


def top3_auto(spark, sf):
    b = _board(spark, sf).select("model", "type", "features", "train_accuracy", "test_accuracy", "train_time")
    return rounded(compare.top_n_auto(b, 3))


def time_totals(spark, sf):
    return rounded(compare.time_totals(_board(spark, sf)))


def parts_completed(spark, sf):
    errors = fx.event_errors(spark, sf)
    return compare.parts_completed(_board(spark, sf), compare.rep_summary(errors), _ranked(spark, sf))


def feature_report(spark, sf):
    muted = _emb_muted(spark, sf)
    return rounded(compare.feature_report(muted, combine.pair_plan_banded(muted)))


def flagship(spark, sf):
    """Section 7.1 slice: embeddings -> long form -> ANOVA F -> normalised VI -> adaptive muting."""
    return rounded(muting.mute(emb_vi(spark, sf), "moderate").select(
        "feature", "idx", "vi", "rank", "kept", "threshold"))


def variant_grid(spark, sf):
    """The muting x n_comb x nmin grid, resolved against the embeddings data.

    Each variant's feature count is resolved from the data (kept features per
    level + capped pairs), and variants with the same resolved plan share a key.
    """
    from sylva.plans.studies import resolved_grid
    return rounded(resolved_grid(spark, fx.emb_wide(spark, sf)))


QUERIES = {
    "scan_shape": scan_shape, "scan_preview": scan_preview, "scan_column_info": scan_column_info,
    "results_name": results_name, "detect_type": detect_type,
    "profile_describe": profile_describe, "profile_target": profile_target,
    "target_distribution": target_distribution, "profile_missing": profile_missing,
    "profile_missing_orders": profile_missing_orders, "profile_duplicates": profile_duplicates,
    "profile_corr": profile_corr, "profile_target_corr": profile_target_corr, "profile_hist": profile_hist,
    "profile_box": profile_box,
    "prep_dedupe": prep_dedupe, "prep_impute_num": prep_impute_num, "prep_impute_cat": prep_impute_cat,
    "prep_onehot": prep_onehot, "prep_label": prep_label, "prep_scale": prep_scale, "prep_split": prep_split,
    "prep_stratified": prep_stratified, "prep_sample_anti": prep_sample_anti, "prep_noise": prep_noise,
    "vi_anova": vi_anova, "vi_anova_line": vi_anova_line, "vi_pearson": vi_pearson, "vi_blend": vi_blend,
    "vi_stats": vi_stats, "vi_top": vi_top,
    "mute_levels": mute_levels, "mute_floor": mute_floor, "mute_nofloor": mute_nofloor,
    "mute_report": mute_report, "mute_schedule": mute_schedule,
    "pairs_banded": pairs_banded, "pairs_capped": pairs_capped, "pairs_positional": pairs_positional,
    "pairs_all": pairs_all, "lc_columns": lc_columns,
    "metrics_clf": metrics_clf, "metrics_auc": metrics_auc, "metrics_reg": metrics_reg,
    "metrics_grouped": metrics_grouped,
    "board_rank": board_rank, "board_best": board_best, "board_position": board_position,
    "board_stats": board_stats, "board_improvement": board_improvement, "rel_error": rel_error,
    "rel_head_tail": rel_head_tail, "top5_relative": top5_relative, "family_summary": family_summary,
    "best_per_type": best_per_type, "best_per_type_error": best_per_type_error,
    "rep_summary": rep_summary, "rep_matrix": rep_matrix, "best_per_scenario": best_per_scenario,
    "best_per_scenario_p": best_per_scenario_p, "top3_auto": top3_auto, "time_totals": time_totals,
    "parts_completed": parts_completed, "feature_report": feature_report, "variant_grid": variant_grid,
    "flagship": flagship,
}


# --------------------------------------------------------------- H: models (rows-only checks)
# Each query fits on the whole fixture: Part 1 protocol (standardise, 80/20 hash
# split) on lineitem, or Part 3 protocol (noise expansion to p = 500, a
# 150-row training sample and every other row as test).


def _spread(df, key="row_id"):
    """Rows dealt by hash over as many partitions as the cluster runs tasks, whatever files they came in."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


def _assembled_split(fr, test=0.2, seed=42, stratify=False):
    from sylva.models.registry import assemble
    from sylva.session import saved
    fr = prepare.standardize(fr)
    flagged = prepare.split(fr, test, seed, stratify=stratify)
    narrow = assemble(fr.with_df(flagged), keep=("is_test",)).drop("features")
    data = saved(_spread(narrow), "split", compression="zstd")  # read by every fit and score of the query; ids are digests, of which others save nothing
    from pyspark.ml.functions import array_to_vector
    from sylva.models.bounded import fits
    if fits(data):  # few numbers are read back as few partitions; a larger table as at least one a core, and is not shuffled by every reader
        data = _spread(data)
    data = data.withColumn("features", array_to_vector("x"))
    return data.where(~F.col("is_test")).drop("is_test"), data.where(F.col("is_test")).drop("is_test")


def _part3(spark, sf, target_p=500, n_train=150, seed=42):
    """150 training rows, all others as test; the noise is a hash, so each reader makes it anew, in its own tasks, and no wide table is kept."""
    from dataclasses import replace

    from pyspark.ml.functions import array_to_vector
    from sylva.models.bounded import SCORED_ROWS
    from sylva.session import saved
    fr = prepare.standardize(fx.line_reg(spark, sf))
    flagged = saved(_spread(prepare.sample_split(fr, n_train, 0.7, seed)), "part3")

    def wide(rows):
        named = rows.select("row_id", *fr.feature_cols, F.col(fr.target_col).cast("double").alias("label"))
        return prepare.noise_rows(replace(fr, df=named, target_col="label"), target_p, 0.5, seed, chunk=SCORED_ROWS)

    names = list(fr.feature_cols) + [prepare.noise_name(j) for j in range(fr.p, target_p)]
    train = saved(wide(flagged.where("is_train")).rows().select("row_id", "x", "label"), "part3-train")
    return train.withColumn("features", array_to_vector("x")), wide(_spread(flagged.where(~F.col("is_train")))), names


def _fit_one(spark, sf, learner_fn, task="classification"):
    from sylva.models.registry import run_models
    fr = fx.line_bin(spark, sf) if task == "classification" else fx.line_reg(spark, sf)
    tr, te = _assembled_split(fr)
    return run_models(tr, te, [learner_fn(task, fr.p)], task, fr.p, with_time=False)


def model_et(spark, sf):
    from sylva.models.registry import extra_trees
    return _fit_one(spark, sf, lambda t, p: extra_trees(t, name="Extra Trees"))


def model_rf(spark, sf):
    from sylva.models.registry import random_forest
    return _fit_one(spark, sf, lambda t, p: random_forest(t, strategy=None, p=p, name="Random Forest"))


def model_rf_sqrt(spark, sf):
    from sylva.models.registry import random_forest
    return _fit_one(spark, sf, lambda t, p: random_forest(t, strategy="sqrt", p=p, name="RF (mtry=sqrt(p))"))


def model_rf_log(spark, sf):
    from sylva.models.registry import random_forest
    return _fit_one(spark, sf, lambda t, p: random_forest(t, strategy="log", p=p, name="RF (mtry=log(p))"))


def model_l1_logistic(spark, sf):
    from sylva.models.registry import l1_logistic
    return _fit_one(spark, sf, lambda t, p: l1_logistic(name="LASSO"))


def model_logistic(spark, sf):
    from sylva.models.registry import l2_logistic
    return _fit_one(spark, sf, lambda t, p: l2_logistic(name="Lasso/Linear"))


def model_lasso(spark, sf):
    from sylva.models.registry import lasso
    return _fit_one(spark, sf, lambda t, p: lasso(name="LASSO"), task="regression")


def model_xgb(spark, sf):
    from sylva.models.registry import boosting
    return _fit_one(spark, sf, lambda t, p: boosting(t, 100, 6, 0.1, "XGBoost"))


def model_gb(spark, sf):
    from sylva.models.registry import boosting
    return _fit_one(spark, sf, lambda t, p: boosting(t, 100, 3, 0.1, "Gradient Boosting"), task="regression")


def model_adaboost(spark, sf):
    from sylva.models.registry import adaboost
    return _fit_one(spark, sf, lambda t, p: adaboost(100, 0.1, "AdaBoost"))


def model_bart(spark, sf):
    from sylva.models.registry import bart_alias
    return _fit_one(spark, sf, lambda t, p: bart_alias(t))


def model_nmin(spark, sf):
    """H13 on the Part 3 protocol: Extra-Trees with min leaf 2 and floor(n^(1/3)); one pass over the wide test rows scores both."""
    from sylva.models.bounded import Plan
    from sylva.models.registry import run_plans
    tr, te, _ = _part3(spark, sf)
    n = tr.count()
    cube = max(2, int(n ** (1.0 / 3.0)))
    return run_plans(tr, te, [Plan("ET-nmin=2", "et", min_leaf=2), Plan(f"ET-nmin=n^1/3={cube}", "et", min_leaf=cube)], "regression")


def model_mtry(spark, sf):
    """H5 for every number of features that the tables give: entries of embeddings, one-hot columns of priorities, sources and languages."""
    counts = [load(spark, sf, "embeddings").select(F.size("embedding").alias("p")).distinct()]
    for table, column in (("orders", "o_orderpriority"), ("documents", "source"), ("documents", "lang"), ("part", "p_brand")):
        counts.append(load(spark, sf, table).agg(F.count_distinct(column).cast("int").alias("p")))
    ps = counts[0]
    for c in counts[1:]:
        ps = ps.unionByName(c)
    ps = ps.distinct()
    return ps.select(F.col("p").cast("int").alias("p"),
                     F.greatest(F.lit(1), F.floor(F.sqrt("p"))).cast("int").alias("mtry_sqrt"),
                     F.greatest(F.lit(1), F.floor(F.log("p"))).cast("int").alias("mtry_log"))


def model_bart_reg(spark, sf):
    """H12 for regression: gradient boosting under the name BART."""
    from sylva.models.registry import bart_alias
    return _fit_one(spark, sf, lambda t, p: bart_alias(t), task="regression")


def model_et_level1(spark, sf):
    """H1, first split: ten trees of depth 1 on all rows of B-2, every feature a candidate."""
    from sylva.models.registry import assemble
    from sylva.models.extra_trees import ExtraTrees
    fr = fx.line_bin(spark, sf)
    model = ExtraTrees("classification", n_trees=10, mtry=fr.p, max_depth=1, seed=42, local_rows=100, n_classes=2).fit(assemble(fr).select("x", "label"))  # deals the rows itself
    name = F.get(F.array(*[F.lit(c) for c in fr.feature_cols]), F.col("feature"))
    return rounded(model.splits.select("tree", name.alias("feature"), "threshold", "gain", F.col("n_left").cast("long").alias("n_left"),
                                       F.col("n_right").cast("long").alias("n_right")))


def _study_sample(fr, label=None):
    """The training rows of Part 3 (at most 150, by hash) as a model table."""
    from sylva.models.registry import assemble
    flagged = prepare.sample_split(fr, 150, 0.7, 42)
    rows = assemble(fr.with_df(flagged.where("is_train").drop("is_train")))
    return rows if label is None else rows.withColumn("label", label)


def model_rf_level1(spark, sf):
    """H2, first split: 100 trees of depth 1 on Part 3's training rows of B-2 (bootstrap weights, every threshold of every feature)."""
    from sylva.models.bounded import Plan, fit_many
    fr = fx.line_bin(spark, sf)
    fitted = fit_many(_study_sample(fr), [Plan("RF", "rf", mtry=fr.p, max_depth=1)], "classification", 2)
    name = F.get(F.array(*[F.lit(c) for c in fr.feature_cols]), F.col("feat")[0])
    return rounded(fitted.table.where(F.col("feat")[0] >= 0).select("tree", name.alias("feature"), F.col("thr")[0].alias("threshold"), F.get("imp", F.col("feat")[0]).alias("gain")))


def model_ada_rounds(spark, sf):
    """H11, first three rounds on all rows of B-2 (two classes) and B-3 (three): stump, weighted error and vote."""
    from sylva.models.registry import assemble
    from sylva.models.stumps import boost
    two = fx.line_bin(spark, sf)
    three, _ = prepare.encode_label(fx.line_multi(spark, sf))
    three = three.with_df(three.df, fx.LINE_FEATURES)
    rows = [(k, i + 1, fx.LINE_FEATURES[s.feature], s.threshold, s.left, s.right, s.error, s.alpha)
            for fr, k in ((two, 2), (three, 3)) for i, s in enumerate(boost(_spread(assemble(fr)).select("row_id", "x", "label"), k, 3, 0.1))]  # three stumps each
    return rounded(spark.createDataFrame(rows, "classes int, round int, feature string, threshold double, left_class int, right_class int, error double, alpha double"))


def model_boost_level1(spark, sf):
    """H9/H10, first round: the first stump of either boosting on Part 3's training rows of B-1 (revenue in 100 000), with its leaf values."""
    from sylva.models.bounded import Plan, fit_many
    fr = fx.line_reg(spark, sf)
    plans = [Plan("XGBoost", "boost", 1, max_depth=1, rate=0.3, l2=1.0), Plan("Gradient Boosting", "boost", 1, max_depth=1, rate=0.1)]
    fitted = fit_many(_study_sample(fr, F.col("label") / 100000.0), plans, "regression")
    name = F.get(F.array(*[F.lit(c) for c in fr.feature_cols]), F.col("feat")[0])
    model = F.get(F.array(*[F.lit(p.name) for p in plans]), F.col("model"))
    return rounded(fitted.table.select(model.alias("model"), name.alias("feature"), F.col("thr")[0].alias("threshold"), F.get("imp", F.col("feat")[0]).alias("gain"),
                                       F.col("value")[1].alias("left_leaf"), F.col("value")[2].alias("right_leaf")))


def rlt_flagship(spark, sf):
    """RLT-ExtraTrees (VI -> mute -> LC -> ET) next to plain Extra-Trees (RLT-naive)."""
    from sylva.models.registry import extra_trees, run_models
    from sylva.models.rlt import rlt
    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    return run_models(tr, te, [rlt("classification", list(fr.feature_cols)),
                               extra_trees("classification", name="RLT-naive")], "classification", {"RLT-naive": fr.p}, with_time=False)


def rlt_saved(spark, sf):
    """H14 kept and loaded again: test rows, and how many of them the loaded model scores differently."""
    from sylva.models.rlt import RLTModel, rlt
    from sylva.session import ensure_checkpoint_dir
    import uuid
    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    path = f"{ensure_checkpoint_dir(spark)}/sylva-rlt-{uuid.uuid4().hex}"
    model = rlt("classification", list(fr.feature_cols)).fit(tr).model
    model.save(path)
    rows = te.select("row_id", "x")
    both = model.transform(rows).select("row_id", "probability").join(RLTModel.load(spark, path).transform(rows).select("row_id", F.col("probability").alias("again")), "row_id", "full")
    return both.agg(F.count("*").alias("n_rows"), F.count(F.when(~F.col("probability").eqNullSafe(F.col("again")), 1)).alias("n_different"))


STUDY_P = 500


def study_baselines(task, p):
    """The eight baselines of the Part 3 study."""
    from sylva.models.registry import bart_alias, boosting, extra_trees, l1_logistic, lasso, random_forest
    linear = l1_logistic(name="Lasso") if task == "classification" else lasso(name="Lasso")
    return [random_forest(task, p=p, name="RF"), random_forest(task, strategy="sqrt", p=p, name="RF- √p"),
            random_forest(task, strategy="log", p=p, name="RF-log(p)"), extra_trees(task, name="ET"), bart_alias(task), linear,
            boosting(task, 100, 6, 0.3, "Boosting"), extra_trees(task, name="RLT-naive")]


def study_baseline_plans(min_leaf=1):
    """The same eight as plans for one bounded training table, for numbers: boosting of second order (leaf penalty 1) under its name."""
    from sylva.models.bounded import Plan
    from sylva.models.registry import GB_DEPTH, LASSO_ALPHA, XGB_DEPTH, mtry
    root, log = mtry(STUDY_P)
    return [Plan("RF", "rf"), Plan("RF- √p", "rf", mtry=root), Plan("RF-log(p)", "rf", mtry=log), Plan("ET", "et"),
            Plan("BART", "boost", max_depth=GB_DEPTH, rate=0.1), Plan("Lasso", "lasso", alpha=LASSO_ALPHA),
            Plan("Boosting", "boost", max_depth=XGB_DEPTH, rate=0.3, l2=1.0), Plan("RLT-naive", "et")]


def rlt_grid(spark, sf):
    """H15/J8 on the Part 3 protocol: 8 baselines and 30 variants (3 muting levels x 5 n_comb x 2 nmin) in one table of
    relative errors.  The training rows go to the tasks once, every distinct plan's trees are grown side by side, and one pass over the wide
    test rows scores all of them."""
    from sylva.models.registry import run_plans
    from sylva.models.rlt import frame_of, importance, rlt_plans
    from sylva.plans.studies import resolved_grid
    from sylva.session import saved
    tr, te, names = _part3(spark, sf)
    vi = saved(importance(tr, names, "regression"), "importance")
    grid = resolved_grid(spark, frame_of(tr, names, "regression"), vi, n_train=tr.count()).collect()  # 30 rows
    fits = {}
    for g in grid:
        fits.setdefault(g["fit_key"], (g["fit_key"], g["level"], g["n_comb"], g["nmin"]))
    plain = study_baseline_plans()
    res = run_plans(tr, te, plain + rlt_plans(vi, names, fits.values()), "regression")
    errors = res.select(F.col("model").alias("fit_key"), (F.col("rmse") * F.col("rmse")).alias("error"), "features")
    gdf = spark.createDataFrame([(g["model"], g["fit_key"]) for g in grid] + [(p.name, p.name) for p in plain], "model string, fit_key string")
    ranked = compare.relative_errors(gdf.join(errors.drop("features"), "fit_key").drop("fit_key"))
    return ranked.join(gdf.join(errors.select("fit_key", "features"), "fit_key").drop("fit_key"), "model")


def study_plan(spark, sf):
    """The 38 models of the Part 3 study with their smallest leaf, for the number of rows there are."""
    from sylva.plans.studies import LEVELS, N_COMBS, N_TRAIN_MAX, TRAIN_FRAC, study_nmin
    n = load(spark, sf, "lineitem").agg(F.least(F.lit(N_TRAIN_MAX), F.floor(F.lit(TRAIN_FRAC) * F.count("*"))).alias("n_train"))
    cube = study_nmin(F.col("n_train"))
    nmin = F.explode(F.array(F.struct(F.lit("nmin=2").alias("label"), F.lit(2).alias("nmin")),
                             F.struct(F.concat(F.lit("nmin=n^1/3="), cube.cast("string")).alias("label"), cube.alias("nmin"))))
    grid = n.select("n_train", F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level"))
    grid = grid.select("n_train", "level", F.explode(F.array(*[F.lit(c) for c in N_COMBS])).alias("n_comb"))
    grid = grid.select("n_train", "level", "n_comb", nmin.alias("m")).select(
        variant_name(F.col("level"), F.col("n_comb"), F.col("m.label")).alias("model"), F.col("m.nmin").alias("nmin"), "n_train")
    plain = n.select(F.explode(F.array(*[F.lit(lr.name) for lr in study_baselines("regression", 500)])).alias("model"), F.lit(1).alias("nmin"), "n_train")
    return grid.unionByName(plain).select("model", F.col("nmin").cast("int").alias("nmin"), F.col("n_train").cast("long").alias("n_train"))


def variant_grid_3x3(spark, sf):
    """The muting x n_comb grid with long names, resolved against the embeddings data."""
    from sylva.plans.studies import short_grid
    return short_grid(spark, fx.emb_wide(spark, sf))


def _bakeoff(fr, out_dir, name):
    """Part 1 from a frame with raw columns to the leaderboard in a results file, which is read back."""
    from sylva.models.registry import assemble, baseline_registry, run_models
    from sylva.models.rlt import rlt
    from sylva.session import saved
    spark = fr.df.sparkSession
    fr = prepare.drop_duplicates(fr)
    fr = prepare.impute_categorical(prepare.impute_numeric(fr))
    fr, _ = prepare.encode_label(prepare.one_hot(fr))
    fr = prepare.standardize(fr)
    flagged = prepare.split(fr, 0.2, 42, stratify=True)
    from pyspark.ml.functions import array_to_vector
    from sylva.models.bounded import fits
    data = saved(_spread(assemble(fr.with_df(flagged), keep=("is_test",)).drop("features")), "bakeoff")
    data = (_spread(data) if fits(data) else data).withColumn("features", array_to_vector("x"))
    tr, te = data.where(~F.col("is_test")).drop("is_test"), data.where("is_test").drop("is_test")
    task = "classification"
    learners = baseline_registry(task, fr.p) + [rlt(task, list(fr.feature_cols))]
    res = run_models(tr, te, learners, task, {lr.name: fr.p for lr in learners}, with_time=False)
    board_ = compare.leaderboard(res.select("model", "type", "features", "train_accuracy", "test_accuracy", "precision", "recall", "f1_score"), "test_accuracy")
    return tables.read_results(spark, sinks.write_results(board_, out_dir, name))


def part1_bakeoff(spark, sf):
    """The Part 1 run: a CSV of mixed columns (B-10) -> A1, D1-D6, D8, VI, muting, combinations, 8 models, ranks -> A5, read back."""
    from sylva.session import ensure_checkpoint_dir
    import uuid
    out = f"{ensure_checkpoint_dir(spark)}/sylva-part1-{uuid.uuid4().hex}"
    fx.doc_quality(spark, sf).df.withColumn("quality", F.concat(F.lit("q"), F.col("quality").cast("string"))).write.option("header", True).csv(f"{out}/input.csv")
    fr = tables.read_table(spark, f"{out}/input.csv")
    return _bakeoff(fr, out, "doc_quality.csv")


def embedded_study(spark, sf):
    from sylva.models.rlt import embedded_study as study
    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    return study(tr, te, list(fr.feature_cols), "classification", with_time=False)


def embedded_study_multi(spark, sf):
    """H16 for three classes: one-vs-rest where a learner is binary, ROC-AUC per class against the rest."""
    from sylva.models.rlt import embedded_study as study
    fr = fx.line_multi(spark, sf)
    fr, _ = prepare.encode_label(fr.with_df(fr.df, [c for c in fr.feature_cols if c != "l_linestatus"]))
    tr, te = _assembled_split(fr, stratify=True)
    return study(tr, te, list(fr.feature_cols), "classification", with_time=False)


def optimised_study(spark, sf):
    from sylva.models.rlt import embedded_study as study
    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    return study(tr, te, list(fr.feature_cols), "classification", optimised=True, with_time=False)


def vi_model(spark, sf):
    """Extra-Trees importance blended 50/50 with the ANOVA statistic."""
    from sylva.models.rlt import importance
    fr = fx.line_bin(spark, sf)
    tr, _ = _assembled_split(fr)
    return importance(tr, list(fr.feature_cols), "classification")


def vi_model_only(spark, sf):
    """Normalised forest importance only."""
    from sylva.models.rlt import importance
    fr = fx.line_reg(spark, sf)
    tr, _ = _assembled_split(fr)
    return importance(tr, list(fr.feature_cols), "regression", w_model=1.0, w_stat=0.0)


def progressive(spark, sf):
    from sylva.models.rlt import progressive_muting
    fr = fx.line_bin(spark, sf)
    tr, te = _assembled_split(fr)
    return progressive_muting(tr, te, list(fr.feature_cols), "classification", with_time=False)


QUERIES.update({
    "model_et": model_et, "model_rf": model_rf, "model_rf_sqrt": model_rf_sqrt, "model_rf_log": model_rf_log,
    "model_l1_logistic": model_l1_logistic, "model_logistic": model_logistic, "model_lasso": model_lasso,
    "model_xgb": model_xgb, "model_gb": model_gb, "model_adaboost": model_adaboost, "model_bart": model_bart,
    "model_nmin": model_nmin, "model_mtry": model_mtry, "rlt_flagship": rlt_flagship, "rlt_grid": rlt_grid,
    "embedded_study": embedded_study, "optimised_study": optimised_study, "vi_model": vi_model,
    "vi_model_only": vi_model_only, "progressive": progressive,
    "model_bart_reg": model_bart_reg, "model_et_level1": model_et_level1, "study_plan": study_plan,
    "variant_grid_3x3": variant_grid_3x3, "part1_bakeoff": part1_bakeoff, "embedded_study_multi": embedded_study_multi,
    "prep_dedupe_ids": prep_dedupe_ids, "model_rf_level1": model_rf_level1, "model_boost_level1": model_boost_level1, "rlt_saved": rlt_saved, "prep_label_wide": prep_label_wide, "prep_onehot_wide": prep_onehot_wide, "model_ada_rounds": model_ada_rounds,
})
