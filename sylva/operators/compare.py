"""Analytics over result tables (leaderboards, repeated errors, variants).

Result tables are small (one row per model / variant / repetition), but every
operator is still a DataFrame plan, so the same code scores a bake-off of
thousands of models, and error tables with billions of repetitions, unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.stats import exact_mean

from sylva.functions.naming import FAMILY_TAG, family, is_family, is_variant, medal

EQUIVALENT_GAP = 0.01  # fixed value: |difference| below this is "equivalent"


def leaderboard(results: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Sorted by the metric, with a 1-based rank."""
    order = F.desc(metric) if higher_is_better else F.asc(metric)
    return results.withColumn("rank", F.row_number().over(Window.orderBy(order, "model")))


def best(results: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """The first row of the leaderboard."""
    return leaderboard(results, metric, higher_is_better).where("rank = 1")


def position_of(results: DataFrame, metric: str, tag: str = FAMILY_TAG,
                higher_is_better: bool = True) -> DataFrame:
    """Rank of the first model whose name contains the tag (last place and a
    score of 0 if none), the number of models, and the conclusion tier."""
    lb = leaderboard(results, metric, higher_is_better)
    agg = lb.agg(F.count(F.lit(1)).alias("n_models"),
                 F.min(F.when(is_family(F.col("model"), tag), F.col("rank"))).alias("pos"))
    hit = lb.select(F.col("rank").alias("pos"), F.col(metric).alias("score"))
    out = agg.join(hit, "pos", "left").select(
        F.coalesce(F.col("pos"), F.col("n_models")).cast("int").alias("position"), "n_models",
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    tier = (F.when(F.col("position") == 1, F.lit("winner")).when(F.col("position") <= 3, F.lit("top3"))
            .otherwise(F.lit("other")))
    return out.withColumn("tier", tier)


def score_stats(results: DataFrame, metric: str) -> DataFrame:
    """Max, min, mean and sample std of the metric over models."""
    return results.agg(F.max(metric).alias("best"), F.min(metric).alias("worst"),
                       F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def improvement(results: DataFrame, metric: str, tag: str = FAMILY_TAG) -> DataFrame:
    """(tagged score - best other) / best other * 100 and the verdict.

    With several tagged models the best one is used."""
    fam = is_family(F.col("model"), tag)
    agg = results.agg(F.max(F.when(fam, F.col(metric))).alias("rlt_score"),
                      F.max(F.when(~fam, F.col(metric))).alias("best_other"))
    gain = (F.col("rlt_score") - F.col("best_other")) / F.nullif(F.col("best_other"), F.lit(0.0)) * 100.0
    verdict = (F.when(F.col("rlt_score") > F.col("best_other"), F.lit("better"))
               .when(F.abs(F.col("rlt_score") - F.col("best_other")) < EQUIVALENT_GAP, F.lit("equivalent"))
               .otherwise(F.lit("worse")))
    return agg.select("rlt_score", "best_other", gain.alias("improvement_pct"), verdict.alias("verdict"))


def relative_errors(errors: DataFrame, error: str = "error") -> DataFrame:
    """Error / smallest error (best = 1.0), ascending rank, medals."""
    w = Window.partitionBy()  # one row per model
    t = errors.withColumn("relative_error", F.col(error) / F.min(error).over(w))
    t = t.withColumn("rank", F.row_number().over(Window.orderBy("relative_error", "model")))
    return t.withColumn("medal", medal(F.col("rank")))


def head_tail(ranked: DataFrame, top: int = 15, bottom: int = 5) -> DataFrame:
    """The top ``top`` and bottom ``bottom`` ranks, true ranks kept."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return ranked.withColumn("_n", n).where((F.col("rank") <= top) | (F.col("rank") > F.col("_n") - bottom)) \
        .drop("_n")


def family_summary(ranked: DataFrame) -> DataFrame:
    """Baselines vs RLT variants: n, best, worst, mean relative error."""
    fam = F.when(is_variant(F.col("model")), F.lit("RLT variants")).otherwise(F.lit("Baseline"))
    return ranked.groupBy(fam.alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.min("relative_error").alias("best"),
        F.max("relative_error").alias("worst"), F.avg("relative_error").alias("mean"))


def best_per_type(results: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Best baseline vs best RLT; accuracy gain % or error reduction %.

    Ties on the metric go to the smaller model name (the leaderboard order)."""
    t = results.withColumn("type", family(F.col("model")))
    key = -F.col(metric) if higher_is_better else F.col(metric)

    def pick(kind):
        order = F.when(F.col("type") == kind, F.struct(key.alias("k"), F.col("model").alias("m")))
        return F.min_by(F.struct(F.col("model").alias("model"), F.col(metric).alias("score")), order)

    agg = t.agg(pick("Baseline").alias("b"), pick("RLT").alias("r")).select(
        F.col("b.model").alias("best_baseline"), F.col("b.score").alias("baseline_score"),
        F.col("r.model").alias("best_rlt"), F.col("r.score").alias("rlt_score"))
    if higher_is_better:
        imp = (F.col("rlt_score") - F.col("baseline_score")) / F.nullif(F.col("baseline_score"), F.lit(0.0))
    else:
        imp = (F.col("baseline_score") - F.col("rlt_score")) / F.nullif(F.col("baseline_score"), F.lit(0.0))
    return agg.withColumn("improvement_pct", imp * 100.0)


def rep_summary(errors: DataFrame) -> DataFrame:
    """Mean and population std of the error per (scenario, p, model)."""
    return errors.groupBy("scenario", "p", "model").agg(
        exact_mean(F.col("error")).alias("mean"), F.stddev_pop("error").alias("std"), F.count(F.lit(1)).alias("n_reps"))


def result_matrix(summary: DataFrame, p_values=None) -> DataFrame:
    """rows = (scenario, model), one column per p of the table (or per given p), cells 'mean (std)' to 3 decimals."""
    if p_values is None:
        p_values = sorted(r.p for r in summary.select("p").distinct().collect())  # as many as the result has columns
    def snap3(c):  # half-up on the value itself, so every engine prints the same digits
        return F.floor(F.col(c) * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)

    cell = F.format_string("%.3f (%.3f)", snap3("mean"), snap3("std"))
    wide = (summary.withColumn("cell", cell).groupBy("scenario", "model")
            .pivot("p", list(p_values)).agg(F.first("cell")))
    return wide.select("scenario", "model", *[F.col(str(p)).alias(f"p_{p}") for p in p_values])


def best_per_scenario(summary: DataFrame, at_p: int | None = 200) -> DataFrame:
    """The model with the smallest mean error per scenario (at one p, or per p)."""
    src = summary if at_p is None else summary.where(F.col("p") == at_p)
    keys = ["scenario"] if at_p is not None else ["scenario", "p"]
    order = F.struct(F.col("mean"), F.col("model"))
    return src.groupBy(*keys).agg(F.min_by("model", order).alias("best_model"),
                                  F.min("mean").alias("best_error"))


def detect_metric(results: DataFrame) -> tuple[str, bool]:
    """The first column naming accuracy, r2 or mse; mse is ranked ascending."""
    for c in results.columns:
        lc = c.lower()
        if "accuracy" in lc or "r2" in lc or "mse" in lc:
            return c, "mse" in lc
    raise ValueError("no metric column")


def top_n_auto(results: DataFrame, n: int = 3) -> DataFrame:
    col, asc = detect_metric(results)
    return leaderboard(results, col, higher_is_better=not asc).where(F.col("rank") <= n)


def time_totals(results: DataFrame, seconds: str = "train_time", by: str = "type") -> DataFrame:
    """Total seconds and minutes per group and overall (rollup)."""
    return results.rollup(by).agg(F.sum(seconds).alias("seconds")).select(
        F.coalesce(F.col(by), F.lit("ALL")).alias(by), "seconds", (F.col("seconds") / 60.0).alias("minutes"))


def parts_completed(*parts: DataFrame) -> DataFrame:
    """Number of parts with at least one result row, out of len(parts)."""
    flags = None
    for i, p in enumerate(parts):
        one = p.limit(1).select(F.lit(i).alias("part"))  # existence check only
        flags = one if flags is None else flags.unionByName(one)
    return flags.agg(F.count_distinct("part").alias("parts_completed")).withColumn(
        "parts_total", F.lit(len(parts)))


def feature_report(muted: DataFrame, plan: DataFrame) -> DataFrame:
    """Original / kept / combined feature counts and the reduction."""
    n_pairs = plan.count()  # a plan has at most top_n*(top_n-1)/2 rows
    m = muted.agg(F.count(F.lit(1)).alias("n_original"), F.sum(F.col("kept").cast("int")).alias("n_kept"))
    return m.select(
        "n_original", F.col("n_kept").cast("bigint").alias("n_kept"), F.lit(n_pairs).cast("bigint").alias("n_pairs"),
        (F.col("n_kept") + F.lit(n_pairs)).cast("bigint").alias("n_final"),
        (F.col("n_kept") / F.col("n_original") * 100.0).alias("pct_kept"),
        ((1 - F.col("n_kept") / F.col("n_original")) * 100.0).alias("pct_reduction"))
