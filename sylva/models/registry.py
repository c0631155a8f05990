"""The model family on MLlib plus the Extra-Trees operator.

Every learner is a ``Learner(name, fit)``; ``fit(train)`` returns a scorer
``score(df) -> DataFrame[row_id, label, prediction(, probability)]``.  Frames
are assembled once into ``x array<double>`` and ``features`` (vector) columns.
``run_models`` fits each learner, scores train and test, and computes all
metrics of the bake-off in one grouped job over the unioned predictions.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from typing import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.frame import CLASSIFICATION, Frame
from sylva.models import bounded, forest, logistic
from sylva.models.boosting import Boosted
from sylva.models.extra_trees import ExtraTrees
from sylva.models.stumps import CUTS, Stump, boost
from sylva.operators.metrics import auc_macro, auc_ovr, classification_metrics, regression_metrics
from sylva.session import saved

# Fixed values of the reference's model settings.
N_TREES = 100
XGB_DEPTH = 6
GB_DEPTH = 3
L1_C = 10.0          # C = 1 / 0.1
L2_C = 1.0
LASSO_ALPHA = 0.1
MAX_ITER = 1000
# The reference grows to purity on raw thresholds; MLlib's own limits are depth 30 and binned features.
MLLIB_MAX_DEPTH = 30
MLLIB_BINS = 128


def mtry(p: int) -> tuple[int, int]:
    """H5: (max(1, floor(sqrt p)), max(1, floor(ln p)))."""
    return max(1, int(math.sqrt(p))), max(1, int(math.log(p))) if p > 0 else 1


def assemble(fr: Frame, label_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, x array<double>, features vector, label double (+ ``keep``), one projection."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in fr.feature_cols])
    lab = F.col(label_col or fr.target_col).cast("double")
    return fr.df.select(F.col(fr.id_cols[0]).alias("row_id"), x.alias("x"), lab.alias("label"), *keep).withColumn(
        "features", array_to_vector("x"))


@dataclass
class Learner:
    name: str
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
    max_depth: int | None = None


def _mllib(estimator, classification: bool):
    def fit(train: DataFrame):
        model = estimator.fit(train)

        def score(df: DataFrame) -> DataFrame:
            out = model.transform(df)
            cols = ["row_id", "label", "prediction"]
            # one-vs-rest models have a raw score per class and no probability: either ranks rows within a class
            given = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
            if classification and given:
                out = out.withColumn("probability", vector_to_array(given))
                cols.append("probability")
            return out.select(*cols)
        return score
    return fit


def _n_classes(train: DataFrame) -> int:
    return int(train.agg(F.max("label")).first()[0]) + 1


def extra_trees(task: str, n_trees: int = N_TREES, mtry_: int | None = None, min_leaf: int = 1,
                max_depth: int | None = None, seed: int = 42, name: str = "ET") -> Learner:
    """H1/H13/H18."""
    def fit(train: DataFrame):
        k = _n_classes(train) if task == CLASSIFICATION else None
        model = ExtraTrees(task, n_trees, mtry_, min_leaf, max_depth, seed, n_classes=k).fit(train)

        def score(df: DataFrame) -> DataFrame:
            out = model.transform(df.select("row_id", "x", "label"))
            cols = ["row_id", "label", "prediction"] + (["probability"] if task == CLASSIFICATION else [])
            return out.select(*cols)
        score.model = model
        return score
    return Learner(name, fit)


def random_forest(task: str, n_trees: int = N_TREES, strategy: str | None = None, p: int | None = None,
                  name: str = "RF", seed: int = 42, max_depth: int = MLLIB_MAX_DEPTH, bins: int = MLLIB_BINS) -> Learner:
    """H2-H4: strategy None (square root for classes, all features for numbers), 'sqrt' or 'log' (natural log counts).

    A table of at most ``bounded.LOCAL_NUMBERS`` numbers gets raw thresholds and trees to purity, grown side by side on executors; a
    larger one ``bins`` bins and depth ``max_depth``: for classes over counted cells (``forest``), else, or where these are too many, MLlib's."""
    if strategy in ("sqrt", "log") and p:
        s, lg = mtry(p)
        tries = s if strategy == "sqrt" else lg
        fss = str(tries)
    else:
        tries = None
        fss = "sqrt" if task == CLASSIFICATION else "all"
    cls = RandomForestClassifier if task == CLASSIFICATION else RandomForestRegressor
    est = cls(numTrees=n_trees, featureSubsetStrategy=fss, maxDepth=max_depth, maxBins=bins, seed=seed, bootstrap=True,
              maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    learner = Learner(name, None)

    def scorer(model):
        def score(df: DataFrame) -> DataFrame:
            out = model.transform(df.select("row_id", "x", "label"))
            return out.select("row_id", "label", "prediction", *(["probability"] if task == CLASSIFICATION else []))
        score.model = model
        return score

    def fit(train: DataFrame):
        if not bounded.fits(train):
            learner.max_depth = max_depth
            model = forest.fit(train, _n_classes(train), n_trees, tries, max_depth, bins, seed) if task == CLASSIFICATION else None
            if model is not None:
                return scorer(model)
            return _mllib(est, task == CLASSIFICATION)(train)
        k = _n_classes(train) if task == CLASSIFICATION else 0
        return scorer(bounded.fit_many(train, [bounded.Plan(name, "rf", n_trees, tries, seed=seed)], task, k, seed=seed).model(0))
    learner.fit = fit
    return learner


def _binary_or_ovr(est, k: int):
    return est if k <= 2 else OneVsRest(classifier=est)


def boosting(task: str, rounds: int = N_TREES, depth: int = XGB_DEPTH, rate: float = 0.1, name: str = "XGBoost",
             seed: int = 42) -> Learner:
    """Gradient-boosted trees; one-vs-rest for more than two classes.

    A table of two classes or numbers of at most ``bounded.LOCAL_NUMBERS`` numbers gets MLlib's; a larger one, or more classes (which MLlib boosts one after
    another, a job a level), the same trees over counted cells (``boosting``)."""
    def fit(train: DataFrame):
        k = _n_classes(train) if task == CLASSIFICATION else 0
        if k > 2 or not bounded.fits(train):
            return Boosted(train, k, rounds, depth, rate).score
        if task == CLASSIFICATION:
            return _mllib(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed), True)(train)
        return _mllib(GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed), False)(train)
    return Learner(name, fit)


def _logistic(train: DataFrame, l1: float, l2: float):
    """Two classes on a larger table than ``bounded`` takes, by Newton steps: the optimum that MLlib's search goes to; scoring is one projection."""
    weights, intercept = logistic.fit(train, l1, l2)

    def score(df: DataFrame) -> DataFrame:
        z = sum((F.lit(float(w)) * F.col("x")[i] for i, w in enumerate(weights)), F.lit(intercept))
        out = df.select("row_id", "label", (z > 0).cast("double").alias("prediction"), (1.0 / (1.0 + F.exp(-z))).alias("_one"))
        return out.select("row_id", "label", "prediction", F.array(1.0 - F.col("_one"), "_one").alias("probability"))
    score.weights, score.intercept = weights, intercept
    return score


def _by_newton(train: DataFrame) -> bool:
    if bounded.fits(train) or _n_classes(train) != 2:
        return False
    return train.agg(F.max(F.size("x"))).first()[0] <= logistic.MAX_FEATURES


def l1_logistic(c: float = L1_C, name: str = "LASSO") -> Learner:
    """H6: L1 logistic, C = 10 -> regParam = 1 / (C n), one-vs-rest as liblinear."""
    def fit(train: DataFrame):
        n = train.count()
        if _by_newton(train):
            return _logistic(train, 1.0 / (c * n), 0.0)
        est = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False,
                                 maxIter=MAX_ITER, family="binomial")
        return _mllib(_binary_or_ovr(est, _n_classes(train)), True)(train)
    return Learner(name, fit)


def l2_logistic(c: float = L2_C, name: str = "Logistic") -> Learner:
    """H8: plain (L2) logistic regression, C = 1."""
    def fit(train: DataFrame):
        n = train.count()
        if _by_newton(train):
            return _logistic(train, 0.0, 1.0 / (c * n))
        est = LogisticRegression(elasticNetParam=0.0, regParam=1.0 / (c * n), standardization=False, maxIter=MAX_ITER)
        return _mllib(est, True)(train)
    return Learner(name, fit)


def lasso(alpha: float = LASSO_ALPHA, name: str = "LASSO") -> Learner:
    """H7: 1/(2n)||y - Xw||^2 + alpha ||w||_1."""
    est = LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=MAX_ITER)
    return Learner(name, _mllib(est, False))


def _says(stump: Stump) -> Column:
    return F.when(F.col("x")[stump.feature] <= F.lit(stump.threshold), F.lit(stump.left)).otherwise(F.lit(stump.right))


def adaboost(rounds: int = N_TREES, rate: float = 0.1, name: str = "AdaBoost", cuts: int = CUTS) -> Learner:
    """SAMME with decision stumps (``stumps``); scoring is one projection, a sum of comparisons per class."""
    def fit(train: DataFrame):
        k = _n_classes(train)
        found = boost(train, k, rounds, rate, cuts)

        def score(df: DataFrame) -> DataFrame:
            votes = [sum((F.when(_says(s) == c, F.lit(s.alpha)).otherwise(F.lit(0.0)) for s in found), F.lit(0.0)) for c in range(k)]
            voted = df.select("row_id", "label", F.array(*votes).alias("probability"))
            best = F.array_position("probability", F.array_max("probability")) - 1
            return voted.select("row_id", "label", best.cast("double").alias("prediction"), "probability")
        score.stumps = found
        return score
    return Learner(name, fit)


def bart_alias(task: str) -> Learner:
    """H12: 'BART' is AdaBoost (classification) or gradient boosting (regression)."""
    if task == CLASSIFICATION:
        return adaboost(rate=1.0, name="BART")
    return boosting(task, depth=GB_DEPTH, rate=0.1, name="BART")


def baseline_registry(task: str, p: int, n_trees: int = N_TREES) -> list[Learner]:
    """The Part 1 bake-off (without the RLT entry)."""
    if task == CLASSIFICATION:
        return [random_forest(task, n_trees, None, p, "Random Forest"),
                random_forest(task, n_trees, "sqrt", p, "RF (mtry=sqrt(p))"),
                random_forest(task, n_trees, "log", p, "RF (mtry=log(p))"),
                extra_trees(task, n_trees, name="Extra Trees"),
                l1_logistic(name="LASSO"),
                boosting(task, n_trees, XGB_DEPTH, 0.1, "XGBoost"),
                adaboost(n_trees, 0.1, "AdaBoost")]
    return [random_forest(task, n_trees, None, p, "Random Forest"),
            random_forest(task, n_trees, "sqrt", p, "RF (mtry=sqrt(p))"),
            random_forest(task, n_trees, "log", p, "RF (mtry=log(p))"),
            extra_trees(task, n_trees, name="Extra Trees"),
            lasso(name="LASSO"),
            boosting(task, n_trees, XGB_DEPTH, 0.1, "XGBoost"),
            boosting(task, n_trees, GB_DEPTH, 0.1, "Gradient Boosting")]


def run_models(train: DataFrame, test: DataFrame, learners: list[Learner], task: str,
               n_features: dict | int | None = None, with_time: bool = True, with_auc: bool = False) -> DataFrame:
    """Fit, score train and test, then one grouped metric job.

    Columns of the leaderboard contract; ``max_depth`` is the depth limit a learner was given (null: none).  ``train_time``
    is the seconds of the fit alone; predictions are written afterwards.  Without ``with_time`` the result depends on data and
    seeds only.  A learner that engineers features reports how many it used.  ``with_auc`` adds one-vs-rest ROC-AUC on the test part."""
    spark = train.sparkSession
    preds, timing, counts = None, [], []
    keep = ["label", "prediction"]  # no metric reads the ids, which would be most of what is written
    for lr in learners:
        t0 = time.time()
        score = lr.fit(train)
        timing.append((lr.name, time.time() - t0))
        given = n_features.get(lr.name) if isinstance(n_features, dict) else n_features
        counts.append((lr.name, len(score.features) if hasattr(score, "features") else given, lr.max_depth))
        scored = [score(df) for df in (train, test)]
        both = None
        for part, out in zip(("train", "test"), scored, strict=True):
            chance = F.col("probability") if with_auc and "probability" in out.columns else F.lit(None).cast("array<double>")
            out = out.select(*keep, chance.alias("probability"), F.lit(part).alias("part"), F.lit(lr.name).alias("model"))
            both = out if both is None else both.unionByName(out)
        both = saved(both, "predictions", compression="zstd")
        preds = both if preds is None else preds.unionByName(both)
    out = board(preds, counts, task, with_auc)
    if not with_time:
        return out
    times = spark.createDataFrame(timing, "model string, train_time double")
    return out.join(times, "model").withColumn("cpu_time", F.col("train_time"))


def board(preds: DataFrame, counts: list[tuple], task: str, with_auc: bool = False) -> DataFrame:
    """The leaderboard of predictions (model, part, label, prediction); counts: (model, features, depth limit) of each model."""
    spark = preds.sparkSession
    feats = spark.createDataFrame([(k, None if v is None else int(v), d) for k, v, d in counts], "model string, features int, max_depth int")
    if task == CLASSIFICATION:
        m = classification_metrics(preds, group=["model", "part"])
        wide = m.groupBy("model").agg(
            F.max(F.when(F.col("part") == "train", F.col("accuracy"))).alias("train_accuracy"),
            F.max(F.when(F.col("part") == "test", F.col("accuracy"))).alias("test_accuracy"),
            F.max(F.when(F.col("part") == "test", F.col("precision"))).alias("precision"),
            F.max(F.when(F.col("part") == "test", F.col("recall"))).alias("recall"),
            F.max(F.when(F.col("part") == "test", F.col("f1_score"))).alias("f1_score"))
        if with_auc:
            long = (preds.where("part = 'test' AND probability IS NOT NULL")
                    .select("model", "label", F.posexplode("probability").alias("cls", "score")).withColumn("cls", F.col("cls").cast("double")))
            wide = wide.join(auc_macro(auc_ovr(long, group=["model"]), ["model"]), "model", "left")
    else:
        m = regression_metrics(preds, group=["model", "part"])
        wide = m.groupBy("model").agg(
            F.max(F.when(F.col("part") == "train", F.col("r2"))).alias("train_r2"),
            F.max(F.when(F.col("part") == "test", F.col("r2"))).alias("test_r2"),
            F.max(F.when(F.col("part") == "test", F.col("rmse"))).alias("rmse"),
            F.max(F.when(F.col("part") == "test", F.col("mae"))).alias("mae"))
    from sylva.functions.naming import family
    return wide.join(feats, "model", "left").withColumn("type", family(F.col("model")))  # a row per model


def run_plans(train: DataFrame, test: DataFrame, plans: list, task: str) -> DataFrame:
    """The leaderboard of ``bounded`` plans: one fitting job, one pass over either part for all of them."""
    fitted = bounded.fit_many(train, plans, task, _n_classes(train) if task == CLASSIFICATION else 0)
    preds = fitted.predictions(train).withColumn("part", F.lit("train")).unionByName(fitted.predictions(test).withColumn("part", F.lit("test")))
    counts = [(p.name, fitted.n_features(i), p.max_depth) for i, p in enumerate(plans)]
    return saved(board(preds, counts, task), "board")
