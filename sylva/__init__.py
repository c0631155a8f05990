"""sylva: Spark-native variable importance, muting and model comparison.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a ``pyspark.ml``-style estimator.  Data-dependent column
sets (features, categories, pair plans) are resolved by one small aggregate
job whose result is bounded by the number of features or classes, never by the
number of rows.
"""

from sylva.frame import Frame, detect_problem_type, split_target

__all__ = ["Frame", "detect_problem_type", "split_target"]
__version__ = "0.1.0"
