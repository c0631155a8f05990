"""The ``Frame`` value object and the feature/target rules.

The reference works on an in-memory table whose last column is the target and
all other columns are features.  Here a ``Frame`` carries a lazy DataFrame plus
the column roles; nothing about the rows is held on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSIFICATION = "classification"
REGRESSION = "regression"
# Fixed value: a non-string target with fewer distinct values than this is a class label.
MAX_CLASSES = 10


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    feature_cols: tuple[str, ...]
    target_col: str
    id_cols: tuple[str, ...] = ("row_id",)
    problem_type: str | None = None

    @property
    def p(self) -> int:
        return len(self.feature_cols)

    def with_df(self, df: DataFrame, feature_cols=None) -> "Frame":
        cols = tuple(feature_cols) if feature_cols is not None else self.feature_cols
        return replace(self, df=df, feature_cols=cols)


@dataclass(frozen=True)
class Made:
    """Rows with wide columns that ``make`` adds to the batches of ``base``.

    A reader's own function over batches follows ``make`` in the same task, so that the wide columns go to no JVM and back; ``rows`` gives a
    DataFrame for all other readers."""
    base: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def sparkSession(self):
        return self.base.sparkSession

    def select(self, *names: str) -> "Made":
        made, at = self.make, [self.schema.names.index(n) for n in names]

        def make(batches):
            for batch in made(batches):
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=list(names))

        return Made(self.base, make, T.StructType([self.schema.fields[i] for i in at]))

    def mapInArrow(self, read, schema) -> DataFrame:
        made = self.make
        return self.base.mapInArrow(lambda batches: read(made(batches)), schema)

    def rows(self) -> DataFrame:
        return self.base.mapInArrow(self.make, self.schema)


def split_target(df: DataFrame, target: str | None = None, id_cols=("row_id",)) -> Frame:
    """B1: the last (non-id) column is the target unless one is named."""
    cols = [c for c in df.columns if c not in id_cols]
    target = target or cols[-1]
    feats = tuple(c for c in cols if c != target)
    return Frame(df, feats, target, tuple(c for c in id_cols if c in df.columns))


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    """B2: numeric columns (booleans and datetimes are not numeric)."""
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType) and f.name not in exclude]


def categorical_cols(df: DataFrame, exclude=()) -> list[str]:
    """String columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def problem_type_report(df: DataFrame, target: str) -> DataFrame:
    """B4 as a one-row DataFrame: target, dtype, distinct non-null count, min, max, type."""
    dt = df.schema[target].dataType
    is_string = isinstance(dt, T.StringType)
    agg = df.agg(
        F.count_distinct(F.col(target)).alias("n_distinct"),
        F.min(F.col(target).cast("string") if is_string else F.col(target).cast("double")).alias("min_value"),
        F.max(F.col(target).cast("string") if is_string else F.col(target).cast("double")).alias("max_value"),
    )
    kind = (F.lit(CLASSIFICATION) if is_string else
            F.when(F.col("n_distinct") < MAX_CLASSES, F.lit(CLASSIFICATION)).otherwise(F.lit(REGRESSION)))
    return agg.select(
        F.lit(target).alias("target"),
        F.lit(dt.simpleString()).alias("dtype"),
        "n_distinct",
        F.col("min_value").cast("string").alias("min_value"),
        F.col("max_value").cast("string").alias("max_value"),
        kind.alias("problem_type"),
    )


def detect_problem_type(fr: Frame) -> str:
    """Classification iff the target is a string or has < 10 distinct non-null values."""
    if fr.problem_type:
        return fr.problem_type
    dt = fr.df.schema[fr.target_col].dataType
    if isinstance(dt, T.StringType):
        return CLASSIFICATION
    # count_distinct stops mattering past MAX_CLASSES; a bounded distinct scan is enough.
    n = fr.df.select(fr.target_col).where(F.col(fr.target_col).isNotNull()).distinct().limit(MAX_CLASSES).count()
    return CLASSIFICATION if n < MAX_CLASSES else REGRESSION
