"""Name rules of the reference's result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family tags and names used by the reference's result tables.
FAMILY_TAG = "RLT"
VARIANT_PREFIX = "RLT-"
NAIVE_NAME = "RLT-naive"
BASELINE = "Baseline"
MEDALS = ("gold", "silver", "bronze")


def is_family(name: Column, tag: str = FAMILY_TAG) -> Column:
    """Model name contains the tag."""
    return name.contains(tag)


def family(name: Column) -> Column:
    """B14: 'RLT' if the name contains RLT, else 'Baseline'."""
    return F.when(is_family(name), F.lit(FAMILY_TAG)).otherwise(F.lit(BASELINE))


def is_variant(name: Column) -> Column:
    """Name starts with 'RLT-' and is not 'RLT-naive'."""
    return name.startswith(VARIANT_PREFIX) & (name != F.lit(NAIVE_NAME))


def variant_name(level: Column, n_comb: Column, nmin_label: Column | None = None) -> Column:
    """S1: 'RLT-<Lev>-LC<n>[-<nmin>]' with the first three letters of the level, capitalised."""
    parts = [F.lit(VARIANT_PREFIX), F.initcap(F.substring(level, 1, 3)), F.lit("-LC"), n_comb.cast("string")]
    if nmin_label is not None:
        parts += [F.lit("-"), nmin_label]
    return F.concat(*parts)


def long_variant_name(level: Column, n_comb: Column) -> Column:
    """S1, long form: 'RLT-<Level>-LC<n>' with the whole level, capitalised."""
    return F.concat(F.lit(VARIANT_PREFIX), F.initcap(level), F.lit("-LC"), n_comb.cast("string"))


def medal(rank: Column) -> Column:
    """Gold / silver / bronze for ranks 1-3."""
    return (F.when(rank == 1, F.lit(MEDALS[0])).when(rank == 2, F.lit(MEDALS[1]))
            .when(rank == 3, F.lit(MEDALS[2])))
