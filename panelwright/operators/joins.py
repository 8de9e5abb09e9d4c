"""Joins whose keys may be NULL, complements and folded full joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(renamed, condition, "left").drop(*[f"_{k}" for k in keys])


def complement(whole: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the whole whose key is not in the sample."""
    return whole.join(sample.select(*keys), on=list(keys), how="left_anti")


def full_join_all(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables on one key, NULL keys matching."""

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed(key, "_key")
        joined = left.join(other, F.col(key).eqNullSafe(F.col("_key")), "full")
        return joined.withColumn(key, F.coalesce(key, "_key")).drop("_key")

    return reduce(both, frames)


def overwrite_from(
    df: DataFrame, corrections: DataFrame, keys: Sequence[str], columns: Mapping[str, str], only_missing: bool = False
) -> DataFrame:
    """Correct columns from a table of corrections, unique by key.

    ``columns`` maps a column to its correction. A NULL correction changes
    nothing. With ``only_missing`` known values stay. The join is left to
    Spark, which broadcasts the corrections only if their size allows.
    """
    joined = left_join_null_safe(df, corrections.select(*keys, *columns.values()), keys)

    def corrected(column: str, correction: str):
        pair = (column, correction) if only_missing else (correction, column)
        return F.coalesce(*pair)

    return joined.withColumns({c: corrected(c, v) for c, v in columns.items()}).drop(*columns.values())
