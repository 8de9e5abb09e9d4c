"""Long, wide, stacked and nested forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stack_tables(*frames: DataFrame) -> DataFrame:
    """Append by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def widen(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, aggregate: Column) -> DataFrame:
    """Long to wide with the given column values (no extra pass to find them)."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(aggregate)


def lengthen(df: DataFrame, keys: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long over every column that is not a key."""
    return df.unpivot(list(keys), [c for c in df.columns if c not in set(keys)], name, value)


def count_split(df: DataFrame, condition: Column, no: str, yes: str) -> DataFrame:
    """How many rows fail and meet a condition, side by side; unknown counts apart."""
    return df.agg(
        F.count(F.when(~condition, 1)).alias(no),
        F.count(F.when(condition, 1)).alias(yes),
        F.count(F.when(condition.isNull(), 1)).alias("unknown"),
    )


def nest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rows") -> DataFrame:
    """One row per key with its rows as a list of structs, sorted by ``order``, then by the other columns.

    A key's rows end up in one cell, so this is for groups that fit a row: the
    periods of an entity, not the entities of a region.
    """
    rest = [c for c in df.columns if c not in set(keys) and c not in set(order)]
    cell = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(*keys).agg(cell.alias(name))


def unnest_rows(df: DataFrame, keys: Sequence[str], name: str = "rows", position: str | None = None) -> DataFrame:
    """The rows of the lists again, with their one-based ``position`` if that is named."""
    if position is None:
        return df.select(*keys, F.inline(name))
    placed = df.select(*keys, F.posexplode(name).alias("_at", "_row"))
    return placed.select(*keys, (F.col("_at") + 1).cast("long").alias(position), "_row.*")


def unnest_parallel(df: DataFrame, keys: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row per position of several equally long list columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in lists])
    return df.select(*keys, F.inline(zipped))


def cross_grid(df: DataFrame, grid: Column, name: str) -> DataFrame:
    """Every row with every grid value: a literal array exploded, not a join."""
    return df.withColumn(name, F.explode(grid))
