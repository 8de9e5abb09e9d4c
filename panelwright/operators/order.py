"""Row numbers, ranks and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

# monotonically_increasing_id() puts the partition number above this bit.
_ROW_BITS = 33


def add_row_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Number all rows 1..n in the order of the given unique key.

    One range shuffle sorts the rows across partitions. The sorted rows are
    written with their partition number and position, so the numbering cannot
    change if a task is run again; what remains is to add to each position the
    sizes of the earlier partitions. There is no window over the whole table.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "rows",
    )
    part = F.shiftright(F.col("_place"), _ROW_BITS)
    position = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    )  # one row per partition
    offset, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], offset))
        offset += row["_n"]
    starts = spark.createDataFrame(offsets, "_part long, _start long")
    # The broadcast side has one row per shuffle partition, whatever the data size.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + position + 1)
        .select(*df.columns, name)
    )


def rank_small(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of a report table. The window runs in one task: only for
    tables whose size is bound by the number of methods or levels."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def sorted_nulls_last(df: DataFrame, column: str, tie: Sequence[str], descending: bool = True) -> DataFrame:
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *[F.col(c).asc_nulls_last() for c in tie])


def top_k(df: DataFrame, column: str, k: int, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """The ``k`` first rows. Each task keeps k rows, so nothing is fully sorted."""
    return sorted_nulls_last(df, column, tie, descending).limit(k)
