"""Panel (one row per entity and period) to entity table, in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import if_known, strict_max, strict_min, strict_sum


def span_columns(start: str, end: str, length: str) -> dict[str, Column]:
    """Length of a span in periods; a span within one period counts as 1."""
    gap = F.col(end) - F.col(start)
    return {length: if_known(gap == 0, F.lit(1), gap)}


def first_values(values: Sequence[str], time: str, tie: Sequence[str] = ()) -> Column:
    """Struct of the values in the row of the earliest known time.

    ``min_by`` combines on the map side, so a hot entity arrives as one row per
    map task; a window would collect all its rows in one task. Rows without a
    time are never chosen; a group without any known time gives NULL.
    """
    order = F.when(F.col(time).isNotNull(), F.struct(time, *tie))
    return F.min_by(F.struct(*values), order)


def roll_up(
    panel: DataFrame,
    keys: Sequence[str],
    time: str,
    totals: Mapping[str, str],
    first: Sequence[str] = (),
    tie: Sequence[str] = (),
    start: str = "start_year",
    end: str = "end_year",
    length: str = "active_years",
) -> DataFrame:
    """One row per key: time span, strict totals and the attributes of the first row.

    ``totals`` maps output names to panel columns. A single ``groupBy`` does what
    would otherwise be several aggregations joined on their common key.
    """
    aggregates = [strict_min(time).alias(start), strict_max(time).alias(end)]
    aggregates += [strict_sum(source).alias(out) for out, source in totals.items()]
    if first:
        aggregates.append(first_values(first, time, tie).alias("_first"))
    out = panel.groupBy(*keys).agg(*aggregates)
    out = out.withColumns(span_columns(start, end, length))
    ordered = [*keys, start, end, length, *totals]
    return out.select(*ordered, *[F.col(f"_first.{c}").alias(c) for c in first])


def action_flags(
    total: str, unanimous: str, any_flag: str = "action_flag", all_flag: str = "unanimous_flag"
) -> dict[str, Column]:
    """0/1 flags: any action at all; some action and every one unanimous."""
    t, u = F.col(total), F.col(unanimous)
    return {
        any_flag: if_known(t > 0, F.lit(1), F.lit(0)),
        all_flag: if_known((u == t) & (u > 0), F.lit(1), F.lit(0)),
    }
