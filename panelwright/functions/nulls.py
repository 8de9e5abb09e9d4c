"""Aggregates and conditionals in which a missing value is never silently lost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(value) -> Column:
    """A name or a Column, as a Column."""
    return F.col(value) if isinstance(value, str) else value


def _if_no_null(value: Column, aggregate: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def strict_sum(value) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    value = as_column(value)
    return _if_no_null(value, F.sum(value))


def strict_min(value) -> Column:
    """Minimum that is NULL as soon as one input is NULL."""
    value = as_column(value)
    return _if_no_null(value, F.min(value))


def strict_max(value) -> Column:
    """Maximum that is NULL as soon as one input is NULL."""
    value = as_column(value)
    return _if_no_null(value, F.max(value))


def tally_sum(weight) -> Column:
    """Sum that skips NULLs and gives 0 where every input is NULL."""
    return F.coalesce(F.sum(as_column(weight)), F.lit(0))


def if_known(condition: Column, then, otherwise) -> Column:
    """Two-way choice that is NULL where the condition is NULL."""
    return F.when(condition, then).when(~condition, otherwise)


def replace_where(value, condition: Column, replacement) -> Column:
    """Overwrite where the condition holds; an unknown condition leaves the value."""
    return F.when(condition, replacement).otherwise(as_column(value))


def zero_to_null(value) -> Column:
    value = as_column(value)
    return F.when(value != 0, value)


def nan_to_null(value) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def divide(numerator, denominator) -> Column:
    """Division that gives NULL, not an error, for a zero denominator."""
    return F.try_divide(as_column(numerator), as_column(denominator))
