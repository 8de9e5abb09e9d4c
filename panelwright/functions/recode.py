"""Codes to labels, ordered bands, right-closed bins, keyed corrections."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .nulls import as_column


def recode(value, table: Mapping, default=None) -> Column:
    """Replace codes by labels. Codes outside ``table`` give ``default`` (NULL)."""
    value = as_column(value)
    out = None
    for code, label in table.items():
        test = value == F.lit(code)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def bands(value, ladder: Sequence[tuple[float, str]], default: str) -> Column:
    """First rung whose threshold is reached, from the top down.

    A NULL reaches no rung, so it takes the default label like a low value.
    """
    value = as_column(value)
    out = None
    for threshold, label in sorted(ladder, key=lambda rung: rung[0], reverse=True):
        test = value >= F.lit(threshold)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def below(value, threshold, label: str, default: str) -> Column:
    """``label`` strictly under the threshold, ``default`` otherwise or if NULL."""
    return F.when(as_column(value) < F.lit(threshold), F.lit(label)).otherwise(F.lit(default))


def cut(value, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(b[i], b[i+1]]``; NULL, NaN and outside values give NULL."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    value = as_column(value)
    lowest, highest = breaks[0], breaks[-1]
    out = F.when(F.isnan(value.cast("double")), F.lit(None).cast("string"))
    if not math.isinf(lowest):
        out = out.when(value <= F.lit(lowest), F.lit(None).cast("string"))
    for upper, label in zip(breaks[1:-1], labels[:-1]):
        out = out.when(value <= F.lit(upper), F.lit(label))
    last = value.isNotNull() if math.isinf(highest) else value <= F.lit(highest)
    return out.when(last, F.lit(labels[-1]))


def stars(p_value) -> Column:
    """Significance marks of a p-value."""
    p = as_column(p_value)
    # The customary cut-offs and marks.
    return (
        F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*")
        .when(p <= 0.1, ".").when(p.isNotNull(), " ")
    )


def fill_by_key(value, key, fills: Mapping) -> Column:
    """Give a missing value the entry of its key; known values stay."""
    return F.coalesce(as_column(value), recode(key, fills))


def overwrite_by_key(value, key, values: Mapping) -> Column:
    """Replace the value for the listed keys, whether known or not."""
    value, key = as_column(value), as_column(key)
    out = None
    for k, v in values.items():
        test = key == F.lit(k)
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out.otherwise(value)


def level_index(column, levels) -> Column:
    """Zero-based place of a value in an ordered list of levels; NULL for others."""
    return recode(column, {level: i for i, level in enumerate(levels)}).cast("long")
