"""Statistical aggregates that answer NULL instead of failing on degenerate input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import as_column


def correlation(a, b, where: Column | None = None) -> Column:
    """Pearson correlation over the rows where both sides are known (NaN is not).

    NULL for a constant side, a single pair or no pair. ``where`` restricts the
    rows, so that many populations can share one aggregation.
    """
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    usable = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    if where is not None:
        usable = usable & where
    x, y = F.when(usable, a), F.when(usable, b)
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    # Rounding may leave the range by a digit. least and greatest skip NULLs, hence the ladder.
    return F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r)


def mean_squared_error(actual, predicted) -> Column:
    gap = as_column(actual) - as_column(predicted)
    return F.avg(gap * gap)


def mismatch_rate(actual, predicted) -> Column:
    """Share of rows whose label differs from the prediction."""
    return F.avg((as_column(actual) != as_column(predicted)).cast("double"))
