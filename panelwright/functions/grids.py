"""Parameter grids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def log_grid(low: float, high: float, length: int) -> list[float]:
    """``length`` powers of ten with evenly spaced exponents."""
    step = (high - low) / (length - 1)
    return [10.0 ** (low + step * i) for i in range(length)]


def even_grid(low: float, high: float, length: int) -> list[float]:
    step = (high - low) / (length - 1)
    return [low + step * i for i in range(length)]


def grid_column(values: Iterable) -> Column:
    """The sorted, de-duplicated grid as a literal array, to be exploded per row."""
    return F.array(*[F.lit(v) for v in sorted(set(values))])
