"""Reproducible draws: a hash of (seed, purpose, id), the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .nulls import as_column

HASH_HEX = 12
HASH_BITS = 4 * HASH_HEX
DEFAULT_SEED = 27182


def draw(row_id, purpose, seed: int = DEFAULT_SEED) -> Column:
    """A 48-bit integer per row. ``purpose`` separates independent draws; it may
    be a column, for many draws in one pass."""
    tag = F.lit(purpose) if isinstance(purpose, str) else purpose
    text = F.concat_ws(":", F.lit(str(seed)), tag.cast("string"), as_column(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX), 16, 10).cast("long")


def uniform(row_id, purpose, seed: int = DEFAULT_SEED) -> Column:
    """A double in [0, 1)."""
    return draw(row_id, purpose, seed) / F.lit(float(2**HASH_BITS))


def poisson_one(row_id, purpose, seed: int = DEFAULT_SEED) -> Column:
    """A Poisson(1) count: how often a row enters one bootstrap bag.

    The ladder goes on until the rest is less than the grain of a draw.
    """
    u = uniform(row_id, purpose, seed)
    term, cumulative, count, out = math.exp(-1.0), math.exp(-1.0), 0, F
    while True:
        out = out.when(u < cumulative, count)
        count += 1
        term /= count
        if cumulative >= 1.0 - 2.0**-HASH_BITS:
            return out.otherwise(count)
        cumulative += term
