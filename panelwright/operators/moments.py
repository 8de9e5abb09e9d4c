"""Counts, means and centred cross products per group, in one aggregation.

Everything the linear family needs (least squares, ridge, lasso, correlations,
variance inflation, hold-out errors) follows from these (p+1)² numbers, so the
data are read once, whatever the number of folds and penalties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F


# Columns whose products are summed in one aggregation.
_BLOCK = 48


@dataclass
class Moments:
    """Row count, means and centred cross products of named columns."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        cross = self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(self.names, n, mean, cross)

    def at(self, columns: Sequence[str]) -> np.ndarray:
        return np.array([self.names.index(c) for c in columns])


def total(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def moments_by(df: DataFrame, columns: Sequence[str], by: str) -> dict:
    """Moments of each group of ``by`` (folds or split marks: few groups).

    Columns that hold NULL or NaN are refused. Values are centred on the overall means before
    they are multiplied, so that large values lose no digits.
    """
    p = len(columns)
    means = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(f"k{i}") for i, c in enumerate(columns)],
    ).first()
    missing = [c for i, c in enumerate(columns) if means[f"k{i}"] < means["n"]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}: drop or fill these rows first")
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(p)])
    shifted = df.select(
        F.col(by).alias("_by"), *[(F.col(c).cast("double") - F.lit(float(centre[i]))).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    out: dict = {}
    # One row per column within the task and few aggregates a node: generated code ends at 100 fields.
    for first in range(0, p, _BLOCK):
        block = range(first, min(p, first + _BLOCK))
        sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in range(p)]))
        long = shifted.select("_by", *[f"x{j}" for j in block], sides.alias("_side")).select("*", "_side.i", "_side.v")
        sums = long.groupBy("_by", "i").agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), *[F.sum(F.col("v") * F.col(f"x{j}")).alias(f"q{j}") for j in block]
        )
        for row in sums.collect():
            n, s, q = out.setdefault(row["_by"], (row["n"], np.zeros(p), np.zeros((p, p))))
            s[row["i"]] = row["s"]
            q[row["i"], first : first + len(block)] = [row[f"q{j}"] for j in block]
    return {
        key: Moments(tuple(columns), n, centre + s / n, (q + q.T) / 2 - np.outer(s, s) / n) for key, (n, s, q) in out.items()
    }


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    parts = moments_by(df.withColumn("_all", F.lit(0)), columns, "_all")
    return parts.get(0) or Moments(tuple(columns), 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))


def moments_table(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """The same as a table: group, pair of columns, rows and covariance."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = F.array(*[
        F.struct(F.lit(a).alias("term_i"), F.lit(b).alias("term_j"), F.col(f"c{i}").alias("covariance"))
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.select(by, "n", F.inline(cells))
