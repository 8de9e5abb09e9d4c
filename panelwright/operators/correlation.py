"""Correlations with a target under several populations and missing-value modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.recode import recode
from ..functions.stats import correlation
from .columns import is_complete
from .moments import Moments, moments
from .order import rank_small

PAIRWISE, LISTWISE = "pairwise", "listwise"

# Correlations per aggregation group: ten buffers each, and generated code ends at 100 fields.
_BLOCK = 8


def correlate(
    df: DataFrame,
    targets: Sequence[str],
    terms: Sequence[str],
    populations: Mapping[str, Column] | None = None,
    modes: Sequence[str] = (PAIRWISE,),
) -> DataFrame:
    """Correlation of every term with every target, per population and mode.

    One scan answers the whole grid. Terms and blocks of up to eight cells (a
    target with some populations and modes) are laid out as rows within the
    task, so the aggregation has one group per term and block and few enough
    aggregates to stay in generated code; partial results of one row per group
    and task are all that is shuffled. Listwise deletion, as in a complete-case
    table, is over the terms and the one target.

    Result: ``population, target, na_mode, term, r``.
    """
    populations = dict(populations or {"all": F.lit(True)})
    masks = {}
    for population, condition in populations.items():
        for mode in modes:
            masks[population, mode] = condition & is_complete(terms) if mode == LISTWISE else condition
    cells = list(masks)
    blocks, names = [], {}
    for target in targets:
        for at in range(0, len(cells), _BLOCK):
            chosen = cells[at : at + _BLOCK]
            for slot, (population, mode) in enumerate(chosen):
                names[len(blocks) * _BLOCK + slot] = (population, target, mode)
            marks = [masks[c] for c in chosen] + [F.lit(False)] * (_BLOCK - len(chosen))
            blocks.append(F.struct(
                F.lit(len(blocks)).alias("_block"), F.col(target).cast("double").alias("_y"),
                *[m.alias(f"_m{i}") for i, m in enumerate(marks)],
            ))
    values = [F.col(c).cast("double").alias(c) for c in terms]
    rows = df.select(F.array(*blocks).alias("_blocks"), *values).select(F.inline("_blocks"), *terms)
    long = rows.unpivot(["_block", "_y", *[f"_m{i}" for i in range(_BLOCK)]], list(terms), "term", "x")
    width = min(_BLOCK, len(cells))
    wide = long.groupBy("term", "_block").agg(
        *[correlation("x", "_y", F.col(f"_m{i}")).alias(f"r{i}") for i in range(width)]
    )
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"r{i}").alias("r")) for i in range(width)])
    out = wide.select("term", "_block", F.inline(slots)).withColumn("_cell", F.col("_block") * _BLOCK + F.col("slot"))
    label = lambda part: recode("_cell", {cell: name[part] for cell, name in names.items()})
    out = out.select(label(0).alias("population"), label(1).alias("target"), label(2).alias("na_mode"), "term", "r")
    return out.where(F.col("target").isNotNull() & (F.col("term") != F.col("target")))


def focus(df: DataFrame, target: str, terms: Sequence[str], listwise: bool = False) -> DataFrame:
    """One correlation list with its plotting order (weakest first, unknown last)."""
    mode = LISTWISE if listwise else PAIRWISE
    out = correlate(df, [target], terms, modes=[mode]).select("term", "r")
    return rank_small(out, [F.col("r").asc_nulls_last(), F.col("term")], "ord")


def matrix_of(m: Moments) -> np.ndarray:
    """Correlation matrix of accumulated moments; NaN for constant columns."""
    sd = np.sqrt(np.diag(m.cross))
    scale = np.outer(sd, sd)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.where(scale > 0, m.cross / scale, np.nan), -1.0, 1.0)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations of the complete rows, long, with the diagonal."""
    r = matrix_of(moments(df.dropna("any", subset=list(columns)), columns))
    rows = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "term_i string, term_j string, r double")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 / (1 - R²) of each predictor on the others: the diagonal of the inverse
    correlation matrix, which has one row per predictor and lives on the driver."""
    r = matrix_of(moments(df.dropna("any", subset=list(columns)), columns))
    if np.isnan(r).any() or np.linalg.matrix_rank(r) < len(columns):
        values = [None] * len(columns)
    else:
        values = [float(v) for v in np.diag(np.linalg.inv(r))]
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "term string, vif double")
