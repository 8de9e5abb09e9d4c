"""Least squares, ridge and lasso from accumulated moments.

Penalties follow the usual path convention: predictors are scaled by their
standard deviation (divisor n), the outcome as well, and the objective is
RSS/(2n) + lambda * ((1-alpha)/2 * |b|² + alpha * |b|). In the units of the scaled
outcome lambda is divided by the outcome's standard deviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.grids import log_grid
from ..functions.nulls import divide
from ..functions.recode import stars
from .distributions import student_two_sided
from .moments import Moments, moments_by, total


@dataclass
class LinearFit:
    """Intercept and coefficients of named predictors."""

    terms: tuple[str, ...]
    intercept: float
    coef: np.ndarray

    def score(self) -> Column:
        """The prediction as a column expression."""
        out = F.lit(float(self.intercept))
        for name, b in zip(self.terms, self.coef):
            out = out + F.lit(float(b)) * F.col(name)
        return out

    def mse(self, m: Moments, outcome: str) -> float:
        """Mean squared error on the rows behind ``m``."""
        x, y = m.at(self.terms), m.names.index(outcome)
        rss = m.cross[y, y] - 2 * self.coef @ m.cross[x, y] + self.coef @ m.cross[np.ix_(x, x)] @ self.coef
        bias = m.mean[y] - self.intercept - self.coef @ m.mean[x]
        return float(rss / m.n + bias**2)


def ols(m: Moments, outcome: str, terms: Sequence[str]) -> LinearFit:
    """Least squares; columns that repeat others share their effect."""
    x, y = m.at(terms), m.names.index(outcome)
    scale = np.sqrt(np.diag(m.cross)[x])
    scale[scale == 0] = 1.0
    a = m.cross[np.ix_(x, x)] / np.outer(scale, scale)
    b = np.linalg.lstsq(a, m.cross[x, y] / scale, rcond=1e-12)[0] / scale
    return LinearFit(tuple(terms), float(m.mean[y] - b @ m.mean[x]), b)


def _independent(a: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Positions of the columns that are no combination of earlier ones, by elimination in order."""
    rest, kept = a.copy(), []
    for j in range(len(a)):
        if rest[j, j] > tolerance:
            kept.append(j)
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
    return kept


def ols_table(m: Moments, outcome: str, terms: Sequence[str]) -> list[tuple]:
    """(term, estimate, std_error, statistic, p_value) with the intercept first.

    A constant predictor and one that repeats earlier ones have NULL in all four;
    the degrees of freedom are the rows less the rank. Without any left, or with
    residuals of 0, errors and what follows from them are NULL.
    """
    scale = np.sqrt(np.diag(m.cross)[m.at(terms)])
    scale[scale == 0] = 1.0
    x = m.at(terms)
    used = [terms[j] for j in _independent(m.cross[np.ix_(x, x)] / np.outer(scale, scale))]
    fit, x = ols(m, outcome, used), m.at(used)
    scale = np.sqrt(np.diag(m.cross)[x]) if used else np.ones(0)
    freedom = m.n - len(used) - 1
    known = {"(Intercept)": fit.intercept, **dict(zip(used, fit.coef))}
    errors = {}
    if freedom > 0:
        sigma2 = max(fit.mse(m, outcome), 0.0) * m.n / freedom
        inverse = np.linalg.inv(m.cross[np.ix_(x, x)] / np.outer(scale, scale)) / np.outer(scale, scale)
        spread = np.concatenate([[1 / m.n + m.mean[x] @ inverse @ m.mean[x]], np.diag(inverse)])
        errors = dict(zip(known, np.sqrt(sigma2 * spread)))
    rows = []
    for name in ("(Intercept)", *terms):
        b, e = known.get(name), errors.get(name)
        t = float(b / e) if b is not None and e else None
        rows.append((
            name, None if b is None else float(b), None if e is None else float(e), t,
            None if t is None else student_two_sided(t, freedom),
        ))
    return rows


def _scaled(parts: Sequence[Moments], outcome: str, terms: Sequence[str]):
    """Correlation matrices, correlations with the outcome and scales, per table."""
    mats, vecs, sx, sy = [], [], [], []
    for m in parts:
        x, y = m.at(terms), m.names.index(outcome)
        s = np.sqrt(np.diag(m.cross)[x] / m.n)
        s[s == 0] = 1.0
        t = np.sqrt(m.cross[y, y] / m.n) or 1.0
        mats.append(m.cross[np.ix_(x, x)] / m.n / np.outer(s, s))
        vecs.append(m.cross[x, y] / m.n / s / t)
        sx.append(s)
        sy.append(t)
    return np.array(mats), np.array(vecs), np.array(sx), np.array(sy)


def _lasso_at(r: np.ndarray, v: np.ndarray, limit: float, b: np.ndarray) -> np.ndarray:
    """Lasso coefficients for a correlation matrix ``r`` and correlations ``v``.

    Feature-sign search (Lee and others 2007) from a start ``b``: solve for the
    active coefficients with their signs held, stop at the best sign change on
    the way, admit the coefficient that violates its condition most. Exact after
    a finite number of small solves, also for nearly collinear predictors.
    """
    b = b.copy()

    def objective(x):
        return 0.5 * x @ r @ x - v @ x + limit * np.abs(x).sum()

    for _ in range(1000 + 100 * len(v)):
        gap = v - r @ b
        signs = np.sign(b)
        idle = signs == 0
        settled = np.all(np.abs(gap - limit * signs)[~idle] <= 1e-11)
        if settled:
            worst = int(np.argmax(np.where(idle, np.abs(gap), -1.0)))
            if not idle[worst] or abs(gap[worst]) <= limit + 1e-11:
                break
            signs[worst] = np.sign(gap[worst])
        on = np.flatnonzero(signs)
        new = np.zeros_like(b)
        new[on] = np.linalg.lstsq(r[np.ix_(on, on)], v[on] - limit * signs[on], rcond=1e-13)[0]
        options = [new]
        for j in on:
            if b[j] * new[j] < 0:
                point = b + b[j] / (b[j] - new[j]) * (new - b)
                point[j] = 0.0
                options.append(point)
        best = min(options, key=objective)
        if np.array_equal(best, b):
            break
        b = best
    else:
        raise ArithmeticError("the lasso fit did not settle")
    return b


def _lasso_paths(mats, vecs, penalties) -> np.ndarray:
    """Fits for several tables; penalties run downwards, each from the last fit."""
    tables, p = vecs.shape
    out = np.empty((penalties.shape[1], tables, p))
    for k in range(tables):
        b = np.zeros(p)
        for step in range(penalties.shape[1]):
            b = _lasso_at(mats[k], vecs[k], float(penalties[k, step]), b)
            out[step, k] = b
    return out


def penalised_paths(
    parts: Sequence[Moments], outcome: str, terms: Sequence[str], alpha: int, grid: Sequence[float]
) -> list[list[LinearFit]]:
    """Fits for every penalty (in the order of ``grid``) and every table of moments."""
    mats, vecs, sx, sy = _scaled(parts, outcome, terms)
    p = len(terms)
    if alpha == 0:
        spread, axes = np.linalg.eigh(mats)
        turned = np.einsum("kpq,kp->kq", axes, vecs)
        coefs = []
        for penalty in grid:
            shrunk = turned / (np.maximum(spread, 0.0) + (penalty / sy)[:, None])
            coefs.append(np.einsum("kpq,kq->kp", axes, shrunk))
        path = np.array(coefs).reshape(len(grid), len(parts), p)
    elif alpha == 1:
        order = np.argsort(grid)[::-1]
        down = _lasso_paths(mats, vecs, np.array(grid)[order][None, :] / sy[:, None])
        path = np.empty_like(down)
        path[order] = down
    else:
        raise ValueError("alpha is 0 (ridge) or 1 (lasso)")
    out = []
    for step in range(len(grid)):
        fits = []
        for k, m in enumerate(parts):
            b = path[step, k] * sy[k] / sx[k]
            a = float(m.mean[m.names.index(outcome)] - b @ m.mean[m.at(terms)])
            fits.append(LinearFit(tuple(terms), a, b))
        out.append(fits)
    return out


@dataclass
class PenaltyChoice:
    """Cross-validated error per penalty and the two customary choices."""

    grid: list[float]
    error: np.ndarray
    spread: np.ndarray
    at_min: float
    at_one_se: float


def choose_penalty(
    folds: Sequence[Moments], outcome: str, terms: Sequence[str], alpha: int, grid: Sequence[float]
) -> PenaltyChoice:
    """k-fold cross-validation of a penalty without a further look at the data.

    The training moments of a fold are the sum over the other folds. The second
    choice is the largest penalty within one standard error of the least error.
    """
    grid = [float(g) for g in grid]
    train = [total([m for i, m in enumerate(folds) if i != k]) for k in range(len(folds))]
    paths = penalised_paths(train, outcome, terms, alpha, grid)
    raw = np.array([[fit.mse(folds[k], outcome) for k, fit in enumerate(fits)] for fits in paths])
    weight = np.array([m.n for m in folds], dtype=float)
    error = raw @ weight / weight.sum()
    spread = np.sqrt(((raw - error[:, None]) ** 2) @ weight / weight.sum() / (len(folds) - 1))
    best = int(np.argmin(error))
    lowest = max(g for g, e in zip(grid, error) if e <= error[best])
    one_se = max(g for g, e in zip(grid, error) if e <= error[best] + spread[best])
    return PenaltyChoice(grid, error, spread, lowest, one_se)


def fit_at(m: Moments, outcome: str, terms: Sequence[str], alpha: int, penalty: float) -> LinearFit:
    return penalised_paths([m], outcome, terms, alpha, [penalty])[0][0]


def penalised_fits(
    folds: Sequence[Moments], outcome: str, terms: Sequence[str], ridge: tuple, lasso: tuple
) -> dict[str, LinearFit]:
    """Ridge and lasso at both penalty choices; grids are (low, high, length)."""
    whole, out = total(folds), {}
    for name, alpha, grid in (("ridge", 0, ridge), ("lasso", 1, lasso)):
        choice = choose_penalty(folds, outcome, terms, alpha, log_grid(*grid))
        out[f"{name}_min"] = fit_at(whole, outcome, terms, alpha, choice.at_min)
        out[f"{name}_1se"] = fit_at(whole, outcome, terms, alpha, choice.at_one_se)
    return out


def split_moments(
    df: DataFrame, outcome: str, terms: Sequence[str], train: str = "is_train", fold: str = "fold"
) -> tuple[list[Moments], Moments]:
    """Moments of each training fold and of the hold-out rows, in one pass."""
    marked = df.withColumn("_cell", F.when(F.col(train), F.col(fold)).otherwise(F.lit(-1)))
    cells = moments_by(marked, [outcome, *terms], "_cell")
    return [cells[k] for k in sorted(k for k in cells if k >= 0)], cells[-1]


def coefficient_frame(spark: SparkSession, fits: dict[str, LinearFit]) -> DataFrame:
    """Coefficients of several fits side by side; exact zeros become NULL."""
    names = ["(Intercept)", *dict.fromkeys(t for f in fits.values() for t in f.terms)]
    rows = []
    for name in names:
        row = [name]
        for fit in fits.values():
            known = {"(Intercept)": fit.intercept, **dict(zip(fit.terms, fit.coef))}
            value = known.get(name)
            row.append(None if value is None or value == 0 else float(value))
        rows.append(tuple(row))
    schema = "name string, " + ", ".join(f"`{k}` double" for k in fits)
    return spark.createDataFrame(rows, schema)


def coefficient_table(rows: list[tuple], spark: SparkSession) -> DataFrame:
    schema = "term string, estimate double, std_error double, statistic double, p_value double"
    return spark.createDataFrame(rows, schema).withColumn("signif", stars("p_value"))


def explained(df: DataFrame, error: str, variance) -> DataFrame:
    """Shares of the outcome's variance left open and explained by a fit."""
    open_share = divide(error, F.lit(variance) if not isinstance(variance, (str, Column)) else variance)
    return df.withColumns({"prop_var_explained": 1 - open_share, "prop_var_unexplained": open_share})
