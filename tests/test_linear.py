"""The linear family and tail probabilities against direct computation."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelwright.functions.grids import log_grid
from panelwright.operators import correlation, linear, moments
from panelwright.operators.distributions import binomial_at_least, exact_interval, student_two_sided

TERMS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [5, 1e6, 0, 0]
    x[:, 3] = x[:, 0] + 0.2 * rng.normal(size=n)
    y = 1e4 + 50 * x[:, 0] - 3 * (x[:, 1] - 1e6) + rng.normal(size=n) * 20
    rows = [(int(i), float(y[i]), *[float(v) for v in x[i]], bool(i % 4), int(i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double, c double, d double, is_train boolean, fold int").cache()
    return df, np.array([r[1:6] for r in rows]), np.array([r[6] for r in rows]), np.array([r[7] for r in rows])


def test_moments_add_up(table):
    df, data, train, fold = table
    parts, test = linear.split_moments(df, "y", TERMS)
    whole = moments.total(parts)
    inside = data[train]
    assert whole.n == len(inside)
    assert np.allclose(whole.mean, inside.mean(axis=0), rtol=1e-12)
    centred = inside - inside.mean(axis=0)
    assert np.allclose(whole.cross, centred.T @ centred, rtol=1e-9)
    assert test.n == (~train).sum()


def test_least_squares(table):
    df, data, train, _ = table
    parts, test = linear.split_moments(df, "y", TERMS)
    whole = moments.total(parts)
    fit = linear.ols(whole, "y", TERMS)
    x = np.column_stack([np.ones(train.sum()), data[train][:, 1:] - [0, 1e6, 0, 0]])
    b, *_ = np.linalg.lstsq(x, data[train][:, 0], rcond=None)
    assert np.allclose(fit.coef, b[1:], rtol=1e-6)
    guess = fit.intercept + data[~train][:, 1:] @ fit.coef
    assert math.isclose(fit.mse(test, "y"), np.mean((data[~train][:, 0] - guess) ** 2), rel_tol=1e-6)
    scored = df.where("not is_train").agg(F.avg((F.col("y") - fit.score()) ** 2)).first()[0]
    assert math.isclose(scored, fit.mse(test, "y"), rel_tol=1e-6)
    residual = data[train][:, 0] - x @ b
    sigma2 = residual @ residual / (train.sum() - 5)
    errors = np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))
    rows = linear.ols_table(whole, "y", TERMS)
    assert np.allclose([r[2] for r in rows][1:], errors[1:], rtol=1e-5)
    assert rows[1][4] < 1e-3 < rows[3][4]


def test_ridge_closed_form(table):
    df, data, train, fold = table
    parts, _ = linear.split_moments(df, "y", TERMS)
    whole = moments.total(parts)
    x, y = data[train][:, 1:], data[train][:, 0]
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    for penalty in (0.1, 10.0, 1e4):
        fit = linear.fit_at(whole, "y", TERMS, 0, penalty)
        b = np.linalg.solve(z.T @ z / len(z) + penalty / y.std() * np.eye(4), z.T @ t / len(z))
        assert np.allclose(fit.coef, b * y.std() / x.std(0), rtol=1e-6)


def test_lasso_conditions(table):
    df, data, train, _ = table
    whole = moments.total(linear.split_moments(df, "y", TERMS)[0])
    x, y = data[train][:, 1:], data[train][:, 0]
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    zeros = set()
    for penalty in log_grid(-2, 3, 30):
        fit = linear.fit_at(whole, "y", TERMS, 1, penalty)
        b = fit.coef * x.std(0) / y.std()
        gap, limit = z.T @ (t - z @ b) / len(z), penalty / y.std()
        assert np.all(np.abs(gap) <= limit + 1e-8)
        assert np.allclose(gap[b != 0], limit * np.sign(b[b != 0]), atol=1e-8)
        zeros.add(int((b == 0).sum()))
    assert zeros >= {4} and min(zeros) <= 1


@pytest.mark.parametrize("alpha", [0, 1])
def test_penalties_agree_with_spark(table, alpha):
    df, data, train, _ = table
    whole = moments.total(linear.split_moments(df, "y", TERMS)[0])
    part = VectorAssembler(inputCols=TERMS, outputCol="x").transform(df.where("is_train"))
    model = LinearRegression(labelCol="y", featuresCol="x", regParam=2.0, elasticNetParam=float(alpha), tol=1e-12, maxIter=1000).fit(part)
    fit = linear.fit_at(whole, "y", TERMS, alpha, 2.0)
    assert np.allclose(fit.coef, model.coefficients.toArray(), rtol=2e-2, atol=0.05)


@pytest.mark.parametrize("alpha", [0, 1])
def test_penalty_choice_by_refits(table, alpha):
    df, data, train, fold = table
    parts, _ = linear.split_moments(df, "y", TERMS)
    grid = log_grid(-2, 3, 12)
    choice = linear.choose_penalty(parts, "y", TERMS, alpha, grid)
    raw = []
    for g in grid:
        errors = []
        for k in range(5):
            keep, held = train & (fold != k), train & (fold == k)
            x, y = data[keep][:, 1:], data[keep][:, 0]
            m = moments.Moments(("y", *TERMS), keep.sum(), data[keep].mean(0), (data[keep] - data[keep].mean(0)).T @ (data[keep] - data[keep].mean(0)))
            fit = linear.fit_at(m, "y", TERMS, alpha, g)
            errors.append(np.mean((data[held][:, 0] - fit.intercept - data[held][:, 1:] @ fit.coef) ** 2))
        raw.append(errors)
    weight = np.array([(train & (fold == k)).sum() for k in range(5)])
    mean = np.average(raw, axis=1, weights=weight)
    assert np.allclose(choice.error, mean, rtol=1e-6)
    spread = np.sqrt(np.average((np.array(raw) - mean[:, None]) ** 2, axis=1, weights=weight) / 4)
    assert np.allclose(choice.spread, spread, rtol=1e-5)
    best = mean.argmin()
    assert choice.at_min == pytest.approx(grid[best])
    assert choice.at_one_se == pytest.approx(max(g for g, e in zip(grid, mean) if e <= mean[best] + spread[best]))


def test_inflation_and_matrix(table):
    df, data, _, _ = table
    out = {r.term: r.vif for r in correlation.variance_inflation(df, TERMS).collect()}
    r = np.corrcoef(data[:, 1:].T)
    assert np.allclose([out[t] for t in TERMS], np.diag(np.linalg.inv(r)), rtol=1e-5)
    long = {(x.term_i, x.term_j): x.r for x in correlation.correlation_matrix(df, TERMS).collect()}
    assert all(math.isclose(long[a, b], r[i, j], abs_tol=1e-8) for i, a in enumerate(TERMS) for j, b in enumerate(TERMS))
    flat = df.withColumn("e", F.lit(1.0))
    assert all(v.vif is None for v in correlation.variance_inflation(flat, ["a", "e"]).collect())


def test_coefficients_side_by_side(spark):
    fits = {"one": linear.LinearFit(("a", "b"), 1.0, np.array([0.0, 2.0])), "two": linear.LinearFit(("b", "c"), 0.0, np.array([1.0, 3.0]))}
    got = {r["name"]: (r.one, r.two) for r in linear.coefficient_frame(spark, fits).collect()}
    assert got == {"(Intercept)": (1.0, None), "a": (None, None), "b": (2.0, 1.0), "c": (None, 3.0)}


def test_tails():
    # Published values: t with 10 degrees of freedom, binomial tail, exact interval of 8 in 10.
    assert math.isclose(student_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(binomial_at_least(8, 10, 0.5), 56 / 1024, rel_tol=1e-12)
    low, high = exact_interval(8, 10)
    assert math.isclose(low, 0.4439045, abs_tol=1e-6) and math.isclose(high, 0.9747893, abs_tol=1e-6)
    assert exact_interval(0, 20)[0] == 0.0 and math.isclose(exact_interval(0, 20)[1], 1 - 0.025 ** (1 / 20), rel_tol=1e-9)
    low, high = exact_interval(5 * 10**9, 10**10)
    assert math.isclose(high - low, 2 * 1.959964 * 0.5 / 10**5, rel_tol=1e-3)


def test_coefficient_table_with_constant_and_repeated_terms(spark):
    from panelwright.operators import linear
    from panelwright.operators.moments import moments

    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 60))
    y = 1 + 2 * a - b + rng.normal(size=60)
    rows = [(float(y[i]), float(a[i]), 5.0, float(2 * a[i] + 1), float(b[i])) for i in range(60)]
    m = moments(spark.createDataFrame(rows, "y double, a double, c double, twice double, b double"), ["y", "a", "c", "twice", "b"])
    got = {r[0]: r[1:] for r in linear.ols_table(m, "y", ["a", "c", "twice", "b"])}
    plain = {r[0]: r[1:] for r in linear.ols_table(m, "y", ["a", "b"])}
    assert got["c"] == got["twice"] == (None,) * 4
    for name in ("(Intercept)", "a", "b"):
        assert got[name] == pytest.approx(plain[name])


def test_binomial_tail_keeps_its_digits():
    from panelwright.operators.distributions import binomial_at_least

    for n in (10**6, 10**10, 10**11):
        # P(X >= n/2) is one half and half the middle term, 1/sqrt(2 pi n/4).
        assert binomial_at_least(n // 2, n, 0.5) == pytest.approx(0.5 + 0.5 / (2 * np.pi * n / 4) ** 0.5, abs=1e-10)
    assert binomial_at_least(3, 10, 0.2) == pytest.approx(0.3222004736)
