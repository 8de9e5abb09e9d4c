"""Behaviour of fitted models on data with a known answer."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelwright.functions.hashing import uniform
from panelwright.operators import cluster
from panelwright.operators.classify import (
    elastic_logistic, fourier_map, linear_svm, logistic, polynomial_map, standardised,
)
from panelwright.operators.fitting import Candidate, assemble, cross_validate, holdout_error, prepare
from panelwright.operators.forests import Forest
from panelwright.plans import studies
from panelwright.plans.studies import QUICK, Study


@pytest.fixture(scope="module")
def ring(spark):
    """An inner disc against an outer ring."""
    df = spark.range(1200).withColumnRenamed("id", "k")
    df = df.withColumns({"x1": uniform("k", "x1") * 2 - 1, "x2": uniform("k", "x2") * 2 - 1})
    r2 = F.col("x1") * F.col("x1") + F.col("x2") * F.col("x2")
    return df.withColumn("y", (r2 < 0.6).cast("int")).cache()


@pytest.fixture(scope="module")
def planted(spark):
    """A 0/1 outcome and a value that depend on ``signal`` only."""
    df = spark.range(800).withColumnRenamed("id", "k")
    df = df.withColumns({c: uniform("k", c) for c in ("signal", "noise1", "noise2", "e")})
    df = df.withColumn("y", ((F.col("signal") + 0.5 * F.col("e")) > 0.75).cast("int"))
    return df.withColumn("value", 10 * F.col("signal") + F.col("e")).cache()


PLANTED_TERMS = ["signal", "noise1", "noise2"]


def test_kernels_separate_a_ring(spark, ring):
    df = standardised(assemble(ring, ["x1", "x2"]), assemble(ring, ["x1", "x2"]))
    flat = holdout_error(linear_svm("y", 1.0, 1200, 20).fit(df), df, "y")
    mapped = fourier_map(df, 0.5, 100).persist()
    radial = holdout_error(linear_svm("y", 10.0, 1200, 40, "mapped", False).fit(mapped), mapped, "y")
    square = polynomial_map(df, 2).persist()
    poly = holdout_error(linear_svm("y", 100.0, 1200, 40, "mapped", False).fit(square), square, "y")
    assert flat > 0.3 and radial < 0.08 and poly < 0.08


def test_polynomial_map_is_the_kernel(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(6, 3))
    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["i", "scaled"])
    for degree in (2, 3):
        rows = polynomial_map(df, degree).orderBy("i").collect()
        z = np.array([r["mapped"].toArray() for r in rows])
        assert np.allclose(z @ z.T, (points @ points.T / 3) ** degree)


def test_fourier_map_approximates_the_kernel(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(8, 4))
    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["i", "scaled"])
    z = np.array([r["mapped"].toArray() for r in fourier_map(df, 0.2, 4000).orderBy("i").collect()])
    gap = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.2 * gap)).max() < 0.08


def test_logistic_against_newton(spark, planted):
    df = assemble(planted, PLANTED_TERMS)
    model = logistic("y").fit(df).stages[0]
    rows = np.array([[1.0, *[r[t] for t in PLANTED_TERMS], r.y] for r in planted.collect()])
    x, y = rows[:, :4], rows[:, 4]
    b = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    assert np.allclose([model.intercept, *model.coefficients], b, rtol=1e-6, atol=1e-6)


def test_cross_validation_covers_the_grid(spark, planted):
    table = assemble(prepare(planted, "k", ["y", *PLANTED_TERMS], 3), PLANTED_TERMS).persist()
    found = cross_validate(
        table.where("is_train"), [Candidate((p,), lambda n, p=p: elastic_logistic("y", p, 0.0)) for p in (0.0, 5.0)], "y", range(3)
    )
    assert [(f[0], f[1]) for f in found] == [((p,), k) for p in (0.0, 5.0) for k in range(3)]
    weak = np.mean([f[3] for f in found if f[0] == (0.0,)])
    assert weak < np.mean([f[3] for f in found if f[0] == (5.0,)])
    model = elastic_logistic("y", 0.0, 0.0).fit(table.where("is_train and fold <> 0"))
    assert holdout_error(model, table.where("fold = 0"), "y") == pytest.approx(found[0][3])


def small_study(planted, outcome, permutations=1000):
    settings = replace(QUICK, trees=20, permutations=permutations)
    return Study.of(planted, "k", outcome, PLANTED_TERMS, settings)


@pytest.mark.parametrize("outcome,regression", [("y", False), ("value", True)])
def test_permutation_p_values_find_the_signal(spark, planted, outcome, regression):
    out = studies.permutation_p_values(small_study(planted, outcome, 19), 2, regression)
    p = {r.term: r.p_value for r in out.collect()}
    assert p["signal"] == pytest.approx(1 / 20) and p["noise1"] > 0.05 and p["noise2"] > 0.05


def test_corrected_importance(spark, planted):
    study = small_study(planted, "value")
    plain = {r.term: r.importance for r in studies.importances(study, [3], True).collect()}
    fair = {r.term: r.importance for r in studies.corrected_importances(study, 3).collect()}
    assert fair["signal"] > 0.5 * plain["signal"]
    assert all(abs(fair[t]) < 0.02 * fair["signal"] for t in ("noise1", "noise2")), (fair, plain)


def test_out_of_bag_error_is_near_holdout(spark, planted):
    for outcome, regression in (("y", False), ("value", True)):
        (e,) = studies.grown_errors(small_study(planted, outcome), [Forest((2,), 40, 2)], regression)
        assert e["share_scored"] == 1.0 and abs(e["oob_error"] - e["test_error"]) < 0.4 * e["test_error"] + 0.02


def test_cluster_grid_against_lloyd(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [12, 0], [0, 12], [12, 12]])
    points = np.vstack([c + rng.normal(size=(60, 2)) for c in centres]) + [1e6, 0]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "k long, a double, b double").cache()
    best = cluster.cluster_grid(df, "k", ["a", "b"], range(2, 6), starts=8, tolerance=0.0)
    within = [best[k].within for k in range(2, 6)]
    assert within == sorted(within, reverse=True)
    for k in range(2, 6):
        c = best[k].centres
        distance = ((points[:, None, :] - c) ** 2).sum(-1)
        near = distance.argmin(1)
        assert np.isclose(distance.min(1).sum(), best[k].within, rtol=1e-6)
        assert np.allclose([points[near == j].mean(0) for j in range(k)], c)
    true = sum(((points[60 * i: 60 * i + 60] - points[60 * i: 60 * i + 60].mean(0)) ** 2).sum() for i in range(4))
    assert np.isclose(best[4].within, true)
    labels = cluster.assign(df, ["a", "b"], best[4].centres).orderBy("k").collect()
    assert all(len({r.cluster for r in labels[60 * i: 60 * i + 60]}) == 1 for i in range(4))


def test_transfers_never_end_above_rounds_alone(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(70, 3)) * [1, 2, 5]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "k long, a double, b double, c double").cache()
    plain = cluster.cluster_grid(df, "k", ["a", "b", "c"], [3, 6], starts=3, transfers=False)
    moved = cluster.cluster_grid(df, "k", ["a", "b", "c"], [3, 6], starts=3)
    for k in (3, 6):
        assert moved[k].within <= plain[k].within + 1e-9
        centres = moved[k].centres
        distance = ((points[:, None, :] - centres) ** 2).sum(axis=2)
        near = distance.argmin(axis=1)
        assert np.isclose(distance.min(axis=1).sum(), moved[k].within)
        assert np.allclose(centres, [points[near == j].mean(axis=0) for j in range(k)])
        sizes = np.bincount(near, minlength=k)
        for i, a in enumerate(near):  # no single row can move
            leave = sizes[a] / max(sizes[a] - 1, 1) * distance[i, a] if sizes[a] > 1 else 0.0
            assert all(leave <= sizes[b] / (sizes[b] + 1) * distance[i, b] + 1e-7 for b in range(k) if b != a)
    assert any(moved[k].transfers for k in (3, 6))


def test_study_of_a_ring(spark, ring):
    settings = QUICK
    with Study.of(ring, "k", "y", ["x1", "x2"], settings) as s:
        found = studies.machine_fold_errors(s, ["radial"])["radial"]
        best = studies.tuned_machines(s)
    assert len(found) == 3 * len(settings.gammas) * len(settings.radial_costs)
    assert best["radial"][1] < 0.05 and best["polynomial"][1] < 0.05 and best["linear"][1] > 0.3


def test_exponents_follow_the_expansion(spark):
    from pyspark.ml.feature import PolynomialExpansion
    from pyspark.ml.linalg import Vectors

    from panelwright.operators.classify import _exponents

    x = np.array([2.0, 3.0, 5.0, 7.0])
    for degree in (1, 2, 3, 5):
        frame = spark.createDataFrame([(Vectors.dense(x),)], ["v"])
        want = PolynomialExpansion(degree=degree, inputCol="v", outputCol="e").transform(frame).first()["e"].toArray()
        assert np.allclose(np.prod(x ** _exponents(4, degree), axis=1), want)
    assert len(_exponents(80, 2)) == 3320


@pytest.mark.parametrize("name", [
    "rf_class_cv", "rf_reg_cv", "oob_error", "bagged_holdout", "gbt_cv", "svm_linear", "svm_rbf", "svm_poly", "svm_accuracy",
    "logit_elastic_cv", "refit_best", "rf_importance", "rf_importance_corrected", "altmann_pvalues",
    "altmann_pvalues_regression", "bench_classification", "bench_regression",
])
def test_registered_queries_run_the_whole_study(monkeypatch, name):
    import __spark_entry__ as entry
    from panelwright.plans import model_queries

    class Asked(Exception):
        pass

    def of(df, row_id, outcome, terms, settings, others=()):
        raise Asked(settings)

    monkeypatch.setattr(model_queries, "model_data", lambda spark, folder: None)
    monkeypatch.setattr(model_queries.Study, "of", of)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](None, "")
    s = asked.value.args[0]
    assert (s.folds, list(s.mtry), s.trees, s.depth, len(s.rates), s.rounds) == (10, list(range(1, 13)), 500, None, 20, 500)
    assert (len(s.linear_costs), len(s.gammas) * len(s.radial_costs), len(s.degrees) * len(s.poly_costs)) == (5, 45, 24)
    assert (s.permutations, len(s.penalties)) == (1000, 200)


BOARD = {
    "logistic_model", "ridge_logistic", "lasso_logistic", "random_forest", "bagged_classification", "boosted_classification",
    "svm_linear", "svm_radial", "svm_polynomial", "ridge_min", "ridge_1se", "lasso_min", "lasso_1se",
}


def test_study_queries_end_to_end(spark, small, monkeypatch):
    """The whole chain of the dearest queries on the smallest tables, with smaller grids."""
    import __spark_entry__ as entry
    from panelwright.plans import model_queries

    monkeypatch.setattr(model_queries, "FULL", QUICK)
    queries = entry.queries()
    rows = queries["bench_classification"](spark, small).collect()
    for outcome in ("action_flag", "unanimous_flag"):
        mine = [r for r in rows if r.outcome == outcome]
        board = sorted((r.ord, r.name, r.value) for r in mine if r.part == "leaderboard")
        assert {n for _, n, _ in board} == BOARD and [v for *_, v in board] == sorted(v for *_, v in board)
        assert all(0 <= r.value <= 1 for r in mine if r.metric == "misclass")
        assert sum(r.part == "importance" for r in mine) == 24
    rows = queries["bench_regression"](spark, small).collect()
    for flag in ("action_flag", "unanimous_flag"):
        mine = [r for r in rows if r.predictor == flag]
        error = {r.name: r.value for r in mine if r.part == "leaderboard"}
        share = {r.name: r.value for r in mine if r.part == "explained"}
        assert set(error) == {"ols_model", "ridge_min", "lasso_min", "random_forest", "bagged_regression"}
        ratio = {m: error[m] / (1 - share[m]) for m in error}
        assert np.allclose(list(ratio.values()), ratio["ols_model"])
        assert sum(r.part == "importance" for r in mine) == 24 and sum(r.part == "coefficient" for r in mine) == 39
    (best,) = queries["refit_best"](spark, small).collect()
    grid = {r.mtry: r.test_error for r in queries["rf_class_cv"](spark, small).collect()}
    assert grid[best.mtry] == min(grid.values())
    p = [r.p_value for r in queries["altmann_pvalues"](spark, small).collect()]
    assert len(p) == 12 and p == sorted(p) and min(p) >= 1 / 21
