"""Model comparisons: every method tuned on the training folds, refitted on the
training rows at its own best setting, and ranked by its hold-out error."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.grids import even_grid, log_grid
from ..functions.hashing import DEFAULT_SEED
from ..operators import forests, importance, linear
from ..operators.boosting import Booster, booster_errors
from ..operators.classify import logistic
from ..operators.evaluate import MISCLASS, MSE, leaderboard
from ..operators.fitting import (
    FEATURES, Candidate, assemble, best_candidate, holdout_error, prepare, test_rows,
    train_rows,
)
from ..operators.forests import CLASSES, VALUES, Forest, Grower
from ..operators.logistic_path import Penalised, logistic_paths
from ..operators.machines import Machine, machine_errors
from ..operators.moments import total
from ..operators.resample import permute_columns
from ..operators.trees import Rule
from ..session import stage
from . import codes


@dataclass
class Settings:
    """Sizes of grids, forests and folds. The defaults are those of the study, with
    trees grown to purity; ``QUICK`` has the same methods on smaller grids, for tests.

    ``class_node``, ``value_node`` and ``share_node`` are the sizes up to which a node is not
    split in forests of classes, of values and of class shares (for importances).
    """

    folds: int = 10
    trees: int = 500
    depth: int | None = None
    class_node: int = 1
    value_node: int = 5
    share_node: int = 10
    mtry: Sequence[int] = tuple(range(1, 13))
    rates: Sequence[float] = tuple(log_grid(*codes.RATE_GRID))
    rounds: int = 500
    boost_depth: int = 6
    linear_costs: Sequence[float] = tuple(codes.LINEAR_COSTS)
    radial_costs: Sequence[float] = tuple(codes.RADIAL_COSTS)
    gammas: Sequence[float] = tuple(even_grid(*codes.RADIAL_GAMMAS))
    poly_costs: Sequence[float] = tuple(codes.POLY_COSTS)
    degrees: Sequence[int] = tuple(codes.POLY_DEGREES)
    penalties: Sequence[float] = tuple(log_grid(*codes.LASSO_CLASS_GRID))
    permutations: int = 1000
    threads: int = 8
    seed: int = DEFAULT_SEED


QUICK = Settings(
    folds=3, trees=12, mtry=(1, 4, 8, 12), rates=tuple(log_grid(-4, -0.1, 3)), rounds=4, boost_depth=4,
    linear_costs=(0.01, 1), radial_costs=(0.1, 10), gammas=(0.1, 2.575), poly_costs=(0.1, 10),
    degrees=(2, 3), penalties=(0.01, 0.1), permutations=20,
)


@dataclass
class Study:
    """A staged modelling table with its split, folds and feature vector.

    The table is kept in memory while the study is open (``with``); what is lost
    with an executor is read again from the staged file.
    """

    table: DataFrame
    row_id: str
    outcome: str
    terms: list[str]
    settings: Settings
    binned: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, row_id: str, outcome: str, terms: Sequence[str], settings: Settings, others=()) -> "Study":
        columns = list(dict.fromkeys([outcome, *terms, *others]))
        table = assemble(prepare(df, row_id, columns, settings.folds, seed=settings.seed), terms)
        return cls(table, row_id, outcome, list(terms), settings)

    def __enter__(self) -> "Study":
        self.table = self.table.persist()
        return self

    def __exit__(self, *_) -> None:
        self.table.unpersist()

    def towards(self, outcome: str, terms: Sequence[str] | None = None) -> "Study":
        """The same rows and split with another outcome or other predictors."""
        terms = list(terms or self.terms)
        table = self.table if terms == self.terms else assemble(self.table.drop(FEATURES), terms)
        return Study(table, self.row_id, outcome, terms, self.settings)

    @property
    def train(self) -> DataFrame:
        return train_rows(self.table)

    @property
    def test(self) -> DataFrame:
        return test_rows(self.table)

    @property
    def fold_numbers(self) -> list[int]:
        return list(range(self.settings.folds))

    def refit(self, candidate: Candidate, metric: str = MISCLASS, on: DataFrame | None = None) -> float:
        """Hold-out error of a candidate fitted to all training rows."""
        table = self.table if on is None else on
        train = train_rows(table)
        return holdout_error(candidate.build(train.count()).fit(train), test_rows(table), self.outcome, metric)


# Forests: all models of a study grow together ---------------------------------

def _binned(s: Study, ranked: bool = False, corrected: bool = False) -> forests.Binned:
    """The study's rows binned once; ``corrected`` adds the values of another training row, for all terms alike."""
    if (ranked, corrected) not in s.binned:
        shadows, df = None, s.table
        if corrected:
            df = s.train
            shadows = permute_columns(df.select(s.row_id, *s.terms), s.row_id, s.terms, ["shadow"], s.settings.seed)
        s.binned[ranked, corrected] = forests.bin_table(
            df, s.row_id, s.outcome, s.terms, ranked=ranked, shadows=shadows)
    return s.binned[ranked, corrected]


def grower(s: Study, models: Sequence[Forest], regression: bool = False, min_node: int | None = None, **bins) -> Grower:
    g = s.settings
    size = min_node or (g.value_node if regression else g.class_node)
    return Grower(
        _binned(s, **bins), models, Rule(min_node=size, depth=g.depth), VALUES if regression else CLASSES, seed=g.seed)


def tried_mtry(s: Study) -> list[int]:
    return [m for m in s.settings.mtry if m <= len(s.terms)]


def forest_grid(s: Study) -> list[Forest]:
    return [Forest((m,), s.settings.trees, m, fold=k) for m in tried_mtry(s) for k in s.fold_numbers]


def grown_errors(s: Study, models: Sequence[Forest], regression: bool = False) -> list:
    """The errors of each forest, in order."""
    rows = {r["model"]: r for r in forests.model_errors(grower(s, models, regression)).collect()}  # one row per forest
    return [rows[m] for m in range(len(models))]


def forest_errors(s: Study, regression: bool = False) -> DataFrame:
    """Mean test, training and out-of-bag error per ``mtry`` over the folds, best first."""
    models = forest_grid(s)
    found = list(zip(models, grown_errors(s, models, regression)))
    rows = []
    for m in tried_mtry(s):
        mine = [e for f, e in found if f.params == (m,)]
        rows.append((m, *[sum(e[c] for e in mine) / len(mine) for c in ("test_error", "oob_error", "train_error")]))
    table = s.table.sparkSession.createDataFrame(rows, "mtry int, test_error double, oob_error double, train_error double")
    return table.orderBy("test_error", "mtry")


def tuned_forest(s: Study, regression: bool = False) -> tuple[int, float, float]:
    """(best mtry, its hold-out error, the hold-out error of bagged trees)."""
    models = forest_grid(s)
    folds = [(f.params, f.fold, e["train_error"], e["test_error"]) for f, e in zip(models, grown_errors(s, models, regression))]
    best = best_candidate(folds)[0] if len(tried_mtry(s)) > 1 else tried_mtry(s)[0]
    p = len(s.terms)
    last = grown_errors(s, [Forest((best,), s.settings.trees, best), Forest(("all",), s.settings.trees, p)], regression)
    return best, last[0]["test_error"], last[1]["test_error"]


def bagged_error(s: Study, regression: bool = False) -> float:
    return grown_errors(s, [Forest(("all",), s.settings.trees, len(s.terms))], regression)[0]["test_error"]


def importances(s: Study, mtry: Sequence[int], regression: bool = False) -> DataFrame:
    """(mtry, term, importance): the decrease of impurity by a term's splits, a tree."""
    models = [Forest((m,), s.settings.trees, min(m, len(s.terms))) for m in mtry]
    gains = grower(s, models, regression, None if regression else s.settings.share_node).gains()
    return gains.select(
        F.element_at(F.array(*[F.lit(m) for m in mtry]), F.col("model") + 1).alias("mtry"), "term",
        F.col("gain").alias("importance"))


def _less_shadow(gains: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gains of terms less those of their shadows."""
    sign = F.when(F.col("term").endswith("_shadow"), -F.col("gain")).otherwise(F.col("gain"))
    return gains.groupBy(*key, F.regexp_replace("term", "_shadow$", "").alias("term")).agg(F.sum(sign).alias("gain"))


def corrected_importances(s: Study, mtry: int) -> DataFrame:
    """(term, importance) without the advantage of terms with many values (Nembrini, König and Wright 2018).

    The terms and those of another training row are tried alike; what the other row's
    values gain is taken off, so a term without effect is centred on 0.
    """
    gains = grower(s, [Forest((mtry,), s.settings.trees, mtry)], True, corrected=True).gains()
    return _less_shadow(gains, []).withColumnRenamed("gain", "importance")


def permutation_p_values(s: Study, mtry: int, regression: bool = False) -> DataFrame:
    """(term, importance, p_value): importances against those of forests on permuted outcomes
    (Altmann and others 2010). All forests grow in one run; the outcome is permuted inside it.
    Regression uses the corrected importance."""
    g = s.settings
    models = [Forest((b,), g.trees, min(mtry, len(s.terms)), permutation=b) for b in range(g.permutations + 1)]
    gains = grower(s, models, regression, None if regression else g.share_node, ranked=True, corrected=regression).gains()
    if regression:
        gains = _less_shadow(gains, ["model"])
    gains = stage(gains, "gains")
    observed = gains.where("model = 0").select("term", F.col("gain").alias("importance"))
    null = gains.where("model > 0").select("term", F.col("gain").alias("importance"))
    return importance.p_values(observed, null, "term", "importance")


# Candidates ------------------------------------------------------------------

def boosting_errors(s: Study) -> list[tuple]:
    """(params, fold, training error, test error) of every rate and fold, all boosters in lock-step."""
    models = [Booster((r,), r, fold=k) for r in s.settings.rates for k in s.fold_numbers]
    return _boosted(s, models)


def _boosted(s: Study, models: Sequence[Booster]) -> list[tuple]:
    errors = booster_errors(_binned(s), models, s.settings.rounds, s.settings.boost_depth)
    rows = {r["model"]: r for r in errors.collect()}  # one row per booster
    return [(m.params, m.fold, rows[i]["train_error"], rows[i]["test_error"]) for i, m in enumerate(models)]


def tuned_boosting(s: Study) -> tuple[float, float]:
    """(best rate, its hold-out error)."""
    (rate,) = best_candidate(boosting_errors(s))
    return rate, _boosted(s, [Booster((rate,), rate)])[0][3]


# Support-vector machines and penalised logistic models: a grid and all its folds in one run.

KERNELS = ("linear", "radial", "polynomial")


def _machine(s: Study, kind: str, params: tuple, fold: int | None) -> Machine:
    parameter = 0.0 if kind == "linear" else float(params[0])
    return Machine(params, kind, parameter, float(params[-1]), fold)


def machine_params(s: Study, kind: str) -> list[tuple]:
    """(cost,), (gamma, cost) or (degree, cost) of every cell."""
    g = s.settings
    if kind == "linear":
        return [(c,) for c in g.linear_costs]
    values, costs = (g.gammas, g.radial_costs) if kind == "radial" else (g.degrees, g.poly_costs)
    return [(v, c) for v in values for c in costs]


def _fold_rows(models: Sequence, errors: DataFrame) -> list[tuple]:
    rows = {r["model"]: r for r in errors.collect()}  # one row per model
    return [(m.params, m.fold, rows[i]["train_error"], rows[i]["test_error"]) for i, m in enumerate(models)]


def machine_fold_errors(s: Study, kinds: Sequence[str]) -> dict[str, list[tuple]]:
    """(params, fold, training error, test error) of every cell and fold, by kernel."""
    models = [_machine(s, kind, p, k) for kind in kinds for p in machine_params(s, kind) for k in s.fold_numbers]
    rows = _fold_rows(models, machine_errors(s.table, s.outcome, s.terms, models))
    return {kind: [r for r, m in zip(rows, models) if m.kernel == kind] for kind in kinds}


def tuned_machines(s: Study, kinds: Sequence[str] = KERNELS) -> dict[str, tuple]:
    """(best parameters, hold-out error) by kernel; the winners are solved again on all training rows."""
    best = {kind: best_candidate(rows) for kind, rows in machine_fold_errors(s, kinds).items()}
    models = [_machine(s, kind, best[kind], None) for kind in kinds]
    errors = _fold_rows(models, machine_errors(s.table, s.outcome, s.terms, models))
    return {kind: (best[kind], row[3]) for kind, row in zip(kinds, errors)}


MIXINGS = {"ridge_logistic": 0.0, "lasso_logistic": 1.0}


def logistic_errors(s: Study, folds: Sequence[int | None]) -> dict[str, list[tuple]]:
    """((penalty,), fold, training error, test error) of every penalty and fold, by method."""
    models = [Penalised((p,), p, a, k) for a in MIXINGS.values() for p in s.settings.penalties for k in folds]
    rows = _fold_rows(models, logistic_paths(s.table, s.outcome, s.terms, models)[1])
    return {name: [r for r, m in zip(rows, models) if m.mixing == a] for name, a in MIXINGS.items()}


def tuned_logistic(s: Study) -> dict[str, tuple]:
    """(best penalty, hold-out error) by method, from one run over all folds and the whole training set."""
    out = {}
    for name, rows in logistic_errors(s, [None, *s.fold_numbers]).items():
        best = best_candidate([r for r in rows if r[1] is not None])
        out[name] = (best[0], next(r[3] for r in rows if r[1] is None and r[0] == best))
    return out


def penalised_errors(s: Study, ridge: tuple, lasso: tuple) -> dict[str, float]:
    """Hold-out squared errors of ridge and lasso at both penalty choices."""
    folds, test = linear.split_moments(s.table, s.outcome, s.terms, fold="path_fold")
    fits = linear.penalised_fits(folds, s.outcome, s.terms, ridge, lasso)
    return {name: fit.mse(test, s.outcome) for name, fit in fits.items()}


# Importances of these forests stand beside the leaderboards.
CLASS_IMPORTANCE, VALUE_IMPORTANCE = (12, 9), 6

def _board_rows(board: DataFrame) -> DataFrame:
    return board.select(
        F.lit("leaderboard").alias("part"), F.col("method").alias("name"), "metric", F.col("test_error").alias("value"),
        F.col("rank").cast("long").alias("ord"))


def _ranked_terms(found: DataFrame, part: str) -> DataFrame:
    """``found`` (name, metric, value) of one value a term, largest first within a metric."""
    order = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), "name")
    return found.select(F.lit(part).alias("part"), "name", "metric", "value", F.row_number().over(order).cast("long").alias("ord"))


def _importance_rows(found: DataFrame, kind: str) -> DataFrame:
    metric = F.concat(F.lit(f"{kind}_mtry_"), F.col("mtry").cast("string"))
    return _ranked_terms(found.select(F.col("term").alias("name"), metric.alias("metric"), F.col("importance").alias("value")), "importance")


def classification(s: Study) -> DataFrame:
    """Leaderboard of all classifiers and the importances beside it: ``part, name, metric, value, ord``.

    The linear probability fits carry a squared error, the others an error rate.
    """
    errors = {"logistic_model": s.refit(Candidate((), lambda n: logistic(s.outcome)))}
    errors |= {name: e for name, (_, e) in tuned_logistic(s).items()}
    _, errors["random_forest"], errors["bagged_classification"] = tuned_forest(s)
    errors["boosted_classification"] = tuned_boosting(s)[1]
    errors |= {f"svm_{kind}": e for kind, (_, e) in tuned_machines(s).items()}
    rows = [(m, MISCLASS, float(e)) for m, e in errors.items()]
    rows += [(m, MSE, float(e)) for m, e in penalised_errors(s, codes.RIDGE_GRID, codes.LASSO_CLASS_GRID).items()]
    results = s.table.sparkSession.createDataFrame(rows, "method string, metric string, test_error double")
    board = _board_rows(leaderboard(results, "test_error", "metric"))
    return board.unionByName(_importance_rows(importances(s, CLASS_IMPORTANCE), "gini"))


def regression(s: Study) -> DataFrame:
    """Leaderboard of all regressions, shares of explained variance, coefficients and importances:
    ``part, name, metric, value, ord``."""
    folds, test = linear.split_moments(s.table, s.outcome, s.terms, fold="path_fold")
    fits = {"ols_model": linear.ols(total(folds), s.outcome, s.terms)}
    found = linear.penalised_fits(folds, s.outcome, s.terms, codes.RIDGE_GRID, codes.LASSO_GRID)
    fits |= {m: found[m] for m in ("ridge_min", "lasso_min")}
    rows = [(m, MSE, fit.mse(test, s.outcome)) for m, fit in fits.items()]
    _, forest, bagged = tuned_forest(s, True)
    rows += [("random_forest", MSE, forest), ("bagged_regression", MSE, bagged)]
    spark = s.table.sparkSession
    results = spark.createDataFrame([(m, k, float(e)) for m, k, e in rows], "method string, metric string, test_error double")
    board = _board_rows(leaderboard(results, "test_error"))
    variance = float(test.cross[0, 0] / (test.n - 1))
    shares = linear.explained(results.select(F.col("method").alias("name"), "test_error"), "test_error", variance)
    shares = _ranked_terms(shares.select("name", F.lit("prop_var_explained").alias("metric"), F.col("prop_var_explained").alias("value")), "explained")
    weights = spark.createDataFrame(
        [(t, m, float(v)) for m, fit in fits.items() for t, v in zip(["(Intercept)", *fit.terms], [fit.intercept, *fit.coef])],
        "name string, metric string, value double")
    plain = _importance_rows(importances(s, [VALUE_IMPORTANCE], True), "variance")
    fair = corrected_importances(s, VALUE_IMPORTANCE).withColumn("mtry", F.lit(VALUE_IMPORTANCE))
    parts = [board, shares, _ranked_terms(weights, "coefficient"), plain, _importance_rows(fair, "corrected")]
    return reduce(DataFrame.unionByName, parts)
