"""Registered queries: resampling, correlation, the linear family, evaluation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.grids import log_grid
from ..functions.nulls import divide, zero_to_null
from ..functions.stats import mismatch_rate
from ..operators import cluster, correlation, evaluate, joins, linear, moments, resample
from ..operators.fitting import prepare
from ..session import stage
from . import codes, sql_linear
from .fixture import PREDICTORS, features, model_data
from .registry import MODEL_VIEWS, query, sql_draw
from .table_queries import sign_flip_test

# Hash order of the modelling rows, the exact split and the folds, in SQL.
SPLIT_VIEWS = MODEL_VIEWS + f""",
hashed AS (SELECT *, {sql_draw('entity_id', "'split'")} AS h_split, {sql_draw('entity_id', "'fold'")} AS h_fold,
                  count(*) OVER () AS n_all FROM model_data),
split AS (SELECT *, row_number() OVER (ORDER BY h_split, entity_id) <= CAST(round_even(n_all * 0.7, 0) AS BIGINT) AS is_train
          FROM hashed),
folds AS (SELECT entity_id, ntile(10) OVER (ORDER BY h_fold, entity_id) - 1 AS fold FROM split WHERE is_train),
train AS (SELECT s.*, f.fold FROM split s JOIN folds f ON s.entity_id = f.entity_id),
test AS (SELECT * FROM split WHERE NOT is_train)
"""


def _model(spark, folder, *names):
    """The modelling rows, written once: resampling reads them several times."""
    return stage(model_data(spark, folder).select("entity_id", *names), "model")


# Resampling ------------------------------------------------------------------

@query("exact_split", "SELECT entity_id, is_train FROM split", views=SPLIT_VIEWS)
def q_exact_split(spark, folder):
    return resample.exact_split(_model(spark, folder), "entity_id")


@query("split_complement", "SELECT entity_id, total_measure FROM test", views=SPLIT_VIEWS)
def q_split_complement(spark, folder):
    table = resample.exact_split(_model(spark, folder, "total_measure"), "entity_id")
    return joins.complement(table.drop("is_train"), table.where("is_train"), ["entity_id"])


@query("kfold_assign", "SELECT entity_id, CAST(ntile(10) OVER (ORDER BY h_fold, entity_id) - 1 AS INTEGER) AS fold FROM split",
       views=SPLIT_VIEWS)
def q_kfold_assign(spark, folder):
    return resample.assign_folds(_model(spark, folder), "entity_id", 10)


@query("permute_outcome", f"""
+base AS (SELECT total_measure, n_lines, row_number() OVER (ORDER BY {sql_draw('entity_id', "'base'")}, entity_id) AS r FROM model_data),
target AS (SELECT d.draw, entity_id,
                  row_number() OVER (PARTITION BY d.draw ORDER BY {sql_draw('entity_id', 'd.draw')}, entity_id) AS r
           FROM model_data, (VALUES ('perm0'), ('perm1'), ('perm2')) d(draw))
SELECT t.draw, t.entity_id, b.total_measure, b.n_lines FROM target t JOIN base b ON t.r = b.r""", views=MODEL_VIEWS)
def q_permute_outcome(spark, folder):
    table = _model(spark, folder, "total_measure", "n_lines")
    return resample.permute_columns(table, "entity_id", ["total_measure", "n_lines"], ["perm0", "perm1", "perm2"])


@query("permute_labels", f"""
+r AS (SELECT entity_id, row_number() OVER (ORDER BY {sql_draw('entity_id', "'perm0'")}, entity_id) AS r,
              count(*) FILTER (WHERE unanimous_flag = 0) OVER () AS zeros FROM model_data)
SELECT entity_id, CASE WHEN r <= zeros THEN 0 ELSE 1 END AS unanimous_flag FROM r""", views=MODEL_VIEWS)
def q_permute_labels(spark, folder):
    table = _model(spark, folder, "unanimous_flag")
    moved = resample.permuted_labels(table, "entity_id", "unanimous_flag", ["perm0"])
    return table.withColumn("unanimous_flag", moved["perm0"])


# Correlation -----------------------------------------------------------------

POPULATIONS = {
    "all": "true", "few_actions": "total_actions < 6", "below_400m": "total_measure < 400000000",
    "below_350m": "total_measure < 350000000",
}
TARGETS = ["action_flag", "unanimous_flag"]
COMPLETE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in PREDICTORS)
LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS term, CAST({c} AS DOUBLE) AS x, action_flag, unanimous_flag, total_actions, total_measure, "
    f"({COMPLETE_SQL}) AS complete FROM features" for c in PREDICTORS) + ")"


def _corr_sql(target: str, where: str) -> str:
    r = f"corr(x, CAST({target} AS DOUBLE)) FILTER (WHERE x IS NOT NULL AND {target} IS NOT NULL AND {where})"
    return f"CASE WHEN NOT isnan({r}) THEN round({r}, 6) END"


def _rounded(df, column="r"):
    return df.withColumn(column, F.round(column, 6))


@query("corr_pairwise", f"+{LONG_SQL} SELECT term, {_corr_sql('action_flag', 'true')} AS r FROM long GROUP BY term",
       views=MODEL_VIEWS)
def q_corr_pairwise(spark, folder):
    return _rounded(correlation.correlate(features(spark, folder), ["action_flag"], PREDICTORS).select("term", "r"))


@query("corr_listwise", f"+{LONG_SQL} SELECT term, {_corr_sql('action_flag', 'complete')} AS r FROM long GROUP BY term",
       views=MODEL_VIEWS)
def q_corr_listwise(spark, folder):
    out = correlation.correlate(
        features(spark, folder), ["action_flag"], PREDICTORS, modes=[correlation.LISTWISE]
    )
    return _rounded(out.select("term", "r"))


@query("corr_focus", f"""+{LONG_SQL}, c AS (SELECT term, {_corr_sql('action_flag', 'complete')} AS r FROM long GROUP BY term)
SELECT term, r, row_number() OVER (ORDER BY r NULLS LAST, term) AS ord FROM c""", views=MODEL_VIEWS)
def q_corr_focus(spark, folder):
    return _rounded(correlation.focus(features(spark, folder), "action_flag", PREDICTORS, listwise=True))


@query("corr_grid", f"+{LONG_SQL} " + " UNION ALL ".join(
    f"SELECT '{p}' AS population, '{t}' AS target, '{m}' AS na_mode, term, "
    f"{_corr_sql(t, cond + (' AND complete' if m == 'listwise' else ''))} AS r FROM long GROUP BY term"
    for p, cond in POPULATIONS.items() for t in TARGETS for m in ("pairwise", "listwise")), views=MODEL_VIEWS)
def q_corr_grid(spark, folder):
    populations = {name: F.expr(cond) for name, cond in POPULATIONS.items()}
    modes = [correlation.PAIRWISE, correlation.LISTWISE]
    return _rounded(correlation.correlate(features(spark, folder), TARGETS, PREDICTORS, populations, modes))


MATRIX_COLUMNS = ["total_measure", "action_flag", *[c for c in PREDICTORS if c != "total_measure"]]


@query("corr_matrix", "+" + "c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS term_i, '{b}' AS term_j, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM model_data"
    for a in MATRIX_COLUMNS for b in MATRIX_COLUMNS) + """)
SELECT term_i, term_j, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS r FROM c""", views=MODEL_VIEWS)
def q_corr_matrix(spark, folder):
    return _rounded(correlation.correlation_matrix(stage(features(spark, folder).select(*MATRIX_COLUMNS)), MATRIX_COLUMNS))


VIF_TERMS = ["action_flag", *[c for c in PREDICTORS if c != "total_measure"]]


@query("vif", f"+{sql_linear.inflation(VIF_TERMS, 'model_data')} SELECT term, round(vif, 6) AS vif FROM vif", views=MODEL_VIEWS,
       recursive=True)
def q_vif(spark, folder):
    return _rounded(correlation.variance_inflation(stage(model_data(spark, folder).select(*VIF_TERMS)), VIF_TERMS), "vif")


@query("vif_pair", """
+r AS (SELECT corr(n_lines, n_suppliers) AS r FROM model_data)
SELECT t.term, round(1 / (1 - r * r), 6) AS vif FROM r, (VALUES ('n_lines'), ('n_suppliers')) t(term)""", views=MODEL_VIEWS)
def q_vif_pair(spark, folder):
    terms = ["n_lines", "n_suppliers"]
    return _rounded(correlation.variance_inflation(stage(model_data(spark, folder).select(*terms)), terms), "vif")


# Linear family ---------------------------------------------------------------

SCALED = {"measure_m": "total_measure / 1e6", "lines": "CAST(n_lines AS DOUBLE)", "qty": "avg_qty"}


def _scaled(df):
    return df.withColumns({
        "measure_m": F.col("total_measure") / F.lit(1e6), "lines": F.col("n_lines").cast("double"), "qty": F.col("avg_qty")
    })


def _prepared(spark, folder, *names):
    return prepare(model_data(spark, folder), "entity_id", list(dict.fromkeys(names)))


@query("gram_by_fold", "+m AS (SELECT CAST(fold AS INTEGER) AS fold, " + ", ".join(
    f"{e} AS {n}" for n, e in SCALED.items()) + " FROM train) " + " UNION ALL ".join(
    f"SELECT fold, count(*) AS n, '{a}' AS term_i, '{b}' AS term_j, round(covar_pop({a}, {b}), 6) AS covariance FROM m GROUP BY fold"
    for i, a in enumerate(SCALED) for b in list(SCALED)[i:]), views=SPLIT_VIEWS)
def q_gram_by_fold(spark, folder):
    table = _scaled(_prepared(spark, folder, "total_measure", "n_lines", "avg_qty").where("is_train"))
    return _rounded(moments.moments_table(table, list(SCALED), "fold"), "covariance")


@query("ols_simple", """
+m AS (SELECT is_train, total_measure / 1e6 AS y, CAST(n_lines AS DOUBLE) AS x FROM split),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m WHERE is_train),
v AS (SELECT var_samp(y) AS v FROM m WHERE NOT is_train),
e AS (SELECT avg((y - a - b * x) * (y - a - b * x)) AS e FROM m, f WHERE NOT is_train)
SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(e, 5) AS test_error, round(1 - e / v, 6) AS prop_var_explained,
       round(e / v, 6) AS prop_var_unexplained
FROM f, v, e""", views=SPLIT_VIEWS)
def q_ols_simple(spark, folder):
    table = _scaled(_prepared(spark, folder, "total_measure", "n_lines", "avg_qty"))
    folds, test = linear.split_moments(table, "measure_m", ["lines"])
    fit = linear.ols(moments.total(folds), "measure_m", ["lines"])
    variance = float(test.cross[0, 0] / (test.n - 1))
    row = spark.createDataFrame(
        [(fit.intercept, float(fit.coef[0]), fit.mse(test, "measure_m"))], "intercept double, slope double, test_error double"
    )
    out = linear.explained(row, "test_error", variance)
    return out.select(
        F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"),
        F.round("test_error", 5).alias("test_error"), F.round("prop_var_explained", 6).alias("prop_var_explained"),
        F.round("prop_var_unexplained", 6).alias("prop_var_unexplained"),
    )


@query("ols_pair", """
+m AS (SELECT total_measure / 1e6 AS y, CAST(n_lines AS DOUBLE) AS x1, avg_qty AS x2 FROM train),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22,
             covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y,
             var_pop(y) * count(*) AS syy FROM m),
d AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS sig FROM d)
SELECT '(Intercept)' AS term, round(b0, 5) AS estimate,
       round(sqrt(sig * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 5) AS std_error FROM e
UNION ALL SELECT 'lines', round(b1, 5), round(sqrt(sig * s22 / det), 5) FROM e
UNION ALL SELECT 'qty', round(b2, 5), round(sqrt(sig * s11 / det), 5) FROM e""", views=SPLIT_VIEWS)
def q_ols_pair(spark, folder):
    table = _scaled(_prepared(spark, folder, "total_measure", "n_lines", "avg_qty"))
    folds, _ = linear.split_moments(table, "measure_m", ["lines", "qty"])
    rows = linear.ols_table(moments.total(folds), "measure_m", ["lines", "qty"])
    out = linear.coefficient_table(rows, spark)
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


# The regression outcome in millions, and its predictors with either flag.
REGRESSION_TERMS = VIF_TERMS
OUTCOME = "measure_m"


def _regression(spark, folder):
    """Moments of the training folds and of the hold-out rows."""
    table = _scaled(_prepared(spark, folder, "total_measure", *REGRESSION_TERMS))
    return linear.split_moments(table, OUTCOME, REGRESSION_TERMS)


LEAST_SQUARES = "+" + ",\n".join([
    sql_linear.scaled_rows("split", "total_measure / 1e6", VIF_TERMS, ["is_train"]),
    sql_linear.least_squares(len(VIF_TERMS), "is_train"),
])


@query("ols_holdout", LEAST_SQUARES + f""",
e AS (SELECT avg(pow(y - ({sql_linear.score(len(VIF_TERMS))}), 2)) AS e FROM z, fit WHERE NOT is_train),
v AS (SELECT var_samp(y) AS v FROM x WHERE NOT is_train)
SELECT 'ols_model' AS method, round(e, 5) AS test_error, round(1 - e / v, 6) AS prop_var_explained,
       round(e / v, 6) AS prop_var_unexplained FROM e, v""", views=SPLIT_VIEWS, recursive=True)
def q_ols_holdout(spark, folder):
    folds, test = _regression(spark, folder)
    fit = linear.ols(moments.total(folds), OUTCOME, REGRESSION_TERMS)
    row = spark.createDataFrame([("ols_model", fit.mse(test, OUTCOME))], "method string, test_error double")
    return _rounded_errors(linear.explained(row, "test_error", float(test.cross[0, 0] / (test.n - 1))))


def _rounded_errors(df):
    digits = {"test_error": 5, "prop_var_explained": 6, "prop_var_unexplained": 6}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("ols_coef_table", LEAST_SQUARES + f""",
{sql_linear.coefficients(VIF_TERMS, 'is_train')},
df AS (SELECT count(*) - {len(VIF_TERMS) + 1} AS df FROM train),
p AS (SELECT term, b, se, b / se AS t, {sql_linear.student_two_sided('(b / se)', 'df')} AS p FROM coef, df)
SELECT term, round(b, 5) AS estimate, round(se, 5) AS std_error, round(t, 5) AS statistic, abs(round(p, 6)) AS p_value,
       CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' WHEN p <= 0.1 THEN '.' ELSE ' ' END AS signif
FROM p""", views=SPLIT_VIEWS, recursive=True)
def q_ols_coef_table(spark, folder):
    folds, _ = _regression(spark, folder)
    rows = linear.ols_table(moments.total(folds), OUTCOME, REGRESSION_TERMS)
    out = linear.coefficient_table(rows, spark)
    digits = {"estimate": 5, "std_error": 5, "statistic": 5, "p_value": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _choice_frame(spark, choice):
    rows = [
        (i, math.log10(g), float(e), float(s), g == choice.at_min, g == choice.at_one_se)
        for i, (g, e, s) in enumerate(zip(choice.grid, choice.error, choice.spread))
    ]
    schema = "grid_index long, log_penalty double, cv_error double, cv_se double, is_min boolean, is_one_se boolean"
    return spark.createDataFrame(rows, schema)


def _one_predictor_sql(alpha: int) -> str:
    shrunk = "r / (1 + g / sy)" if alpha == 0 else "sign(r) * greatest(abs(r) - g / sy, 0)"
    return f"""
+m AS (SELECT fold, total_measure / 1e6 AS y, CAST(n_lines AS DOUBLE) AS x FROM train),
k AS (SELECT DISTINCT fold FROM m),
s AS (SELECT k.fold, avg(y) AS my, avg(x) AS mx, stddev_pop(y) AS sy, stddev_pop(x) AS sx, corr(x, y) AS r
      FROM k JOIN m ON m.fold <> k.fold GROUP BY k.fold),
g AS (SELECT i, pow(10, -2 + 4 * i / 19.0) AS g FROM range(20) t(i)),
b AS (SELECT i, fold, my, mx, {shrunk} * sy / sx AS b FROM s, g),
e AS (SELECT b.i, b.fold, count(*) AS n, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS e
      FROM b JOIN m ON m.fold = b.fold GROUP BY b.i, b.fold),
c AS (SELECT i, sum(n * e) / sum(n) AS cv FROM e GROUP BY i),
q AS (SELECT c.i, cv, sqrt(sum(n * (e - cv) * (e - cv)) / sum(n) / 9) AS se FROM c JOIN e ON e.i = c.i GROUP BY c.i, cv),
best AS (SELECT min(cv) AS low, arg_min(cv + se, cv) AS line FROM q)
SELECT q.i AS grid_index, round(-2 + 4 * q.i / 19.0, 6) AS log_penalty, round(cv, 5) AS cv_error, round(se, 5) AS cv_se,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= low) AS is_min,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= line) AS is_one_se
FROM q"""


def _one_predictor(spark, folder, alpha):
    table = _scaled(_prepared(spark, folder, "total_measure", "n_lines", "avg_qty"))
    folds, _ = linear.split_moments(table, "measure_m", ["lines"])
    out = _choice_frame(spark, linear.choose_penalty(folds, "measure_m", ["lines"], alpha, log_grid(-2, 2, 20)))
    return out.withColumns({
        "log_penalty": F.round("log_penalty", 6), "cv_error": F.round("cv_error", 5), "cv_se": F.round("cv_se", 5)
    })


@query("ridge_one", _one_predictor_sql(0), views=SPLIT_VIEWS)
def q_ridge_one(spark, folder):
    return _one_predictor(spark, folder, 0)


@query("lasso_one", _one_predictor_sql(1), views=SPLIT_VIEWS)
def q_lasso_one(spark, folder):
    return _one_predictor(spark, folder, 1)


def _path(spark, folder, alpha, grid):
    folds, _ = _regression(spark, folder)
    return _choice_frame(spark, linear.choose_penalty(folds, OUTCOME, REGRESSION_TERMS, alpha, log_grid(*grid)))


@query("ridge_cv", "+" + sql_linear.scaled_rows("train", "total_measure / 1e6", VIF_TERMS, ["fold"]) + ","
       + sql_linear.ridge_folds(len(VIF_TERMS), *codes.RIDGE_GRID) + """,
best AS (SELECT min(cv) AS low, arg_min(cv + se, cv) AS line FROM q)
SELECT q.i AS grid_index, round(-2 + 12 * q.i / 199.0, 6) AS log_penalty, round(cv, 4) AS cv_error, round(se, 4) AS cv_se,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= low) AS is_min,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= line) AS is_one_se
FROM q""", views=SPLIT_VIEWS, recursive=True)
def q_ridge_cv(spark, folder):
    out = _path(spark, folder, 0, codes.RIDGE_GRID)
    return out.withColumns({
        "log_penalty": F.round("log_penalty", 6), "cv_error": F.round("cv_error", 4), "cv_se": F.round("cv_se", 4)
    })


@query("lasso_cv", "+" + sql_linear.scaled_rows("train", "total_measure / 1e6", VIF_TERMS, ["fold"]) + ","
       + sql_linear.lasso_folds(len(VIF_TERMS), *codes.LASSO_GRID) + """,
best AS (SELECT min(cv) AS low, arg_min(cv + se, cv) AS line FROM q)
SELECT q.i AS grid_index, round(-3 + 6 * q.i / 199.0, 6) AS log_penalty, round(cv, 2) AS cv_error, round(se, 2) AS cv_se,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= low) AS is_min,
       q.i = (SELECT max(i) FROM q, best WHERE cv <= line) AS is_one_se
FROM q""", views=SPLIT_VIEWS, recursive=True)
def q_lasso_cv(spark, folder):
    out = _path(spark, folder, 1, codes.LASSO_GRID)
    return out.withColumns({
        "log_penalty": F.round("log_penalty", 6), "cv_error": F.round("cv_error", 2), "cv_se": F.round("cv_se", 2)
    })


LASSO_PENALTIES = [0.5, 2.0, 10.0]
LASSO_SQL = "+" + ",\n".join([
    sql_linear.scaled_rows("split", "total_measure / 1e6", VIF_TERMS, ["is_train"]),
    sql_linear.lasso(len(VIF_TERMS), "is_train", LASSO_PENALTIES),
])


@query("lasso_fit", LASSO_SQL + " " + " UNION ALL ".join(
    f"SELECT g AS penalty, '{t}' AS term, round(b[{i + 1}] * sy / s{i}, 5) AS coef FROM lasso, st"
    for i, t in enumerate(VIF_TERMS)), views=SPLIT_VIEWS, recursive=True)
def q_lasso_fit(spark, folder):
    whole = moments.total(_regression(spark, folder)[0])
    fits = {g: linear.fit_at(whole, OUTCOME, REGRESSION_TERMS, 1, g) for g in LASSO_PENALTIES}
    rows = [(g, t, float(b)) for g, fit in fits.items() for t, b in zip(fit.terms, fit.coef)]
    return _rounded_to(spark.createDataFrame(rows, "penalty double, term string, coef double"), "coef", 5)


@query("lasso_holdout", LASSO_SQL + f"""
SELECT g AS penalty, round(avg(pow(y - ({sql_linear.lasso_score(len(VIF_TERMS))}), 2)), 4) AS test_error
FROM x, st, lasso WHERE NOT is_train GROUP BY g""", views=SPLIT_VIEWS, recursive=True)
def q_lasso_holdout(spark, folder):
    """Errors at given penalties from the hold-out moments alone."""
    folds, test = _regression(spark, folder)
    whole = moments.total(folds)
    rows = [(g, linear.fit_at(whole, OUTCOME, REGRESSION_TERMS, 1, g).mse(test, OUTCOME)) for g in LASSO_PENALTIES]
    return _rounded_to(spark.createDataFrame(rows, "penalty double, test_error double"), "test_error", 4)


def _penalised(spark, folder):
    folds, test = _regression(spark, folder)
    return linear.penalised_fits(folds, OUTCOME, REGRESSION_TERMS, codes.RIDGE_GRID, codes.LASSO_GRID), test


SPLIT_ROWS = sql_linear.scaled_rows(
    "split s LEFT JOIN folds f ON s.entity_id = f.entity_id", "total_measure / 1e6", VIF_TERMS, ["fold", "is_train"])
PENALISED_SQL = "+" + sql_linear.penalised(len(VIF_TERMS), SPLIT_ROWS, "is_train", codes.RIDGE_GRID, codes.LASSO_GRID)


@query("penalised_holdout", PENALISED_SQL + f""",
errors AS (SELECT method, avg(pow(y - ({sql_linear.lasso_score(len(VIF_TERMS))}), 2)) AS e, var_samp(y) AS v
           FROM x, st, fits WHERE NOT is_train GROUP BY method)
SELECT method, round(e, 4) AS test_error, round(1 - e / v, 6) AS prop_var_explained, round(e / v, 6) AS prop_var_unexplained
FROM errors""", views=SPLIT_VIEWS, recursive=True)
def q_penalised_holdout(spark, folder):
    """Both penalties at both choices, errors from the hold-out moments."""
    fits, test = _penalised(spark, folder)
    rows = [(name, fit.mse(test, OUTCOME)) for name, fit in fits.items()]
    out = spark.createDataFrame(rows, "method string, test_error double")
    out = linear.explained(out, "test_error", float(test.cross[0, 0] / (test.n - 1)))
    shares = ["prop_var_explained", "prop_var_unexplained"]
    return out.withColumns({"test_error": F.round("test_error", 4), **{c: F.round(c, 6) for c in shares}})


def _coef_sql() -> str:
    """Coefficients in the units of the predictors, exact zeros as NULL."""
    own = [f"b[{i + 1}] * sy / s{i}" for i in range(len(VIF_TERMS))]
    start = "my - (" + " + ".join(f"{c} * a{i}" for i, c in enumerate(own)) + ")"
    rows = " UNION ALL ".join(
        f"SELECT method, '{name}' AS name, {c} AS c FROM fits, st" for name, c in zip(["(Intercept)", *VIF_TERMS], [start, *own])
    )
    cells = ", ".join(
        f"nullif(round(max(c) FILTER (WHERE method = '{m}'), 4), 0) AS {m}" for m in ("ridge_min", "ridge_1se", "lasso_min", "lasso_1se")
    )
    return f", long AS ({rows}) SELECT name, {cells} FROM long GROUP BY name"


@query("penalised_coef", PENALISED_SQL + _coef_sql(), views=SPLIT_VIEWS, recursive=True)
def q_penalised_coef(spark, folder):
    """Coefficients of the four penalised fits side by side; what rounds to 0 is NULL."""
    fits, _ = _penalised(spark, folder)
    frame = linear.coefficient_frame(spark, fits)
    return frame.withColumns({m: F.nullif(F.round(m, 4), F.lit(0.0)) for m in fits})


GIVEN = linear.LinearFit(("lines", "qty"), -20.0, np.array([5.5, 1.25]))


@query("linear_score", """
SELECT entity_id, round(-20 + 5.5 * n_lines + 1.25 * avg_qty, 6) AS score FROM model_data""", views=MODEL_VIEWS)
def q_linear_score(spark, folder):
    return _scaled(model_data(spark, folder)).select("entity_id", F.round(GIVEN.score(), 6).alias("score"))


@query("holdout_given_coef", """
SELECT is_train, count(*) AS n, round(avg(pow(total_measure / 1e6 - (-20 + 5.5 * n_lines + 1.25 * avg_qty), 2)), 5) AS mse
FROM split GROUP BY is_train""", views=SPLIT_VIEWS)
def q_holdout_given_coef(spark, folder):
    """Errors of given coefficients from the moments of each part alone."""
    table = _scaled(_prepared(spark, folder, "total_measure", "n_lines", "avg_qty"))
    parts = moments.moments_by(table, ["measure_m", "lines", "qty"], "is_train")
    rows = [(k, m.n, GIVEN.mse(m, "measure_m")) for k, m in parts.items()]
    return _rounded_to(spark.createDataFrame(rows, "is_train boolean, n long, mse double"), "mse", 5)


def _rounded_to(df, column, digits):
    return df.withColumn(column, F.round(column, digits))


@query("coef_compare", f"""
+{LONG_SQL}, c AS (SELECT term, corr(x, CAST(action_flag AS DOUBLE)) FILTER (WHERE complete) AS r FROM long GROUP BY term)
SELECT term AS name, nullif(round(sign(r) * greatest(abs(r) - 0.02, 0), 6), 0) AS weak,
       nullif(round(sign(r) * greatest(abs(r) - 0.1, 0), 6), 0) AS strong FROM c""", views=MODEL_VIEWS)
def q_coef_compare(spark, folder):
    """Univariate lasso coefficients at two penalties, joined by name."""
    r = correlation.correlate(features(spark, folder), ["action_flag"], PREDICTORS, modes=[correlation.LISTWISE])

    def fit(penalty, name):
        b = F.signum("r") * F.greatest(F.abs("r") - F.lit(penalty), F.lit(0.0))
        return r.select(F.col("term").alias("name"), zero_to_null(F.round(b, 6)).alias("b")).withColumnRenamed("b", name)

    return joins.full_join_all([fit(0.02, "weak"), fit(0.1, "strong")], "name")


# Evaluation ------------------------------------------------------------------

RULES = [20, 22, 24, 25, 26, 28, 30]
RULE_ROWS = ", ".join(f"({t})" for t in RULES)


@query("threshold_predict", """
+p AS (SELECT action_flag, 1 / (1 + exp(-(-1 + 0.02 * n_lines + 0.03 * avg_qty))) AS p FROM test)
SELECT count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) <> action_flag THEN 1 ELSE 0 END) AS BIGINT) AS wrong,
       round(avg(CASE WHEN (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) <> action_flag THEN 1.0 ELSE 0.0 END), 9) AS error_rate
FROM p""", views=SPLIT_VIEWS)
def q_threshold_predict(spark, folder):
    table = resample.exact_split(_model(spark, folder, "n_lines", "avg_qty", "action_flag"), "entity_id").where("not is_train")
    p = 1 / (1 + F.exp(-(F.lit(-1.0) + 0.02 * F.col("n_lines") + 0.03 * F.col("avg_qty"))))
    guessed = table.withColumn("guess", evaluate.above(p))
    return guessed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") != F.col("action_flag")).alias("wrong"),
        F.round(mismatch_rate("action_flag", "guess"), 9).alias("error_rate"),
    )


def _rule_errors(spark, folder):
    table = _prepared(spark, folder, "avg_qty", "action_flag").where("is_train")
    guesses = F.array(*[
        F.struct(F.lit(t).alias("rule"), (evaluate.above("avg_qty", t) != F.col("action_flag")).cast("double").alias("miss"))
        for t in RULES
    ])
    long = table.select("fold", F.inline(guesses))
    return long.groupBy("rule", "fold").agg(F.avg("miss").alias("test_misclass"))


RULE_SQL = f"""
+f AS (SELECT v.t AS rule, fold, avg(CASE WHEN (CASE WHEN avg_qty > v.t THEN 1 ELSE 0 END) <> action_flag THEN 1.0 ELSE 0.0 END) AS e
       FROM train, (VALUES {RULE_ROWS}) v(t) GROUP BY 1, 2),
c AS (SELECT rule, avg(e) AS e FROM f GROUP BY rule)"""


@query("cv_error_summary", RULE_SQL + " SELECT rule, round(e, 9) AS test_misclass FROM c", views=SPLIT_VIEWS)
def q_cv_error_summary(spark, folder):
    out = evaluate.summarise_folds(_rule_errors(spark, folder), ["rule"], ["test_misclass"])
    return _rounded_to(out, "test_misclass", 9).orderBy("test_misclass", "rule")


@query("best_params", RULE_SQL + " SELECT rule, round(e, 9) AS test_misclass FROM c ORDER BY round(e, 9), rule LIMIT 1",
       views=SPLIT_VIEWS)
def q_best_params(spark, folder):
    summary = evaluate.summarise_folds(_rule_errors(spark, folder), ["rule"], ["test_misclass"])
    return evaluate.best_parameters(_rounded_to(summary, "test_misclass", 9), ["rule"], "test_misclass")


@query("outcome_variance", """
SELECT is_train, round(var_samp(total_measure / 1e6), 5) AS variance FROM split GROUP BY is_train""", views=SPLIT_VIEWS)
def q_outcome_variance(spark, folder):
    table = resample.exact_split(_model(spark, folder, "total_measure"), "entity_id")
    return table.groupBy("is_train").agg(F.round(F.var_samp(F.col("total_measure") / F.lit(1e6)), 5).alias("variance"))


GUESS_SQL = "+g AS (SELECT action_flag, CASE WHEN avg_qty > 25 THEN 1 ELSE 0 END AS guess FROM test)"


def _guessed(spark, folder):
    table = resample.exact_split(_model(spark, folder, "avg_qty", "action_flag"), "entity_id").where("not is_train")
    return table.withColumn("guess", evaluate.above("avg_qty", 25))


@query("misclass_rate", GUESS_SQL + """
SELECT round(avg(CASE WHEN guess <> action_flag THEN 1.0 ELSE 0.0 END), 9) AS test_misclass FROM g""", views=SPLIT_VIEWS)
def q_misclass_rate(spark, folder):
    return _guessed(spark, folder).agg(
        F.round(evaluate.error("action_flag", "guess", evaluate.MISCLASS), 9).alias("test_misclass")
    )


@query("confusion_matrix", GUESS_SQL + """
SELECT action_flag AS truth, count(CASE WHEN guess = 0 THEN 1 END) AS pred_0, count(CASE WHEN guess = 1 THEN 1 END) AS pred_1
FROM g GROUP BY action_flag""", views=SPLIT_VIEWS)
def q_confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_guessed(spark, folder), "action_flag", "guess", [0, 1])


@query("accuracy_from_cm", GUESS_SQL + """
SELECT round(avg(CASE WHEN guess = action_flag THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       round(avg(CASE WHEN guess <> action_flag THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM g""", views=SPLIT_VIEWS)
def q_accuracy_from_cm(spark, folder):
    out = evaluate.accuracy_from_matrix(q_confusion_matrix(spark, folder), [0, 1])
    return _rounded_to(_rounded_to(out, "accuracy", 9), "error_rate", 9)


def _tail(k: str, p: str) -> str:
    """P(X >= k) for X ~ Binomial(n, p) in SQL."""
    return (f"list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) "
            f"+ i * ln({p}) + (n - i) * ln(1 - {p}))))")


@query("accuracy_ci", GUESS_SQL + f""",
c AS (SELECT count(*) AS n, count(CASE WHEN guess = action_flag THEN 1 END) AS k,
             greatest(count(CASE WHEN action_flag = 0 THEN 1 END), count(CASE WHEN action_flag = 1 THEN 1 END)) AS m FROM g),
steps(n, k, m, step, lo1, hi1, lo2, hi2) AS (
  SELECT n, k, m, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM c
  UNION ALL
  SELECT n, k, m, step + 1,
    CASE WHEN {_tail('k', '((lo1 + hi1) / 2)')} < 0.025 THEN (lo1 + hi1) / 2 ELSE lo1 END,
    CASE WHEN {_tail('k', '((lo1 + hi1) / 2)')} < 0.025 THEN hi1 ELSE (lo1 + hi1) / 2 END,
    CASE WHEN {_tail('k + 1', '((lo2 + hi2) / 2)')} < 0.975 THEN (lo2 + hi2) / 2 ELSE lo2 END,
    CASE WHEN {_tail('k + 1', '((lo2 + hi2) / 2)')} < 0.975 THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM steps WHERE step < 50)
SELECT n, round(k / n, 9) AS estimate, round(lo1, 6) AS conf_low, round(hi2, 6) AS conf_high, round(m / n, 9) AS base_rate,
       round({_tail('k', '(m / n)')}, 6) AS p_value FROM steps WHERE step = 50""", views=SPLIT_VIEWS, recursive=True)
def q_accuracy_ci(spark, folder):
    out = evaluate.accuracy_row(_guessed(spark, folder), "action_flag", "guess")
    for name, digits in {"estimate": 9, "conf_low": 6, "conf_high": 6, "base_rate": 9, "p_value": 6}.items():
        out = _rounded_to(out, name, digits)
    return out


SIMPLE_SQL = """
+m AS (SELECT is_train, total_measure / 1e6 AS y, CAST(n_lines AS DOUBLE) AS x FROM split),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS c FROM m WHERE is_train),
v AS (SELECT var_samp(y) AS v FROM m WHERE NOT is_train),
e AS (SELECT 'mean' AS method, avg((y - c) * (y - c)) AS e FROM m, f WHERE NOT is_train
      UNION ALL SELECT 'slope', avg((y - a - b * x) * (y - a - b * x)) FROM m, f WHERE NOT is_train)"""


def _simple_errors(spark, folder):
    """Errors of the training mean and of one slope, in one pass each over training and test rows."""
    table = _scaled(resample.exact_split(_model(spark, folder, "total_measure", "n_lines", "avg_qty"), "entity_id"))
    f = table.where("is_train").agg(
        F.regr_slope("measure_m", "lines").alias("b"), F.regr_intercept("measure_m", "lines").alias("a"),
        F.avg("measure_m").alias("c"),
    ).first()
    guesses = {"mean": F.lit(f["c"]), "slope": F.lit(f["a"]) + F.lit(f["b"]) * F.col("lines")}
    return table.where("not is_train").agg(
        F.var_samp("measure_m").alias("v"),
        *[evaluate.error("measure_m", g, evaluate.MSE).alias(m) for m, g in guesses.items()],
    ).unpivot(["v"], list(guesses), "method", "test_error")


@query("mse", SIMPLE_SQL + " SELECT method, round(e, 5) AS test_error FROM e", views=SPLIT_VIEWS)
def q_mse(spark, folder):
    return _simple_errors(spark, folder).select("method", F.round("test_error", 5).alias("test_error"))


@query("variance_explained", SIMPLE_SQL + """
SELECT method, round(1 - e / v, 6) AS prop_var_explained, round(e / v, 6) AS prop_var_unexplained FROM e, v""", views=SPLIT_VIEWS)
def q_variance_explained(spark, folder):
    share = divide("test_error", "v")
    return _simple_errors(spark, folder).select(
        "method", F.round(1 - share, 6).alias("prop_var_explained"), F.round(share, 6).alias("prop_var_unexplained")
    )


@query("pvalue_from_null", f"""
+d AS (SELECT entity_id, segment, CAST(round(wealth * 100) AS BIGINT) - 450000 AS w FROM entity WHERE wealth IS NOT NULL AND segment IS NOT NULL),
obs AS (SELECT segment, abs(sum(w)) AS s FROM d GROUP BY 1),
flips AS (SELECT segment, b, abs(sum(CASE WHEN {sql_draw('entity_id', "('flip' || CAST(b AS VARCHAR))")} % 2 = 0 THEN w ELSE -w END)) AS s
          FROM d, range(99) g(b) GROUP BY 1, 2)
SELECT o.segment, CAST(o.s AS BIGINT) AS s, round((1 + count(CASE WHEN f.s >= o.s THEN 1 END)) / 100.0, 6) AS p_value
FROM obs o JOIN flips f ON o.segment = f.segment GROUP BY 1, 2""", views=MODEL_VIEWS)
def q_pvalue_from_null(spark, folder):
    return _rounded_to(sign_flip_test(spark, folder, "segment"), "p_value", 6)


# Clustering with given centres -----------------------------------------------

CLUSTER_COLUMNS = ["wealth_k", "lines", "qty"]
CENTRE_SQL = """
+m AS (SELECT entity_id, segment_code, wealth / 1000 AS wealth_k, CAST(n_lines AS DOUBLE) AS lines, avg_qty AS qty FROM model_data),
c AS (SELECT segment_code AS i, round(avg(wealth_k), 6) AS a, round(avg(lines), 6) AS b, round(avg(qty), 6) AS q FROM m GROUP BY 1),
d AS (SELECT m.*, c.i, (wealth_k - a) * (wealth_k - a) + (lines - b) * (lines - b) + (qty - q) * (qty - q) AS dist FROM m, c),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY dist, i) AS rn FROM d)"""


def _cluster_input(spark, folder):
    table = stage(_scaled(model_data(spark, folder)).select(
        "entity_id", "segment_code", (F.col("wealth") / 1000).alias("wealth_k"), "lines", "qty"
    ), "cluster")
    means = table.groupBy("segment_code").agg(*[F.round(F.avg(c), 6).alias(c) for c in CLUSTER_COLUMNS])
    centres = np.array([[r[c] for c in CLUSTER_COLUMNS] for r in means.orderBy("segment_code").collect()])  # one per segment
    return table, centres


@query("kmeans_assign", CENTRE_SQL + """
SELECT entity_id, CAST(i AS INTEGER) AS cluster, round(dist, 6) AS distance2 FROM n WHERE rn = 1""", views=MODEL_VIEWS)
def q_kmeans_assign(spark, folder):
    table, centres = _cluster_input(spark, folder)
    out = cluster.assign(table, CLUSTER_COLUMNS, centres).select("entity_id", "cluster", "distance2")
    return _rounded_to(out, "distance2", 6)


@query("kmeans_lloyd_step", CENTRE_SQL + """
SELECT CAST(i AS INTEGER) AS cluster, count(*) AS n, round(sum(dist), 5) AS within_ss, round(avg(wealth_k), 6) AS wealth_k,
       round(avg(lines), 6) AS lines, round(avg(qty), 6) AS qty FROM n WHERE rn = 1 GROUP BY i""", views=MODEL_VIEWS)
def q_kmeans_lloyd_step(spark, folder):
    table, centres = _cluster_input(spark, folder)
    out = _rounded_to(cluster.lloyd_step(table, CLUSTER_COLUMNS, centres), "within_ss", 5)
    return out.withColumns({c: F.round(c, 6) for c in CLUSTER_COLUMNS})
