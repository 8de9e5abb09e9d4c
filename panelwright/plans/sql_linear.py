"""SQL builders for least squares and ridge with several predictors.

Independent of the Spark side: the normal equations are eliminated column by
column in a recursive query over a matrix held as a list of lists.
"""

from __future__ import annotations

from collections.abc import Sequence


def _list(items: Sequence[str]) -> str:
    return "[" + ", ".join(items) + "]"


def eliminate(source: str, keys: Sequence[str], size: int, name: str = "done") -> str:
    """Views ``name(keys, m)``: ``source(keys, m)`` after Gauss-Jordan elimination of ``size`` columns."""
    k = "".join(f"{key}, " for key in keys)
    step = (
        "list_transform(m, lambda line, i: CASE WHEN i = s + 1 THEN list_transform(line, lambda v: v / m[s + 1][s + 1]) "
        "ELSE list_transform(line, lambda v, j: v - line[s + 1] * m[s + 1][j] / m[s + 1][s + 1]) END)"
    )
    return (
        f"{name}_steps AS (SELECT {k}0 AS s, m FROM {source} UNION ALL "
        f"SELECT {k}s + 1, {step} FROM {name}_steps WHERE s < {size}),\n"
        f"{name} AS (SELECT {k}m FROM {name}_steps WHERE s = {size})"
    )


def scaled_rows(source: str, outcome: str, terms: Sequence[str], extra: Sequence[str] = ()) -> str:
    """A view ``x`` of the outcome ``y`` and the terms ``x0, x1, ...`` as doubles."""
    columns = [f"{outcome} AS y", *[f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(terms)], *extra]
    return f"x AS (SELECT {', '.join(columns)} FROM {source})"


def least_squares(terms: int, train: str) -> str:
    """Views from ``x``: scales ``sc``, scaled training rows ``z``, inverse and solution ``fit(m, n)``.

    The matrix holds [A | A'y | I] with an intercept column first, so that after
    elimination column size+1 is the solution and the rest the inverse.
    """
    size = terms + 1
    scales = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    z = ", ".join(f"(x{i} - a{i}) / s{i} AS z{i}" for i in range(terms))
    names = ["1.0::DOUBLE", *[f"z{i}" for i in range(terms)]]
    lines = []
    for i in range(size):
        cells = [f"sum({names[i]} * {names[j]})" for j in range(size)]
        cells.append(f"sum({names[i]} * y)")
        cells += ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(size)]
        lines.append(_list(cells))
    return (
        f"sc AS (SELECT {scales} FROM x WHERE {train}),\n"
        f"z AS (SELECT x.*, {z} FROM x, sc),\n"
        f"normal AS (SELECT {_list(lines)} AS m FROM z WHERE {train}),\n" + eliminate("normal", [], size, "fit")
    )


def solution(i: int, terms: int) -> str:
    """Coefficient of scaled term ``i`` (0 is the intercept) in ``fit.m``."""
    return f"fit.m[{i + 1}][{terms + 2}]"


def inverse(i: int, j: int, terms: int) -> str:
    return f"fit.m[{i + 1}][{terms + 2 + j + 1}]"


def score(terms: int) -> str:
    """Prediction for a row of ``z`` beside ``fit``."""
    return " + ".join([solution(0, terms), *[f"{solution(i + 1, terms)} * z{i}" for i in range(terms)]])


def coefficients(names: Sequence[str], train: str) -> str:
    """``coef(term, b, se)`` in original units, after ``least_squares``."""
    p = len(names)
    sigma = f"(SELECT sum(pow(y - ({score(p)}), 2)) / (count(*) - {p + 1}) FROM z, fit WHERE {train})"
    shift = " - ".join([solution(0, p), *[f"{solution(i + 1, p)} * a{i} / s{i}" for i in range(p)]])
    weights = ["1.0", *[f"(-a{i} / s{i})" for i in range(p)]]
    spread = " + ".join(f"{weights[i]} * {weights[j]} * {inverse(i, j, p)}" for i in range(p + 1) for j in range(p + 1))
    rows = [f"SELECT '(Intercept)' AS term, {shift} AS b, sqrt({sigma} * ({spread})) AS se FROM fit, sc"]
    rows += [
        f"SELECT '{t}', {solution(i + 1, p)} / s{i}, sqrt({sigma} * {inverse(i + 1, i + 1, p)}) / s{i} FROM fit, sc"
        for i, t in enumerate(names)
    ]
    return "coef AS (" + " UNION ALL ".join(rows) + ")"


def student_two_sided(t: str, freedom: str, steps: int = 4000) -> str:
    """P(|T| >= |t|) by Simpson's rule on the density of Student's distribution."""
    density = f"pow(1 + pow(abs({t}) * i / {steps}, 2) / {freedom}, -({freedom} + 1) / 2.0)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range({steps + 1}), lambda i: {weight} * {density})) * abs({t}) / {3 * steps}"
    scale = f"exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0)) / sqrt({freedom} * pi())"
    return f"(1 - 2 * {scale} * {area})"


def inflation(names: Sequence[str], source: str) -> str:
    """``vif(term, vif)``: diagonal of the inverse correlation matrix."""
    p = len(names)
    lines = [
        _list([f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for b in names]
              + ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(p)])
        for i, a in enumerate(names)
    ]
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, m[{i + 1}][{p + i + 1}] AS vif FROM inv" for i, t in enumerate(names))
    return f"normal AS (SELECT {_list(lines)} AS m FROM {source}),\n" + eliminate("normal", [], p, "inv") + f",\nvif AS ({rows})"


def ridge_folds(terms: int, low: float, high: float, length: int) -> str:
    """From ``x`` with a ``fold``: ``cv(i, cv)`` and ``q(i, cv, se)`` over a log-spaced penalty grid."""
    stats = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    lines = [
        _list([f"corr(x{i}, x{j})" for j in range(terms)] + [f"corr(x{i}, y)"]) for i in range(terms)
    ]
    b = " + ".join(f"m[{i + 1}][{terms + 1}] * (x{i} - a{i}) / s{i}" for i in range(terms))
    return f"""
k AS (SELECT DISTINCT fold FROM x),
st AS (SELECT k.fold, avg(y) AS my, stddev_pop(y) AS sy, {stats}, {_list(lines)} AS r
       FROM k JOIN x ON x.fold <> k.fold GROUP BY k.fold),
g AS (SELECT i, pow(10, {low} + ({high} - {low}) * i / {length - 1}.0) AS g FROM range({length}) t(i)),
normal AS (SELECT fold, i, list_transform(r, lambda line, a: list_transform(line, lambda v, c: CASE WHEN a = c THEN v + g / sy ELSE v END)) AS m
           FROM st, g),
{eliminate("normal", ["fold", "i"], terms, "fit")},
e AS (SELECT fit.i, fit.fold, count(*) AS n, avg(pow(y - my - sy * ({b}), 2)) AS e
      FROM fit JOIN st ON st.fold = fit.fold JOIN x ON x.fold = fit.fold GROUP BY fit.i, fit.fold),
cv AS (SELECT i, sum(n * e) / sum(n) AS cv FROM e GROUP BY i),
q AS (SELECT cv.i, cv, sqrt(sum(n * (e - cv) * (e - cv)) / sum(n) / (count(*) - 1)) AS se
      FROM cv JOIN e ON e.i = cv.i GROUP BY cv.i, cv)"""


def lasso_folds(terms: int, low: float, high: float, length: int, sweeps: int = 300) -> str:
    """The same as ``ridge_folds`` for the lasso, by coordinate descent in every fold and for every penalty."""
    stats = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    r = _list([_list([f"corr(x{i}, x{j})" for j in range(terms)]) for i in range(terms)])
    v = _list([f"corr(x{i}, y)" for i in range(terms)])
    rest = "(v[a] - list_dot_product(r[a], b) + r[a][a] * b[a])"
    fitted = " + ".join(f"b[{i + 1}] * (x{i} - a{i}) / s{i}" for i in range(terms))
    return f"""
k AS (SELECT DISTINCT fold FROM x),
st AS (SELECT k.fold, avg(y) AS my, stddev_pop(y) AS sy, {stats}, {r} AS r, {v} AS v
       FROM k JOIN x ON x.fold <> k.fold GROUP BY k.fold),
g AS (SELECT i, pow(10, {low} + ({high} - {low}) * i / {length - 1}.0) AS g FROM range({length}) t(i)),
cd AS (SELECT 0 AS step, fold, i, g / sy AS pull, {_list(["0.0::DOUBLE"] * terms)} AS b FROM st, g
       UNION ALL SELECT step + 1, cd.fold, i, pull, list_transform(b, lambda old, a: CASE WHEN a = step % {terms} + 1
         THEN sign({rest}) * greatest(abs({rest}) - pull, 0) ELSE old END)
       FROM cd JOIN st ON cd.fold = st.fold WHERE step < {sweeps * terms}),
fit AS (SELECT fold, i, b FROM cd WHERE step = {sweeps * terms}),
e AS (SELECT fit.i, fit.fold, count(*) AS n, avg(pow(y - my - sy * ({fitted}), 2)) AS e
      FROM fit JOIN st ON st.fold = fit.fold JOIN x ON x.fold = fit.fold GROUP BY fit.i, fit.fold),
cv AS (SELECT i, sum(n * e) / sum(n) AS cv FROM e GROUP BY i),
q AS (SELECT cv.i, cv, sqrt(sum(n * (e - cv) * (e - cv)) / sum(n) / (count(*) - 1)) AS se
      FROM cv JOIN e ON e.i = cv.i GROUP BY cv.i, cv)"""


def penalised(terms: int, rows: str, train: str, ridge: tuple, lasso: tuple, sweeps: int = 300) -> str:
    """``fits(method, b)``: ridge and lasso on all training rows at both customary penalties, in scaled units.

    ``rows`` defines ``x`` with a ``fold`` (NULL for hold-out rows) and ``train`` is
    the condition for training rows.
    """
    stats = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    r = _list([_list([f"corr(x{i}, x{j})" for j in range(terms)]) for i in range(terms)])
    v = _list([f"corr(x{i}, y)" for i in range(terms)])
    rest = "(v[a] - list_dot_product(r[a], b) + r[a][a] * b[a])"
    curves, choices = [], []
    for name, (low, high, length), views in (
        ("ridge", ridge, ridge_folds(terms, *ridge)), ("lasso", lasso, lasso_folds(terms, *lasso)),
    ):
        curves.append(f"{name}_q AS (WITH RECURSIVE all_{rows}, x AS (SELECT * FROM all_x WHERE {train}), {views} SELECT i, cv, se FROM q)")
        penalty = f"pow(10, {low} + ({high} - {low}) * max(i) / {length - 1}.0)"
        choices += [
            f"SELECT '{name}_min' AS method, {penalty} AS g FROM {name}_q WHERE cv <= (SELECT min(cv) FROM {name}_q)",
            f"SELECT '{name}_1se', {penalty} FROM {name}_q WHERE cv <= (SELECT arg_min(cv + se, cv) FROM {name}_q)",
        ]
    return ",\n".join([
        *curves, "chosen AS (" + " UNION ALL ".join(choices) + ")", rows,
        f"st AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, {stats}, {r} AS r, {v} AS v FROM x WHERE {train})",
        "normal AS (SELECT method, list_transform(r, lambda line, a: list_append(list_transform(line, lambda w, c: "
        "CASE WHEN a = c THEN w + g / sy ELSE w END), v[a])) AS m FROM st, chosen WHERE method LIKE 'ridge%')",
        eliminate("normal", ["method"], terms, "solved"),
        f"""cd AS (SELECT 0 AS step, method, g / sy AS pull, {_list(["0.0::DOUBLE"] * terms)} AS b FROM st, chosen WHERE method LIKE 'lasso%'
       UNION ALL SELECT step + 1, method, pull, list_transform(b, lambda old, a: CASE WHEN a = step % {terms} + 1
         THEN sign({rest}) * greatest(abs({rest}) - pull, 0) ELSE old END) FROM cd, st WHERE step < {sweeps * terms})""",
        f"fits AS (SELECT method, {_list([f'm[{i + 1}][{terms + 1}]' for i in range(terms)])} AS b FROM solved "
        f"UNION ALL SELECT method, b FROM cd WHERE step = {sweeps * terms})",
    ])


def logistic(terms: int, train: str, rounds: int = 10) -> str:
    """From ``x``: scaled rows ``z`` and, after reweighted least squares, ``logit(m)`` with the solution last."""
    size = terms + 1
    scales = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    z = ", ".join(f"(x{i} - a{i}) / s{i} AS z{i}" for i in range(terms))
    names = ["1.0::DOUBLE", *[f"z{i}" for i in range(terms)]]
    views = [
        f"sc AS (SELECT {scales} FROM x WHERE {train})",
        f"z AS (SELECT x.*, {z} FROM x, sc)",
        f"e0 AS (SELECT *, 0.0::DOUBLE AS eta FROM z WHERE {train})",
    ]
    lines = _list([
        _list([f"sum(w * {names[i]} * {names[j]})" for j in range(size)] + [f"sum(w * {names[i]} * (eta + (y - mu) / w))"])
        for i in range(size)
    ])
    for r in range(1, rounds + 1):
        views.append(f"w{r} AS (SELECT *, 1 / (1 + exp(-eta)) AS mu, 1 / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))) AS w FROM e{r - 1})")
        views.append(f"n{r} AS (SELECT {lines} AS m FROM w{r})")
        last = "logit" if r == rounds else f"f{r}"
        views.append(eliminate(f"n{r}", [], size, last))
        if r < rounds:
            views.append(f"e{r} AS (SELECT z.*, {linear_part(terms, f'f{r}')} AS eta FROM z, f{r} WHERE {train})")
    return ",\n".join(views)


def linear_part(terms: int, fit: str = "logit") -> str:
    """The linear predictor of a row of ``z`` beside the view ``fit``."""
    return " + ".join([f"{fit}.m[1][{terms + 2}]", *[f"{fit}.m[{i + 2}][{terms + 2}] * z{i}" for i in range(terms)]])


def lasso(terms: int, train: str, penalties: Sequence[float], sweeps: int = 400) -> str:
    """From ``x``: scales ``st`` and ``lasso(g, b)``, coefficients in scaled units by coordinate descent."""
    stats = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in range(terms))
    r = _list([_list([f"corr(x{i}, x{j})" for j in range(terms)]) for i in range(terms)])
    v = _list([f"corr(x{i}, y)" for i in range(terms)])
    grid = ", ".join(f"({g})" for g in penalties)
    zeros = _list(["0.0::DOUBLE"] * terms)
    rest = "(v[a] - list_dot_product(r[a], b) + r[a][a] * b[a])"
    return f"""st AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, {stats}, {r} AS r, {v} AS v FROM x WHERE {train}),
cd AS (SELECT 0 AS step, CAST(g AS DOUBLE) AS g, {zeros} AS b FROM (VALUES {grid}) t(g)
       UNION ALL SELECT step + 1, g, list_transform(b, lambda old, a: CASE WHEN a = step % {terms} + 1
         THEN sign({rest}) * greatest(abs({rest}) - g / sy, 0) ELSE old END) FROM cd, st WHERE step < {sweeps * terms}),
lasso AS (SELECT g, b FROM cd WHERE step = {sweeps * terms})"""


def lasso_score(terms: int) -> str:
    """Prediction for a row of ``x`` beside ``st`` and ``lasso``."""
    return "my + sy * (" + " + ".join(f"b[{i + 1}] * (x{i} - a{i}) / s{i}" for i in range(terms)) + ")"
