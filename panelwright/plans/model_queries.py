"""Registered queries: fitted models, clustering, importances, model comparisons."""

from __future__ import annotations

from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from ..operators import cluster
from ..operators.classify import logistic
from ..operators.evaluate import MISCLASS, MSE, accuracy_of
from ..operators.fitting import Candidate, fold_frame
from ..operators.forests import Forest
from ..operators.machines import Machine, machine_errors
from ..operators.reshape import unnest_parallel
from ..session import stage
from . import sql_linear, studies
from .fixture import PREDICTORS, model_data
from .registry import MODEL_VIEWS, query
from .stat_queries import SPLIT_VIEWS
from .studies import Settings, Study

#: The registered queries run the study's own grids.
FULL = Settings()
OUTCOMES = ["action_flag", "unanimous_flag"]
REGRESSION_TERMS = [c for c in PREDICTORS if c != "total_measure"]


def _classes(spark, folder, outcome="action_flag", others=()):
    return Study.of(model_data(spark, folder), "entity_id", outcome, PREDICTORS, FULL, others)


def _values(spark, folder, flag="action_flag", others=()):
    return Study.of(model_data(spark, folder), "entity_id", "total_measure", [flag, *REGRESSION_TERMS], FULL, others)


@query("design_matrix", " UNION ALL ".join(
    f"SELECT entity_id, CAST(action_flag AS DOUBLE) AS y, '{c}' AS term, CAST({c} AS DOUBLE) AS value FROM model_data"
    for c in PREDICTORS), views=MODEL_VIEWS)
def q_design_matrix(spark, folder):
    """The model formula as a design matrix with the 0/1 outcome, laid out long."""
    formula = RFormula(formula="action_flag ~ " + " + ".join(PREDICTORS), featuresCol="x", labelCol="y")
    table = stage(model_data(spark, folder).select("entity_id", "action_flag", *PREDICTORS), "model")
    design = formula.fit(table).transform(table).select(
        "entity_id", "y", F.array(*[F.lit(c) for c in PREDICTORS]).alias("term"), vector_to_array("x").alias("value")
    )
    return unnest_parallel(design, ["entity_id", "y"], ["term", "value"])


@query("logit_holdout", "+" + ",\n".join([
    sql_linear.scaled_rows("split", "action_flag", PREDICTORS, ["is_train"]), sql_linear.logistic(len(PREDICTORS), "is_train"),
]) + f""" SELECT 'logistic_model' AS method,
round(avg(CASE WHEN (CASE WHEN {sql_linear.linear_part(len(PREDICTORS))} > 0 THEN 1 ELSE 0 END) <> y THEN 1.0 ELSE 0.0 END), 9) AS test_misclass
FROM z, logit WHERE NOT is_train""", views=SPLIT_VIEWS, recursive=True)
def q_logit_holdout(spark, folder):
    with _classes(spark, folder) as s:
        e = s.refit(Candidate((), lambda n: logistic(s.outcome)))
    return spark.createDataFrame([("logistic_model", round(float(e), 9))], "method string, test_misclass double")


@query("logit_scores", "+" + ",\n".join([
    sql_linear.scaled_rows("split", "unanimous_flag", PREDICTORS, ["is_train", "entity_id"]),
    sql_linear.logistic(len(PREDICTORS), "is_train"),
]) + f""" SELECT entity_id, round(1 / (1 + exp(-({sql_linear.linear_part(len(PREDICTORS))}))), 5) AS probability
FROM z, logit WHERE NOT is_train""", views=SPLIT_VIEWS, recursive=True)
def q_logit_scores(spark, folder):
    """A fitted model applied to the hold-out rows."""
    s = _classes(spark, folder, "unanimous_flag")
    model = logistic(s.outcome).fit(s.train)
    return model.transform(s.test).select("entity_id", F.round("probability", 5).alias("probability"))


@query("logit_elastic_cv")
def q_logit_elastic_cv(spark, folder):
    with _classes(spark, folder) as s:
        found = studies.logistic_errors(s, s.fold_numbers)
        frames = [fold_frame(s.table, rows, ["penalty"], "double").withColumn("method", F.lit(m)) for m, rows in found.items()]
        return frames[0].unionByName(frames[1])


@query("rf_class_cv")
def q_rf_class_cv(spark, folder):
    with _classes(spark, folder) as s:
        return studies.forest_errors(s)


@query("rf_reg_cv")
def q_rf_reg_cv(spark, folder):
    with _values(spark, folder) as s:
        return studies.forest_errors(s, regression=True)


@query("oob_error")
def q_oob_error(spark, folder):
    """Out-of-bag and hold-out error of one forest, from one growth."""
    with _classes(spark, folder) as s:
        (e,) = studies.grown_errors(s, [Forest((4,), s.settings.trees, 4)])
        row = (e["oob_error"], e["share_scored"], e["test_error"])
        return spark.createDataFrame([row], "oob_error double, share_scored double, test_error double")


@query("bagged_holdout")
def q_bagged_holdout(spark, folder):
    with _classes(spark, folder, others=["action_flag"]) as a:
        b = a.towards("total_measure", ["action_flag", *REGRESSION_TERMS])
        rows = [
            ("bagged_classification", MISCLASS, studies.bagged_error(a)),
            ("bagged_regression", MSE, studies.bagged_error(b, True)),
        ]
        return spark.createDataFrame(rows, "method string, metric string, test_error double")


@query("gbt_cv")
def q_gbt_cv(spark, folder):
    with _classes(spark, folder) as s:
        return fold_frame(s.table, studies.boosting_errors(s), ["learn_rate"], "double")


@query("svm_linear")
def q_svm_linear(spark, folder):
    with _classes(spark, folder) as s:
        return fold_frame(s.table, studies.machine_fold_errors(s, ["linear"])["linear"], ["cost"], "double")


@query("svm_rbf")
def q_svm_rbf(spark, folder):
    with _classes(spark, folder) as s:
        return fold_frame(s.table, studies.machine_fold_errors(s, ["radial"])["radial"], ["gamma", "cost"], "double double")


@query("svm_poly")
def q_svm_poly(spark, folder):
    with _classes(spark, folder) as s:
        return fold_frame(s.table, studies.machine_fold_errors(s, ["polynomial"])["polynomial"], ["degree", "cost"], "int double")


@query("svm_accuracy")
def q_svm_accuracy(spark, folder):
    """Accuracy with interval of the linear machine on the hold-out rows."""
    with _classes(spark, folder) as s:
        r = machine_errors(s.table, s.outcome, s.terms, [Machine((1.0,), "linear", 0.0, 1.0)]).first()
        wrong = r["test_wrong"] - r["positive_wrong"]
        rows = r["test_rows"] - r["positive_rows"]
        return accuracy_of(spark, [(r["positive_rows"], r["positive_rows"] - r["positive_wrong"]), (rows, rows - wrong)])


@query("refit_best")
def q_refit_best(spark, folder):
    with _classes(spark, folder) as s:
        mtry, e, _ = studies.tuned_forest(s)
        return spark.createDataFrame([("random_forest", mtry, float(e))], "method string, mtry int, test_misclass double")


CLUSTER_COLUMNS = ["total_actions", "action_flag", *PREDICTORS]


def _clusters(spark, folder):
    table = stage(model_data(spark, folder).select("entity_id", *CLUSTER_COLUMNS), "cluster")
    return table, cluster.cluster_grid(table, "entity_id", CLUSTER_COLUMNS, range(2, 7), starts=20)


@query("kmeans_elbow")
def q_kmeans_elbow(spark, folder):
    _, best = _clusters(spark, folder)
    return spark.createDataFrame([(k, c.within) for k, c in best.items()], "nclust int, within_ss double")


@query("kmeans_points")
def q_kmeans_points(spark, folder):
    """Rows labelled by the best four clusters."""
    table, best = _clusters(spark, folder)
    return cluster.assign(table, CLUSTER_COLUMNS, best[4].centres).drop("distance2")


@query("rf_importance")
def q_rf_importance(spark, folder):
    with _classes(spark, folder) as s:
        found = studies.importances(s, (12, 9))
        order = Window.partitionBy("mtry").orderBy(F.desc("importance"), "term")  # the terms of one forest
        return found.withColumn("ord", F.row_number().over(order))


@query("rf_importance_corrected")
def q_rf_importance_corrected(spark, folder):
    with _values(spark, folder) as s:
        return studies.corrected_importances(s, 6).orderBy(F.desc("importance"), "term")


@query("altmann_pvalues")
def q_altmann_pvalues(spark, folder):
    with _classes(spark, folder) as s:
        return studies.permutation_p_values(s, 9).orderBy("p_value", "term")


@query("altmann_pvalues_regression")
def q_altmann_pvalues_regression(spark, folder):
    with _values(spark, folder) as s:
        return studies.permutation_p_values(s, 6, regression=True).orderBy("p_value", "term")


@query("bench_classification")
def q_bench_classification(spark, folder):
    with _classes(spark, folder, others=OUTCOMES) as first:
        frames = [studies.classification(first.towards(o)).withColumn("outcome", F.lit(o)) for o in OUTCOMES]
        return frames[0].unionByName(frames[1])


@query("bench_regression")
def q_bench_regression(spark, folder):
    with _values(spark, folder, others=OUTCOMES) as first:
        frames = [
            studies.regression(first.towards("total_measure", [flag, *REGRESSION_TERMS])).withColumn("predictor", F.lit(flag))
            for flag in OUTCOMES
        ]
        return frames[0].unionByName(frames[1])
