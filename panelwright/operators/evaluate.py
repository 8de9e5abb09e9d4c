"""Errors, confusion matrices, cross-validation summaries and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.nulls import as_column, if_known
from ..functions.stats import mean_squared_error, mismatch_rate
from .distributions import binomial_at_least, exact_interval
from .order import rank_small

MSE, MISCLASS = "mse", "misclass"


def error(actual, predicted, metric: str = MSE):
    """The error aggregate for a metric name."""
    return {MSE: mean_squared_error, MISCLASS: mismatch_rate}[metric](actual, predicted)


def above(score, threshold: float = 0.5):
    """0/1 prediction from a probability; NULL if the probability is unknown."""
    return if_known(as_column(score) > F.lit(threshold), F.lit(1), F.lit(0))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, levels: Sequence) -> DataFrame:
    """Truth in rows, predictions in columns."""
    counts = [
        F.count(F.when(F.col(predicted) == F.lit(level), 1)).alias(f"pred_{level}") for level in levels
    ]
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("truth")).agg(*counts)


def accuracy_from_matrix(matrix: DataFrame, levels: Sequence) -> DataFrame:
    """Accuracy and error rate of a confusion matrix."""
    cells = [F.col(f"pred_{level}") for level in levels]
    right = sum((F.when(F.col("truth") == F.lit(level), cell).otherwise(0) for level, cell in zip(levels, cells)), F.lit(0))
    total = sum(cells, F.lit(0))
    share = F.sum(right) / F.sum(total)
    return matrix.agg(share.alias("accuracy"), (1 - share).alias("error_rate"))


def accuracy_row(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy with its exact 95 % interval and the p-value against always
    predicting the most frequent class. Counting is the only pass."""
    counts = (
        df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(truth).alias("t"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth) == F.col(predicted), 1)).alias("k"))
        .collect()
    )  # one row per class
    return accuracy_of(df.sparkSession, [(r["n"], r["k"]) for r in counts])


def accuracy_of(spark: SparkSession, classes: Sequence[tuple[int, int]]) -> DataFrame:
    """The same from (rows, rows predicted right) of each class."""
    n, k = sum(c[0] for c in classes), sum(c[1] for c in classes)
    base = max(c[0] for c in classes) / n
    low, high = exact_interval(k, n)
    row = (n, k / n, low, high, base, binomial_at_least(k, n, base))
    return spark.createDataFrame(
        [row], "n long, estimate double, conf_low double, conf_high double, base_rate double, p_value double"
    )


def summarise_folds(df: DataFrame, parameters: Sequence[str], errors: Sequence[str]) -> DataFrame:
    """Mean errors over the folds per hyper-parameter value."""
    return df.groupBy(*parameters).agg(*[F.avg(e).alias(e) for e in errors])


def best_parameters(summary: DataFrame, parameters: Sequence[str], metric: str) -> DataFrame:
    """The parameters of the least error; ties go to the smallest parameters."""
    order = F.struct(F.col(metric), *parameters)
    best = F.min_by(F.struct(*parameters, metric), order)
    return summary.where(F.col(metric).isNotNull()).agg(best.alias("b")).select("b.*")


def leaderboard(results: DataFrame, error_column: str, metric: str | None = None) -> DataFrame:
    """Rank methods by error. With ``metric`` also within each metric, since a
    squared error and an error rate do not compare."""
    order = [F.col(error_column).asc_nulls_last(), F.col("method")]
    out = rank_small(results, order)
    if metric:
        within = Window.partitionBy(metric).orderBy(*order)
        out = out.withColumn("rank_in_metric", F.row_number().over(within).cast("long"))
    return out
