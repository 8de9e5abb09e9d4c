"""Fitting many models on one staged table: folds, grids, hold-out errors.

Every fit is a distributed ``pyspark.ml`` job. Independent fits run side by side
from a few driver threads, so that small jobs fill the cluster between them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import DEFAULT_SEED, draw
from ..session import stage
from .evaluate import MISCLASS, error
from .resample import exact_split, fold_column

FEATURES = "features"


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], threads: int = 8) -> list:
    """Run independent Spark jobs concurrently; results in order."""
    if not jobs:
        return []
    spark_jobs = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda job: job(), spark_jobs, chunksize=1)


def assemble(df: DataFrame, terms: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Additive design: the terms side by side in one vector column."""
    return VectorAssembler(inputCols=list(terms), outputCol=out, handleInvalid="error").transform(df)


def prepare(
    df: DataFrame, row_id: str, columns: Sequence[str], folds: int = 10, fraction: float = 0.70,
    seed: int = DEFAULT_SEED, path_folds: int = 10,
) -> DataFrame:
    """The modelling table: complete rows, an exact training split and folds of it.

    ``fold`` serves methods that are fitted anew for every fold, ``path_fold`` the
    penalty paths, whose folds cost nothing.

    The rows are staged once, together with their draws; split and folds are
    then comparisons of a stored number, so nothing is hashed or written again.
    Test rows have no fold.
    """
    draws = {"_split": draw(row_id, "split", seed), "_fold": draw(row_id, "fold", seed)}
    table = stage(df.select(row_id, *columns).dropna("any").withColumns(draws), "model")
    table = exact_split(table, row_id, fraction, seed, hashed=F.col("_split"))
    marks = {
        name: F.when(F.col("is_train"), fold_column(table.where("is_train"), row_id, k, seed, hashed=F.col("_fold")))
        for name, k in (("fold", folds), ("path_fold", path_folds))
    }
    return table.withColumns(marks).drop("_split", "_fold")


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_train"))


def test_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_train"))


def holdout_error(model: Transformer, df: DataFrame, outcome: str, metric: str = MISCLASS) -> float:
    """Error on the given rows, NULL-free, in one aggregation."""
    return model.transform(df).agg(error(outcome, "prediction", metric).alias("e")).first()["e"]


@dataclass
class Candidate:
    """An estimator and the hyper-parameters it stands for."""

    params: tuple
    build: Callable[[int], Estimator]


def cross_validate(
    df: DataFrame, candidates: Sequence[Candidate], outcome: str, folds: Sequence[int],
    metric: str = MISCLASS, threads: int = 8,
) -> list[tuple]:
    """(params, fold, training error, test error) for every candidate and fold.

    Training and test error of a fit come from one scoring pass. ``build`` is
    given the number of training rows, which some penalties depend on.
    """
    sizes = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())

    def job(candidate: Candidate, fold: int) -> Callable:
        def run():
            kept = df.where(F.col("fold") != fold)
            model = candidate.build(total - sizes[fold]).fit(kept)
            scored = model.transform(df).groupBy((F.col("fold") == fold).alias("t"))
            e = {r["t"]: r["e"] for r in scored.agg(error(outcome, "prediction", metric).alias("e")).collect()}
            return (candidate.params, fold, e[False], e[True])

        return run

    return side_by_side(df.sparkSession, [job(c, k) for c in candidates for k in folds], threads)


def fold_frame(df: DataFrame, results: Sequence[tuple], names: Sequence[str], types: str) -> DataFrame:
    """Cross-validation results as a table, one row per candidate and fold."""
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types.split())) + ", fold int, train_error double, test_error double"
    cast = {"double": float, "int": int}
    rows = [
        (*[cast[t](v) for t, v in zip(types.split(), params)], fold, train, test) for params, fold, train, test in results
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def best_candidate(results: Sequence[tuple]) -> tuple:
    """The parameters with the least mean test error; ties go to the smallest."""
    errors: dict[tuple, list[float]] = {}
    for params, _, _, test in results:
        errors.setdefault(params, []).append(test)
    return min(errors, key=lambda p: (sum(errors[p]) / len(errors[p]), p))
