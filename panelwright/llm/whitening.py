"""Principal components of embeddings by Golub-Kahan-Lanczos bidiagonalisation, and whitening."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .files import ship_package

#: A component x becomes floor(SCALE * x) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Relative sizes below which a length counts as nothing, and residuals as settled.
NOTHING, SETTLED = 1e-12, 1e-14
SEED = 5413


def usable_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector holds numbers only, as whole numbers.

    Vectors of another length than the most frequent one (the longer one in a tie) and
    empty ones are left out as well: they have no covariance with the rest.
    """
    table = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        usable = usable.where(F.size("v") == lengths["d"])
    return usable.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class Fit:
    """Sums of the fit list and its leading components.

    ``sums`` are whole numbers, ``directions`` has one row per component, ``values``
    the eigenvalues of the covariance with divisor n, ``total`` its trace and
    ``passes`` the scans of the fit list that the bidiagonalisation took.
    """

    n: int
    sums: list[int]
    total: float
    values: np.ndarray
    directions: np.ndarray
    passes: int = 0

    @property
    def centre(self) -> np.ndarray:
        """Means of x - SHIFT, from whole numbers."""
        return np.array([(s - SHIFT * self.n) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of the rows x over the deviations of the components."""
        return ((x - SHIFT).astype(np.float64) - self.centre) @ self.directions.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)² over dimensions, exact; None beyond 64 bits."""
        off = [[self.n * a - s for a, s in zip(row, self.sums)] for row in x.tolist()] if self._wide(x) else (
            self.n * x - np.array(self.sums, dtype=np.int64)
        )
        if isinstance(off, np.ndarray):
            return (off * off).sum(axis=1).tolist()
        exact = [sum(a * a for a in row) for row in off]
        return [a if a < 2**63 else None for a in exact]

    def _wide(self, x: np.ndarray) -> bool:
        """Whether 64 bits might not hold the squares."""
        if not len(x):
            return False
        reach = max(abs(int(x.max()) * self.n - min(self.sums)), abs(int(x.min()) * self.n - max(self.sums)))
        large = max(abs(int(x.max())), abs(int(x.min()))) * self.n
        return reach * reach * x.shape[1] >= 2**63 or large >= 2**63


class Products:
    """Sums over the rows of the staged fit list; centred rows exist only inside a task."""

    def __init__(self, fit_list: DataFrame, centre: np.ndarray):
        self.fit_list, self.centre, self.passes = fit_list, centre, 0

    def _summed(self, per_batch, size: int) -> np.ndarray:
        """Add up vectors of ``size`` numbers: each task hands on one, Spark sums them by position."""
        centre = self.centre

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += per_batch((_rows(batch.column(0)) - SHIFT).astype(np.float64) - centre)
            yield pa.RecordBatch.from_pydict({"i": np.arange(size), "s": total})

        self.passes += 1
        rows = self.fit_list.mapInArrow(work, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(size)
        for row in rows:
            out[row["i"]] = row["s"]
        return out

    def energy(self) -> float:
        return float(self._summed(lambda x: np.array([(x * x).sum()]), 1)[0])

    def step(self, q: np.ndarray, w: np.ndarray):
        """With p = Xq and the earlier left vectors U = Xw: |p|², Xᵀp and Uᵀp in one scan."""
        d, k = w.shape

        def per_batch(x):
            p = x @ q
            return np.concatenate([[p @ p], x.T @ p, (x @ w).T @ p])

        out = self._summed(per_batch, 1 + d + k)
        return out[0], out[1 : 1 + d], out[1 + d :]

    def cross(self, project) -> np.ndarray:
        """YᵀY of the projected rows."""
        k = project(np.zeros((1, len(self.centre)))).shape[1]
        return self._summed(lambda x: (project(x).T @ project(x)).ravel(), k * k).reshape(k, k)


def bidiagonalise(products: Products, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as rows) of the centred rows X, at least the ``wanted`` largest ones.

    Step k takes p = X v_k - β u_(k-1), orthogonal to all earlier u, and then
    Xᵀu_k - α v_k, orthogonal to all earlier v. A left vector has one entry per row, so it is
    kept as the combination w with u = Xw, and both products of a step come from one scan;
    a second one is made where p was not orthogonal enough. The v and the bidiagonal
    matrix are small and stay on the driver.

    Steps go on until the wanted values are settled and what is left of the sum of
    squares of X is less than the last of them, so no direction of a repeated value
    can be missing; at most all d directions are taken. Where a length vanishes, a
    new random direction is begun.
    """
    random = np.random.default_rng(SEED)
    energy = products.energy()
    if energy <= 0:
        return np.zeros(0), np.zeros((0, d))
    scale = np.sqrt(energy)
    v, w, b = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))

    def fresh() -> np.ndarray:
        new = random.normal(size=d)
        for _ in range(3):
            new -= v @ (v.T @ new)
            new /= np.linalg.norm(new)
        return new

    now, beta = fresh(), 0.0
    while True:
        k = v.shape[1]
        q = now - (beta * w[:, -1] if k else 0.0)
        length, back, along = products.step(q, w)
        if k and np.linalg.norm(along) > 1e-13 * np.sqrt(max(length, 0.0)):
            q = q - w @ along
            length, back, _ = products.step(q, w)
        alpha = float(np.sqrt(max(length, 0.0)))
        b = np.pad(b, ((0, 1), (0, 1)))
        if k:
            b[k - 1, k] = beta
        v = np.column_stack([v, now])
        if alpha > NOTHING * scale:
            b[k, k] = alpha
            w = np.column_stack([w, q / alpha])
            rest = back / alpha - alpha * now
        else:
            w = np.column_stack([w, np.zeros(d)])
            rest = np.zeros(d)
        for _ in range(2):
            rest -= v @ (v.T @ rest)
        beta = float(np.linalg.norm(rest))
        left, found, right = np.linalg.svd(b)
        if k + 1 == d:
            return found, right @ v.T
        if k + 1 >= wanted:
            residuals = beta * np.abs(left[-1, :wanted])
            unseen = energy - (b * b).sum() - beta * beta
            if (residuals <= SETTLED * found[0]).all() and unseen + beta * beta < found[wanted - 1] ** 2:
                return found, right @ v.T
        if beta > NOTHING * scale:
            now = rest / beta
        else:
            now, beta = fresh(), 0.0


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> tuple[Fit, Products] | None:
    """Sums and leading components of a table of distinct vectors ``x``; None if it is empty."""
    sums = fit_list.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    ).orderBy("i").collect()  # one row per dimension
    if not sums:
        return None
    found = Fit(sums[0]["n"], [int(r["s"]) for r in sums], 0.0, np.zeros(0), np.zeros((0, len(sums))))
    products = Products(fit_list, found.centre)
    d = len(sums)
    singular, directions = bidiagonalise(products, d, min(components, d))
    values = singular**2 / found.n
    keep = min(components, int((values > NOTHING * values.sum()).sum())) if len(values) else 0
    found.values, found.directions = values[:keep], directions[:keep]
    found.total = products.energy() / found.n
    found.passes = products.passes
    return found, products


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """One row per usable input row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Every distinct vector counts once in the fit, so copies, however many, do not
    turn the components. Rows whose vector is null, empty or of another length, or
    holds null, NaN or infinite entries, are left out; null ids and repeated rows are
    answered each. Components of no variance are left out, so a table without two
    different vectors gives no row. ``deviation`` is null beyond 64 bits. Other columns
    are ignored. The fit scans the written table of distinct vectors about once a step.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    usable = usable_vectors(vectors, id_column, vector_column)
    fitted = fit(stage(usable.select("x").distinct(), "fit_list"), components)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if fitted is None or not len(fitted[0].values):
        return spark.createDataFrame([], schema)
    found, products = fitted
    k = len(found.values)
    covariance = products.cross(lambda x: x @ found.directions.T / np.sqrt(found.values)) / found.n
    identity_error = float(np.abs(covariance - np.eye(k)).max())
    explained = found.values / found.total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, found.n)),
                pa.array([a for a in found.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(found.whiten(x).ravel()), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(work, schema)
