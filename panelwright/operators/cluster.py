"""k-means for many cluster counts and starts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import DEFAULT_SEED, draw
from ..session import stage
from .columns import complete_rows


@dataclass
class Clustering:
    """Centres of one run, its total within-cluster sum of squares, its rounds and whether they were enough."""

    k: int
    start: int
    centres: np.ndarray
    within: float
    rounds: int = 0
    converged: bool = False
    sizes: np.ndarray | None = None
    transfers: int = 0


def squared_distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    return sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0))


def assign(df: DataFrame, columns: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Label rows with their nearest centre, 1..k; the first one on equal distance."""
    options = [
        F.struct(squared_distance(columns, c).alias("d"), F.lit(i + 1).alias("i")) for i, c in enumerate(centres)
    ]
    return df.withColumn("_near", F.array_min(F.array(*options))).withColumns(
        {name: F.col("_near.i"), "distance2": F.col("_near.d")}
    ).drop("_near")


def lloyd_step(df: DataFrame, columns: Sequence[str], centres: np.ndarray) -> DataFrame:
    """One round: assign every row, then average the rows of each cluster."""
    return assign(df, columns, centres).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance2").alias("within_ss"), *[F.avg(c).alias(c) for c in columns]
    )


def starting_rows(df: DataFrame, row_id: str, columns: Sequence[str], rows: int, seed: int) -> np.ndarray:
    """A random draw of rows: the first ones in hash order, found as a top-k."""
    picked = (
        df.select(draw(row_id, "start", seed).alias("h"), row_id, *[F.col(c).cast("double").alias(c) for c in columns])
        .orderBy("h", row_id).limit(rows).collect()
    )
    return np.array([[r[c] for c in columns] for r in picked])


def _partial_sums(columns: Sequence[str], stacked: np.ndarray, owner: np.ndarray, centre: np.ndarray):
    """Per task: rows, sums and squared distances of every cluster of every run."""
    runs = np.unique(owner)
    blocks = [np.flatnonzero(owner == r) for r in runs]
    norms = (stacked**2).sum(axis=1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(len(stacked))
        sums = np.zeros_like(stacked)
        within = np.zeros(len(stacked))
        for batch in batches:
            x = batch[list(columns)].to_numpy(dtype=float) - centre
            # |x - c|² less |x|², which does not matter for the nearest centre.
            distance = norms - 2.0 * x @ stacked.T
            for block in blocks:
                near = distance[:, block].argmin(axis=1)
                least = ((x - stacked[block[near]]) ** 2).sum(axis=1)
                count[block] += np.bincount(near, minlength=len(block))
                within[block] += np.bincount(near, weights=least, minlength=len(block))
                for j in range(x.shape[1]):
                    sums[block, j] += np.bincount(near, weights=x[:, j], minlength=len(block))
        out = pd.DataFrame({"slot": np.arange(len(stacked)), "n": count, "w": within})
        for j in range(sums.shape[1]):
            out[f"s{j}"] = sums[:, j]
        yield out

    return work


#: Rows that one scan proposes for a transfer, a run; and the share of a sum of squares that a transfer must take off.
PROPOSED, WORTHWHILE = 64, 1e-10


def _proposals(columns: Sequence[str], runs: Sequence[Clustering], centre: np.ndarray):
    """Per task and run: the rows whose move to another cluster lowers the sum most."""
    fixed = [(r.centres, r.sizes, r.within) for r in runs]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, out = batch[list(columns)].to_numpy(dtype=float) - centre, []
            for i, (centres, sizes, within) in enumerate(fixed):
                distance = ((x[:, None, :] - centres) ** 2).sum(axis=2)
                near, rows = distance.argmin(axis=1), np.arange(len(x))
                own = sizes[near]
                leave = np.where(own > 1, own / np.maximum(own - 1, 1) * distance[rows, near], 0.0)
                join = sizes / (sizes + 1) * distance
                join[rows, near] = np.inf
                gain = leave - join.min(axis=1)
                best = np.argsort(-gain, kind="stable")[:PROPOSED]
                best = best[gain[best] > WORTHWHILE * within]
                if len(best):
                    out.append(pd.DataFrame({"run": i, "gain": gain[best], "source": near[best], "x": list(x[best])}))
            if out:
                yield pd.concat(out)

    return work


def _transfer(data: DataFrame, columns: Sequence[str], runs: Sequence[Clustering], centre: np.ndarray) -> list[Clustering]:
    """One scan for transfers, then the proposed ones in order of their gain, each only if it
    still lowers the sum with the centres as the earlier ones left them. Returns the runs that changed."""
    found = data.mapInPandas(_proposals(columns, runs, centre), "run int, gain double, source int, x array<double>")
    order = Window.partitionBy("run").orderBy(F.desc("gain"), "x")
    rows = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROPOSED).orderBy("run", "place").collect()
    changed = set()
    for row in rows:  # at most PROPOSED a run
        run, x, a = runs[row["run"]], np.array(row["x"]), row["source"]
        distance, n = ((run.centres - x) ** 2).sum(axis=1), run.sizes
        join = np.where(np.arange(run.k) == a, np.inf, n / (n + 1) * distance)
        b = int(join.argmin())
        if n[a] <= 1 or n[a] / (n[a] - 1) * distance[a] - join[b] <= WORTHWHILE * run.within:
            continue
        run.centres[a] = run.centres[a] + (run.centres[a] - x) / (n[a] - 1)
        run.centres[b] = run.centres[b] + (x - run.centres[b]) / (n[b] + 1)
        n[a], n[b], run.transfers = n[a] - 1, n[b] + 1, run.transfers + 1
        changed.add(row["run"])
    return [runs[i] for i in sorted(changed)]


def cluster_grid(
    df: DataFrame, row_id: str, columns: Sequence[str], counts: Sequence[int], starts: int = 20,
    iterations: int = 1000, tolerance: float = 0.0, seed: int = DEFAULT_SEED, transfers: bool = True,
) -> dict[int, Clustering]:
    """The best of ``starts`` runs for every cluster count.

    Each round reads the table once for all runs together and returns one row
    per cluster and task, so 100 runs cost as many passes as the slowest of them
    and not their sum. A run drops out when a round lowers its sum of squares by
    no more than the ``tolerance`` share (0: until no centre moves); ``converged``
    is false where ``iterations`` rounds were not enough. Rows with a NULL or NaN
    in one of the columns take no part.

    Where rounds end, single rows may still lower the sum by moving to another cluster,
    since both centres move with them. With ``transfers`` such rows are moved, and
    rounds and transfers go on by turns until neither changes a run, so the sum is never above that
    of the rounds alone.
    """
    p = len(columns)
    df = complete_rows(df.withColumns({c: F.col(c).cast("double") for c in columns}), columns)
    data = stage(df.select(*columns), "points")
    means = data.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] for c in columns])
    pool = starting_rows(df, row_id, columns, starts * max(counts), seed) - centre
    runs = []
    for k in counts:
        for s in range(starts):
            first = pool[(np.arange(k) + s * max(counts)) % len(pool)]
            runs.append(Clustering(k, s, first.copy(), np.inf))
    schema = "slot long, n double, w double, " + ", ".join(f"s{j} double" for j in range(p))
    moving = list(runs)
    for _ in range(iterations):
        stacked = np.vstack([r.centres for r in moving])
        owner = np.concatenate([[i] * r.k for i, r in enumerate(moving)])
        work = _partial_sums(columns, stacked, owner, centre)
        totals = data.mapInPandas(work, schema).groupBy("slot").agg(
            *[F.sum(c).alias(c) for c in ["n", "w", *[f"s{j}" for j in range(p)]]]
        ).toPandas().sort_values("slot")
        n, w = totals["n"].to_numpy(), totals["w"].to_numpy()
        sums = totals[[f"s{j}" for j in range(p)]].to_numpy()
        still = []
        for i, run in enumerate(moving):
            mine = owner == i
            before, run.within = run.within, float(w[mine].sum())
            filled = n[mine] > 0
            new = run.centres.copy()
            new[filled] = sums[mine][filled] / n[mine][filled][:, None]
            settled = np.allclose(new, run.centres, rtol=1e-12, atol=0.0)
            run.rounds += 1
            run.converged = settled or before - run.within <= tolerance * run.within
            if not run.converged:
                still.append(run)
            run.centres, run.sizes = new, n[mine]
        moving = still
        if not moving:
            moving = _transfer(data, columns, runs, centre) if transfers else []
        if not moving:
            break
    best = {}
    for k in counts:
        found = min((r for r in runs if r.k == k), key=lambda r: r.within)
        best[k] = replace(found, centres=found.centres + centre)
    return best
