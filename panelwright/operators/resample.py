"""Exact, seeded splits, folds and permutations without sorting the whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import DEFAULT_SEED, HASH_BITS, draw
from ..functions.nulls import as_column

# Leading hash bits that form a bucket: at most 16,384 buckets.
_BUCKET_BITS = 14


def _bucket(hashed: Column) -> Column:
    return F.shiftright(hashed, HASH_BITS - _BUCKET_BITS)


def order_cuts(
    df: DataFrame, row_id: str, hashes: Mapping[str, Column], ranks: Callable[[int], Sequence[int]]
) -> dict[str, list[tuple | None]]:
    """The (hash, id) pairs that stand at the given ranks of each hash order.

    ``ranks`` gives the sought positions for a table of n rows. A histogram over
    the leading hash bits, at most 16,384 rows per order, finds the bucket of
    each rank; only the rows of those buckets are ranked. The result has one
    pair per rank, so that membership becomes a comparison against constants,
    with no join and no shuffle of the table. Two passes serve all orders. Ids
    must be unique.
    """
    cells = F.array(*[F.struct(F.lit(o).alias("o"), h.alias("h")) for o, h in hashes.items()])
    hashed = df.select(F.col(row_id).alias("i"), F.inline(cells)).withColumn("b", _bucket(F.col("h")))
    histogram = hashed.groupBy("o", "b").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["o", "b"])
    wanted, sought = {}, {o: [] for o in hashes}
    for o, part in histogram.groupby("o"):
        upto, buckets, sizes = part["n"].cumsum().to_numpy(), part["b"].to_numpy(), part["n"].to_numpy()
        sought[o] = list(ranks(int(upto[-1])))
        for rank in {r for r in sought[o] if r > 0}:
            k = int(upto.searchsorted(rank))
            if k < len(upto):
                wanted[(o, int(buckets[k]), int(rank - upto[k] + sizes[k]))] = rank
    if not wanted:
        return {o: [None] * len(r) for o, r in sought.items()}

    def either(tests: Iterable[Column]) -> Column:
        return reduce(lambda x, y: x | y, tests)

    near = either((F.col("o") == o) & (F.col("b") == b) for o, b in sorted({(o, b) for o, b, _ in wanted}))
    window = Window.partitionBy("o", "b").orderBy("h", "i")
    ranked = hashed.where(near).withColumn("r", F.row_number().over(window))
    chosen = either((F.col("o") == o) & (F.col("b") == b) & (F.col("r") == r) for o, b, r in wanted)
    found = {(x["o"], wanted[(x["o"], x["b"], x["r"])]): (x["h"], x["i"]) for x in ranked.where(chosen).collect()}
    return {o: [found.get((o, rank)) for rank in r] for o, r in sought.items()}


def _at_or_before(row_id: str, hashed: Column, cut: tuple | None) -> Column:
    if cut is None:
        return F.lit(False)
    h, i = cut
    return (hashed < F.lit(h)) | ((hashed == F.lit(h)) & (as_column(row_id) <= F.lit(i)))


def _ladder(row_id: str, hashed: Column, cuts: Sequence[tuple | None], values: Sequence) -> Column:
    """``values[k]`` up to the k-th cut, the last value beyond all of them."""
    out = None
    for value, cut in zip(values, cuts):
        test = _at_or_before(row_id, hashed, cut)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    last = F.lit(values[-1])
    return last if out is None else out.otherwise(last)


def half_even(n: int, fraction: float) -> int:
    """Rows in an exact fraction, halves rounded to even."""
    return int(round(n * fraction))


def exact_split(
    df: DataFrame, row_id: str, fraction: float = 0.70, seed: int = DEFAULT_SEED, name: str = "is_train",
    hashed: Column | None = None,
) -> DataFrame:
    """Mark an exact fraction of the rows as training rows.

    ``hashed`` is the stored draw of each row, if the table holds one.
    """
    hashed = draw(row_id, "split", seed) if hashed is None else hashed
    (cut,) = order_cuts(df, row_id, {"split": hashed}, lambda n: [half_even(n, fraction)])["split"] or [None]
    return df.withColumn(name, _at_or_before(row_id, hashed, cut))


def fold_column(
    df: DataFrame, row_id: str, folds: int = 10, seed: int = DEFAULT_SEED, hashed: Column | None = None
) -> Column:
    """The fold 0..k-1 of each row of ``df`` as an expression; sizes differ by one
    row at most."""

    def ends(n: int) -> list[int]:
        small, larger = divmod(n, folds)
        return [small * k + min(k, larger) for k in range(1, folds)]

    hashed = draw(row_id, "fold", seed) if hashed is None else hashed
    return _ladder(row_id, hashed, order_cuts(df, row_id, {"fold": hashed}, ends)["fold"], range(folds))


def assign_folds(
    df: DataFrame, row_id: str, folds: int = 10, seed: int = DEFAULT_SEED, name: str = "fold"
) -> DataFrame:
    return df.withColumn(name, fold_column(df, row_id, folds, seed))


def permuted_labels(
    df: DataFrame, row_id: str, label: str, draws: Sequence[str], seed: int = DEFAULT_SEED
) -> dict[str, Column]:
    """Permutations of a column of few values, one expression per draw.

    The rows in hash order take the values in turn, each as often as it occurs:
    a permutation of the column by comparisons against constants alone.
    """
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()  # one row per value
    values, ends = [r[label] for r in groups], []
    for r in groups[:-1]:
        ends.append(r["n"] + (ends[-1] if ends else 0))
    hashes = {d: draw(row_id, d, seed) for d in draws}
    cuts = order_cuts(df, row_id, hashes, lambda n: ends)
    return {d: _ladder(row_id, hashes[d], cuts[d], values) for d in draws}


def hash_rank(df: DataFrame, row_id: str, purpose, seed: int, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Position of each row in hash order (within ``group``), 1..n.

    Rows are ranked inside buckets of leading hash bits, and the sizes of the
    earlier buckets are added; no task holds more than one bucket.
    """
    tagged = df.withColumn("_h", draw(row_id, purpose, seed)).withColumn("_b", _bucket(F.col("_h")))
    ranked = tagged.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", F.col(row_id)))
    )
    sizes = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16,384 rows per group.
    window = Window.partitionBy(*group).orderBy("_b") if group else Window.orderBy("_b")
    starts = sizes.withColumn("_s", F.sum("_n").over(window) - F.col("_n")).drop("_n")
    return (
        ranked.join(starts, on=[*group, "_b"])
        .withColumn(name, F.col("_s") + F.col("_r"))
        .drop("_h", "_b", "_r", "_s")
    )


def permute_columns(
    df: DataFrame, row_id: str, columns: Sequence[str], draws: Sequence[str],
    seed: int = DEFAULT_SEED, draw_name: str = "draw",
) -> DataFrame:
    """Whole-row permutations of some columns: one output row per id and draw.

    The row at position r of one hash order takes the values of the row at
    position r of another. Both orders are spread over hash buckets, and all
    draws share one job.
    """
    source = hash_rank(df.select(row_id, *columns), row_id, "base", seed, "_rank").drop(row_id)
    grid = F.explode(F.array(*[F.lit(d) for d in draws]))
    target = df.select(row_id).withColumn(draw_name, grid)
    target = hash_rank(target, row_id, F.col(draw_name), seed, "_rank", [draw_name])
    return target.join(source, "_rank").select(draw_name, row_id, *columns)
