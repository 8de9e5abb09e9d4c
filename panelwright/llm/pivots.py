"""Codes of vectors: parts assigned to codebook entries, most distances ruled out by fixed pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .files import ship_package
from .groups import join_groups

#: A component x becomes floor(SCALE * x); larger ones than LARGEST have no squared distance in 64 bits.
SCALE, LARGEST = 256, 2**27
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Pivots of each part position, chosen among the first codebook's entries.
PIVOTS = 6
#: Bounds come from rounded square roots; so much is taken off before they rule out an entry.
MARGIN = 1e-6


def whole_vectors(
    vectors: DataFrame, parts: int = PARTS, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(vec_id, label, x) of the usable rows: x holds floor(256 c).

    Left out are vectors that are null, hold null, NaN or infinite components or such
    beyond ``LARGEST``, and those whose length is not a positive multiple of ``parts``
    or not that of the usable vector with the smallest id.
    """
    table = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].cast("string").alias("label"),
        vectors[vector_column].cast("array<double>").alias("v"),
    )
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= LARGEST))
    usable = table.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & ~bad)
    first = usable.select("vec_id", F.size("v").alias("d")).orderBy(F.asc_nulls_last("vec_id"), "d").first()
    if first is not None:
        usable = usable.where(F.size("v") == first["d"])
    return usable.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """A list column as (rows, parts, width)."""
    return column.flatten().to_numpy().reshape(len(column), parts, -1)


def spread_pivots(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries of one codebook that lie far apart: each next one is farthest from those before."""
    chosen = [int(((book - book.sum(axis=0) // len(book)) ** 2).sum(axis=1).argmax())]
    nearest = ((book - book[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((book - book[chosen[-1]]) ** 2).sum(axis=1))
    return book[chosen]


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (n, m) between whole-numbered rows of a and b."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray):
    """(index, squared distance, exact evaluations) of the nearest entry of each row of x.

    A difference between the distances of a row and of an entry to one pivot is never
    more than their own distance. Entries are taken in the order of that lower bound;
    a row is done once the bound of its next entry is above the least distance found.
    What remains is evaluated in whole numbers; ties go to the lower index.
    """
    n = len(x)
    bound = np.abs(to_pivots[:, None, :] - roots(book, pivots)[None, :, :]).max(axis=2)
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(n)
    index = order[:, 0]
    best = ((x - book[index]) ** 2).sum(axis=1)
    evaluated = n
    for turn in range(1, len(book)):
        entry = order[rows, turn]
        low = np.maximum(bound[rows, entry] * (1 - MARGIN) - MARGIN, 0.0)
        open_rows = low * low <= best[rows]
        rows, entry = rows[open_rows], entry[open_rows]
        if not len(rows):
            break
        evaluated += len(rows)
        found = ((x[rows] - book[entry]) ** 2).sum(axis=1)
        closer = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[closer]], index[rows[closer]] = found[closer], entry[closer]
    return index, best, evaluated


def first_books(whole: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids, ties by the vector."""
    seeds = whole.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if not seeds:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    return np.array([r["x"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, -1).swapaxes(0, 1)


def with_pivot_distances(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``near``: the distances of every part to the pivots of its position, worked out once."""
    parts = len(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cut(batch.column("x"), parts)
            near = np.stack([roots(x[:, p], pivots[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.FixedSizeListArray.from_arrays(near.ravel(), near[0].size).cast(pa.list_(pa.float64())),
            ], names=[*batch.schema.names, "near"])

    return whole.mapInArrow(work, "vec_id long, label string, x array<long>, near array<double>")


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray):
    """(rows, parts) indexes and squared distances, and x, of one batch."""
    parts = len(books)
    x, near = _cut(batch.column("x"), parts), _cut(batch.column("near"), parts)
    index, error = np.empty((len(x), parts), dtype=np.int64), np.empty((len(x), parts), dtype=np.int64)
    for p in range(parts):
        index[:, p], error[:, p], _ = nearest_entries(x[:, p], near[:, p], books[p], pivots[p])
    return index, error, x


def next_books(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Every entry replaced by the componentwise floor of the mean of its parts; unused entries stay.

    A task hands on one row per entry; Spark sums them, exactly, to one row per entry.
    """
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                index, _, x = _assigned(batch, books, pivots)
                for p in range(parts):
                    count[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(total[p], index[:, p], x[:, p])
        used = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array(used, pa.int64()), "n": pa.array(count.ravel()[used]),
            "total": pa.array(list(total.reshape(-1, width)[used]), pa.list_(pa.int64())),
        })

    summed = table.select("x", "near").mapInArrow(work, "entry long, n long, total array<long>").groupBy("entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")
    ).collect()  # one row per entry
    out = books.copy().reshape(-1, width)
    for row in summed:
        out[row["entry"]] = [t // row["n"] for t in row["total"]]
    return out.reshape(books.shape)


def fit_books(table: DataFrame, books: np.ndarray, pivots: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        books = next_books(table, books, pivots)
    return books


def encode(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared distances summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            index, error, _ = _assigned(batch, books, pivots)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.array([row.tobytes().hex() for row in index.astype(np.uint8)], pa.string()), pa.array(error.sum(axis=1)),
            ], names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(work, "vec_id long, label string, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, **columns,
) -> DataFrame:
    """One row per usable input row: vec_id, code, error, label_error, codebooks_sha256.

    Each of ``parts`` positions has a codebook of at most 256 ``entries``. Which rows are left out says
    ``whole_vectors``. With fewer usable rows than entries the codebooks are that
    much smaller. Null ids come after all others as seeds and are encoded too; repeated rows are
    encoded and counted each; null labels are one label. An empty table gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = stage(whole_vectors(vectors, parts, **columns), "whole_vectors")
    books = first_books(whole, parts, entries)
    if not books.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    fixed = np.stack([spread_pivots(book, pivots) for book in books])
    table = stage(with_pivot_distances(whole, fixed), "pivot_distances")
    books = fit_books(table, books, fixed, rounds)
    coded = stage(encode(table, books, fixed), "codes").withColumn(
        "_label", F.concat(F.col("label").isNotNull().cast("string"), F.coalesce("label", F.lit("")))
    )
    errors = stage(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label_errors")
    return join_groups(coded, errors, "_label", F.struct("vec_id", "code")).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
