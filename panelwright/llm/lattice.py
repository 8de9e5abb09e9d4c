"""Near-equal embeddings: random projections decoded to points of the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage
from .files import ship_package
from .graph import connected_components
from .minhash import _mix

DIMENSIONS = 8
TABLES = 6
#: Cells looked up beside a vector's own in every table.
PROBES = 3
#: Unit of the lattice after the projection of a unit vector, in standard deviations of one coordinate.
CELL = 1.5
#: Rows of a bucket compared in one step; a larger bucket is cut into blocks that meet pairwise.
BLOCK = 2048
SEED = 8128


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of ±1, or eight of ±1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd,
    round the coordinate that was farthest from a whole number the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    step = np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    near[odd, worst] += step
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def projection(dimension: int, table: int) -> np.ndarray:
    """Orthonormal random directions of one table."""
    random = np.random.default_rng([SEED, dimension, table]).normal(size=(dimension, DIMENSIONS))
    return np.linalg.qr(random)[0] if dimension >= DIMENSIONS else random


_POINT_WEIGHTS = _mix(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)


def _cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    whole = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    return _mix((whole * _POINT_WEIGHTS).sum(axis=-1, dtype=np.uint64) ^ salt).astype(np.int64)


def lattice_keys(vectors: np.ndarray, labels: np.ndarray, tables: int, probes: int, cell: float):
    """Keys of each vector's own cell (n, tables) and of the nearest others (n, tables, probes)."""
    n, dimension = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    shortest, scale = minimal_vectors(), np.sqrt(dimension) / cell
    homes, others = np.empty((n, tables), dtype=np.int64), np.empty((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        x = unit @ projection(dimension, t) * scale
        points = nearest_point(x)
        salt = _mix(labels.astype(np.uint64) + np.uint64(1000 * dimension + t))
        homes[:, t] = _cell_keys(points, salt)
        # |x - p - v|² falls with (x - p)·v, since all v are of one length.
        closest = np.argsort(-((x - points) @ shortest.T), axis=1, kind="stable")[:, :probes]
        others[:, t] = _cell_keys(points[:, None, :] + shortest[closest], salt[:, None])
    return homes, others


_HASHED = pa.schema([
    ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("homes", pa.list_(pa.int64())),
    ("others", pa.list_(pa.int64())),
])


def _hashed(groups: DataFrame, tables: int, probes: int, cell: float, stored: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, copies, labels = (batch.column(i).to_numpy() for i in range(3))
            rows = [np.asarray(v, dtype=np.float64) for v in batch.column(3).to_pylist()]
            for size in {len(r) for r in rows}:
                mine = np.array([i for i, r in enumerate(rows) if len(r) == size])
                vectors = np.array([rows[i] for i in mine])
                homes, others = lattice_keys(vectors, labels[mine], tables, probes, cell)
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes[mine]), pa.array(copies[mine]), pa.array([v.astype(stored).tobytes() for v in vectors], pa.binary()),
                    pa.array(list(homes), pa.list_(pa.int64())),
                    pa.array(list(others.reshape(len(mine), -1)), pa.list_(pa.int64())),
                ], schema=_HASHED)

    schema = "node long, copies long, vector binary, homes array<long>, others array<long>"
    return groups.select("node", "copies", F.xxhash64("label").alias("label_key"), "embedding").mapInArrow(work, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable by the links (a, b) among n positions."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


#: Rows of a cell that meet all others in one step.
_ROWS = 64


class _Cell:
    """The rows of one bucket, or of two blocks of one, as arrays in the order of their nodes."""

    def __init__(self, parts: list[dict[str, np.ndarray]], least: float, stored: str):
        columns = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
        order = np.argsort(columns["node"], kind="stable")
        columns = {name: values[order] for name, values in columns.items()}
        self.node, self.copies, self.own = columns["node"], columns["copies"], columns["own"]
        self.block, self.homes = columns["block"], columns["homes"]
        self.others = columns["others"].reshape(*self.homes.shape, -1)
        vectors = np.array([np.frombuffer(v, stored) for v in columns["vector"]], dtype=np.float64)
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.least = least

    def compare(self, key: int, across: bool) -> pa.RecordBatch | None:
        """Links of the cell: for each row how many it adds, and the smallest node it is linked to here.

        A pair meets in every cell that one of the two has as its own and the other
        visits. Its link is counted only in the first of them: the first table in
        which it meets, and there the own cell of the smaller node if the other
        visits that. A few rows at a time meet all others, so a dense cell holds
        neither its pairs nor their keys.
        """
        n = len(self.node)
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        for start in range(0, n, _ROWS):
            rows = np.arange(start, min(n, start + _ROWS))
            near = self.unit[rows] @ self.unit.T >= self.least
            near &= rows[:, None] < np.arange(n)[None, :]
            near &= self.own[rows][:, None] | self.own[None, :]
            if across:
                near &= self.block[rows][:, None] != self.block[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a = rows[a]
            root = _roots(n, np.concatenate([np.arange(n), a]), np.concatenate([root, b]))
            low = (self.homes[a] == self.homes[b]) | (self.homes[a][:, :, None] == self.others[b]).any(axis=2)
            high = (self.homes[b][:, :, None] == self.others[a]).any(axis=2)
            first = (low | high).argmax(axis=1)
            at = np.arange(len(a))
            here = np.where(low[at, first], self.homes[a, first], self.homes[b, first]) == key
            np.add.at(links, a[here], self.copies[b[here]])
            np.add.at(links, b[here], self.copies[a[here]])
        told = (links > 0) | (root != np.arange(n))
        if not told.any():
            return None
        return pa.RecordBatch.from_pydict({"node": self.node[told], "links": links[told], "root": self.node[root][told]})


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of a batch as arrays; the key lists have one length each."""
    n = batch.num_rows
    out = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "p", "q", "node", "own", "block", "copies")}
    out["own"] = out["own"].astype(bool)
    for name in ("homes", "others"):
        out[name] = batch.column(name).flatten().to_numpy().reshape(n, -1)
    vectors = np.empty(n, dtype=object)
    vectors[:] = batch.column("vector").to_pylist()
    return out | {"vector": vectors}


def _compared(cells: DataFrame, least: float, stored: str) -> DataFrame:
    """Compare within cells; the rows of a cell lie one after the other in its task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def finish():
            if sum(len(part["node"]) for part in parts) > 1:
                return _Cell(parts, least, stored).compare(at[0], at[1] != at[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _arrays(batch)
            places = np.stack([columns["key"], columns["p"], columns["q"]], axis=1)
            cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(places)]):
                where = tuple(places[start].tolist())
                if where != at:
                    if parts and (out := finish()):
                        yield out
                    at, parts = where, []
                parts.append({name: values[start:end] for name, values in columns.items()})
        if parts and (out := finish()):
            yield out

    return cells.mapInArrow(work, "node long, links long, root long")


def near_vectors(
    vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, cell: float = CELL,
    block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label and length are linked if their cosine in double precision
    is at least ``least``. In every table a vector is dealt to its own lattice cell
    and visits the ``probes`` next ones; what meets in a cell is compared exactly, so
    no false link enters. Recall depends on the tables (see the README).

    Equal vectors of a label are one node with a number of copies. A cell of more
    than ``block`` rows is cut into blocks and every two blocks meet in a group of
    their own, so no task holds an unbounded cell, and a cell hands on counts and a
    spanning forest, never its pairs. Null, zero or non-finite vectors, null labels
    and null ids link with nothing. Repeated rows are answered each and count as one
    other vector. An empty table gives no row; other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    table = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].cast("string").alias("label"),
        vectors[vector_column].cast("array<double>").alias("embedding"),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
        & F.exists("embedding", lambda x: x != 0)
    )
    groups = stage(
        usable.groupBy("label", "embedding").agg(
            F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies")
        ),
        "vectors",
    )
    kind = vectors.schema[vector_column].dataType
    stored = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    hashed = stage(_hashed(groups, tables, probes, cell, stored), "cells")
    own = hashed.select("node", F.explode("homes").alias("key"), F.lit(True).alias("own"))
    members = own.union(hashed.select("node", F.explode("others").alias("key"), F.lit(False)))
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("has_own")
    ).where("n > 1 and has_own").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "key", "own", "block", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q")
    )
    cells = dealt.join(hashed, "node").select(
        "key", "p", "q", "node", "own", "block", "copies", "vector", "homes", "others"
    ).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    told = stage(_compared(cells, least, stored), "links")
    counts = told.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(told.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = groups.join(counts, "node", "left").join(components, "node", "left").select(
        "label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "node").alias("component"),
    ).where("copies > 1 or links > 0")
    return table.join(known, ["label", "embedding"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(
            F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))
        ).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
