"""Choosing and mapping columns by name, prefix, position or type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .order import add_row_id


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefixes)]


def select_columns(
    df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), drop: Sequence[str] = ()
) -> DataFrame:
    """Named columns, then those with a prefix, less the dropped ones."""
    wanted = list(names)
    if prefixes:
        wanted += [c for c in with_prefix(df, *prefixes) if c not in wanted]
    return df.select([c for c in wanted if c not in set(drop)])


def drop_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Drop columns by zero-based position."""
    return df.select([c for i, c in enumerate(df.columns) if i not in set(positions)])


def map_types(
    df: DataFrame, types: type[T.DataType] | tuple[type[T.DataType], ...],
    change: Callable[[Column], Column], keep: Sequence[str] = (),
) -> DataFrame:
    """Apply ``change`` to every column of the given types, except ``keep``."""
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in set(keep)]
    return df.withColumns({name: change(F.col(name)) for name in chosen})


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion."""
    return df.dropna("any", subset=list(subset) if subset else None)


def is_complete(names: Sequence[str]) -> Column:
    """The listwise condition as a flag, for aggregations that need both modes.

    As in ``complete_rows``, NaN is missing.
    """
    out = F.lit(True)
    for name in names:
        number = F.col(name).try_cast("double")
        out = out & F.col(name).isNotNull() & ~F.coalesce(F.isnan(number), F.lit(False))
    return out


def one_hot(df: DataFrame, name: str, levels: Sequence) -> DataFrame:
    """Replace a categorical column by one 0/1 column per given level.

    A NULL category and a level that is not listed are 0 in every column. For
    levels that only the data know, ``one_hot_vector`` has no bound.
    """
    flags = {f"{name}_{level}": F.coalesce((F.col(name) == F.lit(level)).cast("int"), F.lit(0)) for level in levels}
    return df.withColumns(flags).drop(name)


def one_hot_vector(df: DataFrame, name: str, out: str) -> DataFrame:
    """Add a sparse 0/1 vector over all levels in ascending order, however many there are.

    NULL has no 1 in it.
    """
    coded = index_levels(df, name, "_level")
    size = coded.agg(F.coalesce(F.max("_level") + 1, F.lit(0)).alias("n")).first()["n"]
    if not size:
        return coded.drop("_level").withColumn(out, F.lit(None).cast(VectorUDT()))
    # "keep" reads a code beyond the levels as a vector without a 1.
    encoder = OneHotEncoder(inputCol="_level", outputCol=out, handleInvalid="keep", dropLast=True)
    fitted = encoder.fit(coded.where(F.col("_level").isNotNull()))
    return fitted.transform(coded.withColumn("_level", F.coalesce("_level", F.lit(size)))).drop("_level")


def index_levels(df: DataFrame, name: str, out: str) -> DataFrame:
    """Zero-based code of each level in ascending order; NULL stays NULL.

    The levels are numbered as a table of their own and joined back, so their
    number is not bound by the driver. Spark broadcasts the level table when its
    measured size allows and splits hot levels otherwise.
    """
    levels = df.select(name).where(F.col(name).isNotNull()).distinct()
    numbered = add_row_id(levels, [name], out).withColumn(out, F.col(out) - 1)
    return df.join(numbered, on=name, how="left")


def index_by_appearance(df: DataFrame, name: str, out: str, position: Sequence[str]) -> DataFrame:
    """Zero-based code of each level in the order in which the levels first appear; NULL stays NULL.

    ``position`` are the columns that tell where a row stands, as ``read_csv`` gives
    them with ``place``. The least position of each level is found within tasks first;
    as in ``index_levels``, the level table is then numbered and joined back.
    """
    where = F.struct(*[F.col(p) for p in position])
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(where).alias("_first"))
    parts = [f"_first_{i}" for i in range(len(position))]
    flat = first.select(name, *[F.col("_first")[p].alias(part) for p, part in zip(position, parts)])
    numbered = add_row_id(flat, [*parts, name], out).select(name, (F.col(out) - 1).alias(out))
    return df.join(numbered, on=name, how="left")
