"""CSV with a header, ``NA`` for missing values and an optional leading index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.nulls import nan_to_null
from ..operators.order import add_row_id

# The missing-value token, and the name Spark gives an unnamed first column.
MISSING = "NA"
INDEX = "_c0"
PLACE = ["_file", "_block", "_turn"]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False, place: bool = False
) -> DataFrame:
    """Read a table; ``NA`` and empty fields become NULL, and so does NaN. A quote
    within a quoted field is doubled.

    Give the schema for known tables: inference costs one more scan. Say so if
    quoted fields may hold ``line_breaks``: such a file can't be split among tasks.
    With ``place`` the columns ``PLACE`` tell where a row stood: its file, the part of the
    file that its task read, and its turn in that part.
    """
    reader = spark.read.option("header", True).option("nullValue", MISSING).option("escape", '"')
    reader = reader.option("multiLine", line_breaks)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({name: nan_to_null(F.col(f"`{name}`")) for name in floating})
    if not place:
        return df
    return df.withColumns(dict(zip(PLACE, [
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id(),
    ])))


def write_csv(df: DataFrame, path: str, index_order: list[str] | None = None) -> None:
    """Write a table, with a leading row index in ``index_order`` if that is given."""
    if index_order:
        df = add_row_id(df, index_order, INDEX).select(INDEX, *df.columns)
    df.write.option("header", True).option("nullValue", MISSING).option("escape", '"').csv(path)


def with_index(schema: T.StructType) -> T.StructType:
    """The schema of a file written with an index."""
    return T.StructType([T.StructField(INDEX, T.LongType())] + schema.fields)


def drop_index(df: DataFrame) -> DataFrame:
    return df.drop(INDEX)
