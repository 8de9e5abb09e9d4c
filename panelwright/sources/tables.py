"""Parquet tables, the default storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_schemas: dict[tuple[str, str], T.StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. Its schema is read from the files once per session,
    as a catalog would hold it: every inference is a job of its own."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)
