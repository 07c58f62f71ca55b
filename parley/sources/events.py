"""Inbound event streams from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_events(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str = "parquet",
    files: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the files below ``path``, optionally only names matching ``files``."""
    reader = spark.readStream.schema(schema).format(format)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
