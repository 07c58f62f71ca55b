"""Typed reads of users and messages from files, and empty tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.times import from_iso
from parley.operators.lookups import is_known_role
from parley.schemas import MESSAGES, USERS


# Messages hold line breaks, so a CSV file is one task; large inputs come as many
# files. An unquoted empty field is missing, a quoted one is the empty text.
CSV = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "emptyValue": ""}


#: The column of rejected rows that holds a record which cannot be read as its format or types say.
RAW = "raw_line"


class ReadMessages(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


def read_users(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Users with declared types; an unset newline penalty reads as false."""
    # CSV has no lists.
    flat = T.StructType([f for f in USERS if f.name != "samplers"]) if format == "csv" else USERS
    users = _read(spark, path, format, flat)
    if format == "csv":
        users = users.withColumn("samplers", F.lit(None).cast("array<string>"))
    return users.withColumn("penalize_nl", F.coalesce("penalize_nl", F.lit(False)))


def read_messages(spark: SparkSession, path: str, format: str = "parquet") -> ReadMessages:
    """Messages whose times are ISO text.

    Rejected are rows with a bad time or role, rows that miss any value, and records that cannot be
    read, whose text stands in ``raw_line``; it is null where the columns hold what was read.
    Parquet has no such records.
    """
    raw = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
            for f in MESSAGES
        ]
    )
    if format == "parquet":
        rows = _read(spark, path, format, raw).withColumn(RAW, F.lit(None).cast("string"))
    else:
        rows = _read(spark, path, format, raw.add(RAW, "string"))
    time = from_iso(F.col("timestamp"))
    good = is_known_role(F.col("role")) & time.isNotNull() & F.col(RAW).isNull()
    for field in MESSAGES:
        good &= F.col(field.name).isNotNull()
    good = F.coalesce(good, F.lit(False))
    valid = rows.filter(good).withColumn("timestamp", time).drop(RAW)
    return ReadMessages(valid, rows.filter(~good))


def _read(spark: SparkSession, path: str, format: str, schema: T.StructType) -> DataFrame:
    options = {**(CSV if format == "csv" else {}), "columnNameOfCorruptRecord": RAW}
    return spark.read.schema(schema).options(**options).format(format).load(path)


def empty_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], USERS)


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGES)
