"""Command and admin settings as small tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from parley.schemas import ADMINS, COMMANDS, DEFAULT_COMMANDS


def commands_table(
    spark: SparkSession, commands: Mapping[str, tuple[str, bool]] = DEFAULT_COMMANDS
) -> DataFrame:
    """One row per command: its key, the word that calls it, and whether only admins may."""
    rows = [(key, word, admin) for key, (word, admin) in commands.items()]
    return spark.createDataFrame(rows, COMMANDS)


def admins_table(spark: SparkSession, admin_ids: Iterable[int] = ()) -> DataFrame:
    return spark.createDataFrame([(admin,) for admin in admin_ids], ADMINS)
