"""Per-user generation parameters: checked writes, their history, and reads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.parsing import parse_bool, parse_double, parse_integer, stored_double
from parley.operators.skew import MAX_GROUP_ROWS, last_known
from parley.schemas import PARAMETERS


class ParamChange(NamedTuple):
    users: DataFrame
    audit: DataFrame
    rejected: DataFrame


VALUES = {"double": "as_double", "bigint": "as_integer", "boolean": "as_boolean"}


def check_params(changes: DataFrame) -> DataFrame:
    """Add the typed values and a ``status``: 'ok' or the error text of the write."""
    name, raw = F.col("parameter"), F.col("raw_value")

    def of_kind(kind: str) -> Column:
        return name.isin(*[n for n, k in PARAMETERS.items() if k == kind])

    typed = changes.withColumns(
        {
            "as_double": F.when(of_kind("double"), parse_double(raw)),
            "as_integer": F.when(of_kind("bigint"), parse_integer(raw)),
            "as_boolean": F.when(of_kind("boolean"), parse_bool(raw)),
        }
    )
    valid = F.greatest(*[F.col(column).isNotNull() for column in VALUES.values()])
    invalid = F.concat(F.lit("Invalid "), name, F.lit(": "), raw)
    return typed.withColumn(
        "status",
        F.when(valid, F.lit("ok"))
        .when(name == "samplers", F.lit("Samplers order configuration is currently WIP"))
        .when(~name.isin(*PARAMETERS), F.concat(F.lit("Unknown parameter: "), name))
        .otherwise(invalid),
    ).withColumn("as_double", stored_double(F.col("as_double")))


def apply_param_changes(
    users: DataFrame,
    changes: DataFrame,
    create_users: bool = True,
    default_prompt: str = "",
    max_group: int = MAX_GROUP_ROWS,
) -> ParamChange:
    """Write ``changes(user_id, parameter, raw_value, ts, seq)``: the last valid write counts.

    A user is created before its write is checked, so even an invalid write
    creates one. The audit has every change with its status, old and new value.
    """
    ids = users.select(F.col("id").alias("user_id"))
    rejected = changes.filter(F.lit(False))
    if not create_users:
        rejected = changes.join(ids, "user_id", "left_anti")
        changes = changes.join(ids, "user_id", "left_semi")
    checked = check_params(changes)
    # Reduced to one row per user and parameter before the shuffle, then to one
    # map of at most as many entries as there are parameters.
    written = F.struct("ts", "seq", F.struct(*VALUES.values()).alias("value"))
    last = checked.groupBy("user_id", "parameter").agg(
        F.max(F.when(F.col("status") == "ok", written)).alias("last")
    )
    last = last.withColumn("value", F.col("last.value"))
    entries = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("parameter", "value")))
    last = last.groupBy(F.col("user_id").alias("id")).agg(
        F.map_from_entries(entries).alias("written")
    )
    # Users only known from their changes come in here, so changes are scanned once.
    joined = users.join(last, "id", "full").withColumn(
        "system_prompt", F.coalesce("system_prompt", F.lit(default_prompt))
    )
    cells = {name: F.try_element_at("written", F.lit(name)) for name in PARAMETERS}
    written = joined.withColumns(
        {
            name: F.when(cell.isNotNull(), cell[VALUES[PARAMETERS[name]]]).otherwise(F.col(name))
            for name, cell in cells.items()
        }
    ).select(*users.columns)
    return ParamChange(written, param_audit(users, checked, max_group), rejected)


def param_audit(users: DataFrame, checked: DataFrame, max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """Old and new value of every write, as text; invalid writes leave the old value."""
    value = F.coalesce(*[F.col(column).cast("string") for column in VALUES.values()])
    written = checked.withColumn("_new", F.when(F.col("status") == "ok", F.struct(value.alias("v"))))
    placed = last_known(written, ["user_id", "parameter"], ["ts", "seq"], "_new", "_old", max_group)
    stored = users.select(
        F.col("id").alias("user_id"),
        F.create_map(
            *[part for n in PARAMETERS for part in (F.lit(n), F.col(n).cast("string"))]
        ).alias("_stored"),
    )
    old = F.when(F.col("_old").isNotNull(), F.col("_old.v")).otherwise(
        F.try_element_at("_stored", F.col("parameter"))
    )
    return placed.join(stored, "user_id", "left").select(
        "user_id",
        "parameter",
        "raw_value",
        "ts",
        "seq",
        "status",
        old.alias("old_value"),
        F.when(F.col("status") == "ok", F.col("_new.v")).otherwise(old).alias("new_value"),
    )


def get_params(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer ``requests(user_id, parameter, ...)`` for known users with their prompt or an error."""
    asked = F.col("parameter")
    prompts = users.select(F.col("id").alias("user_id"), "system_prompt")
    return (
        requests.join(prompts, "user_id")
        .withColumn(
            "reply",
            F.when(asked.isNull(), _quoted("* **System prompt**: "))
            .when(asked == "system-prompt", _quoted("Your system prompt is "))
            .otherwise(F.concat(F.lit("Unknown parameter: "), asked)),
        )
        .drop("system_prompt")
    )


def _quoted(label: str) -> Column:
    return F.concat(F.lit(label), F.lit("`"), F.col("system_prompt"), F.lit("`"))
