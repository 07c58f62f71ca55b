"""Creating, changing and removing users: snapshots in, snapshots out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.lookups import lookup_users
from parley.schemas import DEFAULT_PROMPT, SYSTEM


class UserChange(NamedTuple):
    users: DataFrame
    status: DataFrame


class StoreChange(NamedTuple):
    users: DataFrame
    messages: DataFrame
    status: DataFrame


def add_users(users: DataFrame, new: DataFrame, default_prompt: str = "") -> UserChange:
    """Insert ``new(id, system_prompt, arrival)`` where the id is free.

    The first arrival of an id wins; NULL prompts take the default, empty ones
    stay. The status has one ``created`` flag per request.
    """
    prompt = F.coalesce("system_prompt", F.lit(default_prompt)).alias("system_prompt")
    first = new.groupBy("id").agg(
        F.min_by(F.struct("system_prompt"), "arrival").alias("given"),
        F.min("arrival").alias("arrival"),
    )
    created = first.join(users.select("id"), "id", "left_anti").select(
        "id", "arrival", F.col("given.system_prompt").alias("system_prompt")
    )
    winners = created.select("id", "arrival").withColumn("created", F.lit(True))
    status = (
        new.select("id", "arrival")
        .join(winners, ["id", "arrival"], "left")
        .withColumn("created", F.coalesce("created", F.lit(False)))
    )
    added = created.select("id", prompt)
    return UserChange(users.unionByName(added, allowMissingColumns=True), status)


def get_or_create_users(users: DataFrame, keys: DataFrame, default_prompt: str = "") -> DataFrame:
    """The users of ``keys(id, system_prompt, arrival)``; a prompt counts only for new ones."""
    return lookup_users(add_users(users, keys, default_prompt).users, keys)


def create_missing(users: DataFrame, ids: DataFrame, default_prompt: str) -> DataFrame:
    """``users`` plus a default user for every unknown id in ``ids(id)``."""
    missing = ids.select("id").distinct().join(users.select("id"), "id", "left_anti")
    added = missing.withColumn("system_prompt", F.lit(default_prompt))
    return users.unionByName(added, allowMissingColumns=True)


def delete_users(users: DataFrame, messages: DataFrame, requests: DataFrame) -> StoreChange:
    """Remove the users of ``requests(id, arrival)`` and all their messages.

    ``deleted`` is true for the first request of an existing user only.
    """
    doomed = requests.select("id")
    first = (
        requests.groupBy("id")
        .agg(F.min("arrival").alias("arrival"))
        .join(users.select("id"), "id", "left_semi")
        .withColumn("deleted", F.lit(True))
    )
    status = (
        requests.select("id", "arrival")
        .join(first, ["id", "arrival"], "left")
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    )
    kept = messages.join(doomed.withColumnRenamed("id", "user_id"), "user_id", "left_anti")
    return StoreChange(users.join(doomed, "id", "left_anti"), kept, status)


def change_default_prompt(users: DataFrame, old: str, new: str) -> UserChange:
    """Give every user whose prompt equals ``old`` the prompt ``new``; messages stay."""
    matches = F.col("system_prompt") == F.lit(old)
    changed = users.withColumn(
        "system_prompt", F.when(matches, F.lit(new)).otherwise(F.col("system_prompt"))
    )
    return UserChange(changed, users.agg(F.count_if(matches).alias("rows_changed")))


def change_user_prompts(
    users: DataFrame, messages: DataFrame, changes: DataFrame, create_users: bool = True
) -> StoreChange:
    """Set prompts from ``changes(user_id, system_prompt, ts, seq)``, the last one winning.

    All stored system messages of a user follow. An unknown user is created
    without messages, or its changes are the rejected rows.
    """
    final = changes.groupBy("user_id").agg(
        F.max_by("system_prompt", F.struct("ts", "seq")).alias("new_prompt")
    )
    unknown = changes.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    replaced = (
        users.join(
            final.withColumnRenamed("user_id", "id"), "id", "full" if create_users else "left"
        )
        .withColumn("system_prompt", F.coalesce("new_prompt", "system_prompt"))
        .select(*users.columns)
    )
    if create_users:
        unknown = changes.filter(F.lit(False))
    # Only system messages can change, so only they are joined.
    follows = F.col("role").eqNullSafe(SYSTEM)
    rewritten = (
        messages.filter(follows)
        .join(final, "user_id", "left")
        .withColumn("message", F.coalesce("new_prompt", "message"))
        .select(*messages.columns)
    )
    return StoreChange(replaced, rewritten.union(messages.filter(~follows)), unknown)


def reset_params(
    users: DataFrame,
    messages: DataFrame,
    requests: DataFrame,
    default_prompt: str = DEFAULT_PROMPT,
) -> StoreChange:
    """Reset the parameter named in ``requests(user_id, parameter, ts, seq)``.

    Only the system prompt can be reset; the status tells what became of each request.
    """
    known = F.col("parameter") == "system-prompt"
    changes = requests.filter(known).withColumn("system_prompt", F.lit(default_prompt))
    changed = change_user_prompts(users, messages, changes)
    status = requests.withColumn(
        "status",
        F.when(F.col("parameter").isNull(), F.lit("Missing parameter name!"))
        .when(known, F.lit("ok"))
        .otherwise(F.concat(F.lit("Unknown parameter: "), F.col("parameter"))),
    )
    return StoreChange(changed.users, changed.messages, status)
