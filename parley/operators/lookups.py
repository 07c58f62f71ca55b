"""Keyed reads over users and messages, for many keys at once.

The small side of a join is not hinted: Catalyst and AQE broadcast it when its
measured size allows and otherwise shuffle, splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schemas import ROLES


def lookup_users(users: DataFrame, keys: DataFrame) -> DataFrame:
    """Users whose id is in ``keys(id)``; an unset newline penalty reads as false."""
    found = users.join(keys.select("id"), "id", "left_semi")
    return found.withColumn("penalize_nl", F.coalesce("penalize_nl", F.lit(False)))


def lookup_messages(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages whose id is in ``ids(id)``."""
    return messages.join(ids.select("id"), "id", "left_semi")


def nth_messages(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages at the places in ``wanted(user_id, position)``."""
    return messages.join(wanted.select("user_id", "position"), ["user_id", "position"], "left_semi")


def messages_after(messages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Messages behind ``cutoffs(user_id, from_position)``, one cutoff per user."""
    return messages.join(cutoffs.select("user_id", "from_position"), "user_id").filter(
        "position > from_position"
    )


def users_exist(users: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys(id)`` with a flag telling whether there is such a user."""
    return _with_flag(keys, users.select("id"), "id", "user_exists")


def users_have_messages(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys(user_id)`` with a flag telling whether the user has any message."""
    asked = messages.select("user_id").join(keys.select("user_id"), "user_id", "left_semi")
    return _with_flag(keys, asked.distinct(), "user_id", "has_messages")


def _with_flag(keys: DataFrame, present: DataFrame, key: str, flag: str) -> DataFrame:
    marked = present.withColumn(flag, F.lit(True))
    return keys.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def next_positions(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """The position the next message of each ``keys(user_id)`` gets; 0 without messages."""
    highest = (
        messages.select("user_id", "position")
        .join(keys.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg((F.max("position") + 1).alias("next_position"))
    )
    return keys.join(highest, "user_id", "left").withColumn(
        "next_position", F.coalesce("next_position", F.lit(0)).cast("bigint")
    )


def user_histories(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages of ``keys(user_id)`` in order; the range sort also splits a huge history."""
    found = messages.join(keys.select("user_id"), "user_id", "left_semi")
    return found.orderBy("user_id", "position")


def last_messages(messages: DataFrame) -> DataFrame:
    """The last message of each user: positions alone are aggregated, then their rows are kept."""
    last = messages.groupBy("user_id").agg(F.max("position").alias("position"))
    return messages.join(last, ["user_id", "position"], "left_semi").select(messages.columns)


def is_known_role(role: Column) -> Column:
    return role.isin(*ROLES)
