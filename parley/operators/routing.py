"""Chat and reaction events to commands. Works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import broadcast_if_small
from parley.schemas import DEFAULT_COMMANDS, PREFIX, REMOVAL_EMOJI

# Kinds of channel whose messages can be removed.
REMOVABLE_CHANNELS = ("text", "direct", "group", "thread")


def route_commands(events: DataFrame, commands: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Add ``command_key``, ``arguments`` and ``route`` to chat events.

    Routes: ignored, command, usage (inference without text), dm_inference
    (a direct message that is no command) and unknown.
    """
    content = F.col("content")
    heard = ~F.col("is_self") & (content.startswith(prefix) | F.col("is_dm"))
    # Strips any leading run of the prefix's characters, so "$$llm" works too.
    bare = F.ltrim(content, F.lit(prefix))
    space = F.instr(bare, " ")
    named = events.withColumns(
        {
            "cmd": F.when(space > 0, F.left(bare, space - 1)).otherwise(bare),
            "rest": F.when(space > 0, F.substring(bare, space + 1, F.length(bare))),
        }
    )
    matched = _with_keys(named, commands)
    key = F.col("command_key")
    route = (
        F.when(~heard, "ignored")
        .when((key == "inference") & F.col("rest").isNull(), "usage")
        .when(key.isNotNull(), "command")
        .when(F.col("is_dm"), "dm_inference")
        .otherwise("unknown")
    )
    routed = matched.withColumn("route", route)
    is_direct = F.col("route") == "dm_inference"
    return routed.select(
        "event_id",
        "ts",
        F.col("author_id").alias("user_id"),
        F.when(F.col("route").isin("command", "usage"), key)
        .when(is_direct, F.lit("inference"))
        .when(F.col("route") == "unknown", F.col("cmd"))
        .alias("command_key"),
        F.when(is_direct, content)
        .when(F.col("route") != "ignored", F.col("rest"))
        .alias("arguments"),
        "route",
    )


def _with_keys(named: DataFrame, commands: DataFrame) -> DataFrame:
    """Add ``command_key``: of commands that share a word, the first in the fixed order.

    A join, not an expression: a filter on what follows from the key would repeat an expression.
    """
    order = F.array_position(F.array(*[F.lit(key) for key in DEFAULT_COMMANDS]), F.col("command_key"))
    # Keys outside of the fixed order come after it, by name.
    first = F.min_by("command_key", F.struct(order == 0, order, "command_key")).alias("command_key")
    return named.join(broadcast_if_small(commands.groupBy("cmd").agg(first)), "cmd", "left")


def check_permissions(routed: DataFrame, commands: DataFrame, admins: DataFrame) -> DataFrame:
    """Add ``allowed``: everyone may use open commands, admins also the protected ones."""
    protected = commands.filter("requires_admin").select("command_key").distinct()
    protected = broadcast_if_small(protected.withColumn("protected", F.lit(True)))
    listed = admins.select(F.col("admin_id").alias("user_id")).distinct()
    listed = broadcast_if_small(listed.withColumn("is_admin", F.lit(True)))
    allowed = (F.col("route") != "command") | F.col("protected").isNull() | F.col("is_admin").isNotNull()
    checked = routed.join(protected, "command_key", "left").join(listed, "user_id", "left")
    return checked.select(*routed.columns, allowed.alias("allowed"))


def parse_param_commands(routed: DataFrame) -> DataFrame:
    """Split the arguments of set-param commands at the first space into name and value."""
    arguments = F.col("arguments")
    space = F.instr(arguments, " ")
    has_value = space > 0
    wanted = routed.filter((F.col("route") == "command") & (F.col("command_key") == "set-param"))
    return wanted.select(
        "event_id",
        "ts",
        "user_id",
        F.when(has_value, F.left(arguments, space - 1)).alias("parameter"),
        F.when(has_value, F.substring(arguments, space + 1, F.length(arguments))).alias("raw_value"),
        F.when(arguments.isNull(), "missing_args")
        .when(~has_value, "missing_value")
        .otherwise("ok")
        .alias("status"),
    )


def removal_reactions(
    reactions: DataFrame, bot_id: int, emoji: str = REMOVAL_EMOJI
) -> DataFrame:
    """Reactions that ask to remove one of the bot's own messages."""
    return reactions.filter(
        (F.col("message_author_id") == bot_id)
        & (F.col("user_id") != bot_id)
        & (F.col("emoji") == emoji)
        & F.col("channel_kind").isin(*REMOVABLE_CHANNELS)
    )
