"""Whole turns and whole command batches applied to the store."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.messages import Appended, clear_messages, place_messages
from parley.operators.skew import MAX_GROUP_ROWS, largest_group, last_known
from parley.operators.users import change_user_prompts, create_missing
from parley.schemas import ASSISTANT, DEFAULT_PROMPT, SYSTEM, USER
from parley.session import durable


KEYED_COMMANDS = ("reset-conversation", "set-param", "reset-param", "get-param")


class Applied(NamedTuple):
    users: DataFrame
    messages: DataFrame
    replies: DataFrame


def ingest_turns(
    users: DataFrame,
    messages: DataFrame,
    turns: DataFrame,
    default_prompt: str = DEFAULT_PROMPT,
    max_group: int = MAX_GROUP_ROWS,
) -> Appended:
    """Store ``turns(turn_id, user_id, prompt, answer, ts)`` in order of turn_id.

    A user without messages first gets its system prompt as a message. An
    unanswered turn (NULL answer) leaves the user's message visible. Message ids
    are below zero, -1 - (3 * turn_id + 0..2) with turn_id from 0 on: a replayed
    turn gets the same ones, no numbering over all users is needed, and appended
    messages, whose own numbers are above zero, never share one.
    """
    ids = turns.select(F.col("user_id").alias("id"))
    everyone = create_missing(users, ids, default_prompt)
    talking = messages.select("user_id").join(turns.select("user_id"), "user_id", "left_semi")
    opening = (
        turns.groupBy("user_id")
        .agg(F.min("turn_id").alias("turn_id"), F.min_by("ts", "turn_id").alias("ts"))
        .join(talking.distinct(), "user_id", "left_anti")
        .join(everyone.select(F.col("id").alias("user_id"), "system_prompt"), "user_id")
        .select("user_id", *_line(SYSTEM, "system_prompt", 0))
    )
    asked = turns.select("user_id", *_line(USER, "prompt", 1))
    answered = turns.filter("answer IS NOT NULL").select("user_id", *_line(ASSISTANT, "answer", 2))
    new = opening.unionByName(asked).unionByName(answered)
    # A turn is at most a question and an answer, after one opening line per user.
    most = 2 * largest_group(turns, ["user_id"]) + 1
    added = place_messages(messages, new, max_group, most)
    return Appended(everyone, messages.unionByName(added), added, new.filter(F.lit(False)))


def _line(role: str, text: str, step: int) -> list[Column]:
    return [
        F.lit(role).alias("role"),
        F.col(text).alias("message"),
        F.col("ts").alias("timestamp"),
        (F.col("turn_id") * 3 + step).alias("arrival"),
        (-1 - (F.col("turn_id") * 3 + step)).alias("id"),
    ]


def apply_commands(
    users: DataFrame,
    messages: DataFrame,
    routed: DataFrame,
    default_prompt: str = DEFAULT_PROMPT,
    max_group: int = MAX_GROUP_ROWS,
) -> Applied:
    """Apply the allowed prompt and history commands of ``routed``, by (ts, event_id).

    Within one batch the last prompt of a user wins, and a history that is
    cleared at any point is gone, so both are set operations; only the replies
    look at the order, to name the prompt in force at their moment.
    """
    # Few and narrow rows that six of the steps below read.
    stepped = durable(stepped_commands(routed, default_prompt))
    everyone = create_missing(
        users, stepped.filter("creates").select(F.col("user_id").alias("id")), default_prompt
    )
    changes = stepped.filter("_set IS NOT NULL").select(
        "user_id", F.col("_set").alias("system_prompt"), "ts", F.col("event_id").alias("seq")
    )
    cleared = stepped.filter("command_key = 'reset-conversation'").select("user_id")
    changed = change_user_prompts(everyone, clear_messages(messages, cleared), changes)
    replies = _replies(everyone, stepped, max_group)
    return Applied(changed.users, changed.messages, replies)


def stepped_commands(routed: DataFrame, default_prompt: str) -> DataFrame:
    """The allowed commands with their ``parameter``, the prompt they set (``_set``), and whether
    they create an unknown user. Works on streams too."""
    commands = routed.filter("route = 'command' AND allowed")
    key, arguments = F.col("command_key"), F.col("arguments")
    space = F.instr(arguments, " ")
    name = F.when(key == "set-param", F.left(arguments, space - 1)).otherwise(arguments)
    value = F.when(key == "set-param", F.substring(arguments, space + 1, F.length(arguments)))
    stepped = commands.withColumns(
        {
            "parameter": F.when(~((key == "set-param") & (space <= 0)), name),
            "prompt": F.when(key == "reset-param", F.lit(default_prompt)).otherwise(value),
        }
    )
    writes = key.isin("set-param", "reset-param") & (F.col("parameter") == "system-prompt")
    creates = (key == "get-param") | ((key == "set-param") & (space > 0)) | writes
    return stepped.withColumns({"_set": F.when(writes, F.col("prompt")), "creates": F.coalesce(creates, F.lit(False))})


def _replies(users: DataFrame, stepped: DataFrame, max_group: int) -> DataFrame:
    """What the sender of each command is told."""
    placed = last_known(stepped, ["user_id"], ["ts", "event_id"], "_set", "_before", max_group)
    stored = users.select(F.col("id").alias("user_id"), "system_prompt")
    answered = placed.filter(F.col("command_key").isin(*KEYED_COMMANDS))
    return answered.join(stored, "user_id", "left").select(
        "event_id", "user_id", "command_key", reply_to(F.coalesce("_before", "system_prompt")).alias("reply")
    )


def reply_to(before: Column) -> Column:
    """The reply to a stepped command when the sender's prompt is ``before``."""
    key, parameter = F.col("command_key"), F.col("parameter")
    # The texts of the replies.
    update = F.concat(
        F.lit("Updated system prompt!\nOld: ```\n"),
        before,
        F.lit("\n```\nNew: ```\n"),
        F.col("_set"),
        F.lit("```"),
    )
    unknown = F.concat(F.lit("Unknown parameter: "), parameter)
    missing = F.when(key == "set-param", "Missing parameter name and new value!").when(
        key == "reset-param", "Missing parameter name!"
    )
    return (
        F.when(key == "reset-conversation", "Message history cleared!")
        .when(F.col("arguments").isNull() & missing.isNotNull(), missing)
        .when((key == "set-param") & parameter.isNull(), "Missing value of the parameter!")
        .when(F.col("_set").isNotNull(), update)
        .when(key.isin("set-param", "reset-param"), unknown)
        .when((key == "get-param") & parameter.isNull(), _shown("* **System prompt**: `", before))
        .when(parameter == "system-prompt", _shown("Your system prompt is `", before))
        .when(key == "get-param", unknown)
    )


def _shown(label: str, prompt: Column) -> Column:
    return F.concat(F.lit(label), prompt, F.lit("`"))
