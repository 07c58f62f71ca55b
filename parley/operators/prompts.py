"""Histories rendered into prompts, and their size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.templates import CHATML, ChatTemplate, token_estimate
from parley.operators.responses import joined
from parley.schemas import USER

MESSAGES_PER_PART = 65_536


def format_chats(
    messages: DataFrame,
    template: ChatTemplate = CHATML,
    messages_per_part: int = MESSAGES_PER_PART,
) -> DataFrame:
    """One prompt per user. Messages are joined within parts first, so that a long history is
    sorted by many tasks; only its finished prompt meets in one row.
    """
    text = template.render(F.col("role"), F.col("message")).alias("text")
    pieces = messages.select("user_id", _part("position", messages_per_part), "position", text)
    if template.generation:
        # The ending joins the last part as one more piece, which saves
        # shuffling the finished prompts again.
        last = messages.groupBy("user_id").agg(_spoke_last().alias("last")).filter("last % 2 = 1")
        last = last.withColumn("position", F.expr("last div 2"))
        pieces = pieces.union(
            last.select(
                "user_id",
                _part("position", messages_per_part),
                F.col("position") + 1,
                F.lit(template.generation),
            )
        )
    parts = pieces.groupBy("user_id", "part").agg(joined("position", "text").alias("text"))
    prompt = F.concat(F.lit(template.start), joined("part", "text")).alias("prompt")
    return parts.groupBy("user_id").agg(prompt)


def _part(position: str, size: int) -> Column:
    return F.expr(f"{position} div {size}").alias("part")


def _spoke_last() -> Column:
    """Last position and, in the lowest bit, whether it is the user's: one number to aggregate."""
    return F.max(F.col("position") * 2 + (F.col("role") == USER).cast("int"))


def _generation(template: ChatTemplate, spoke_last: Column) -> Column:
    return F.when(spoke_last % 2 == 1, F.lit(template.generation)).otherwise("")


def user_stats(
    messages: DataFrame,
    template: ChatTemplate = CHATML,
    context_length: int = 8192,
    token_rule: Callable[[Column], Column] = token_estimate,
) -> DataFrame:
    """Message count, prompt length, token estimate and share of the context per user.

    Sizes are summed over rendered messages, so no prompt is ever built and every
    aggregate is combined before the shuffle. The token rule must not join text
    across messages, which holds for templates that end messages in a line break.
    """
    text = template.render(F.col("role"), F.col("message"))
    measured = messages.select("user_id", "position", "role", text.alias("text"))
    totals = measured.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum(token_rule(F.col("text"))).cast("bigint").alias("tokens"),
        _spoke_last().alias("last"),
    )
    extra = F.concat(F.lit(template.start), _generation(template, F.col("last")))
    tokens = F.col("tokens") + token_rule(extra)
    return totals.select(
        "user_id",
        "messages",
        (F.col("chars") + F.length(extra)).alias("prompt_chars"),
        tokens.alias("prompt_tokens"),
        F.lit(context_length).cast("bigint").alias("context_length"),
        (tokens / F.lit(context_length) * 100).alias("context_percent"),
    )


def stats_replies(stats: DataFrame) -> DataFrame:
    """The text a user is shown for its row of ``user_stats``."""
    share = F.expr("format_number(context_percent, '0.00')")
    # The wording of the reply.
    text = F.concat(
        F.lit("Messages in chat history (including system prompt): "),
        F.col("messages"),
        F.lit("\nCurrent prompt length (tokens): "),
        F.col("prompt_tokens"),
        F.lit("/"),
        F.col("context_length"),
        F.lit(" ("),
        share,
        F.lit("% of available context used)\nCurrent prompt length (characters): "),
        F.col("prompt_chars"),
    )
    return stats.select("user_id", text.alias("reply"))
