"""Turn, command and answer streams added to a conversation log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from parley.operators.responses import action_list
from parley.operators.routing import check_permissions, route_commands
from parley.operators.turns import KEYED_COMMANDS, reply_to, stepped_commands
from parley.schemas import COOLDOWN_MS, DEFAULT_PROMPT, LENGTH_LIMIT, PREFIX
from parley.session import use_rocksdb_state
from parley.sources.log import ConversationLog
from parley.streaming.segments import segment_stream
from parley.streaming.sinks import foreach_batch_sink
from parley.streaming.throttle import mark_stream


def stream_turns(turns: DataFrame, log: ConversationLog, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add arriving turns(turn_id, user_id, prompt, answer, ts); a batch writes its own rows only."""
    return foreach_batch_sink(turns, lambda batch, n: log.append("turns", batch, checkpoint, n), checkpoint, every)


def stream_answers(
    chunks: DataFrame,
    log: ConversationLog,
    checkpoint: str,
    limit: int = LENGTH_LIMIT,
    cooldown_ms: int = COOLDOWN_MS,
    ttl_ms: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Chunks to bounded messages, to the actions that show them, and to the stored answer.

    One query with two stateful operators: segments by response, then edits by reply. Chunks may come
    in any order and batch; what is shown depends on their numbers and times only. The log's turns
    get an answer when its last chunk has come, or ``ttl_ms`` of event time after the last one seen.
    """
    shown = answer_updates(chunks, limit, cooldown_ms, ttl_ms)
    return foreach_batch_sink(shown, lambda batch, n: log.append("answers", batch, checkpoint, n), checkpoint, every)


def answer_updates(
    chunks: DataFrame, limit: int = LENGTH_LIMIT, cooldown_ms: int = COOLDOWN_MS, ttl_ms: int | None = None
) -> DataFrame:
    """One row per segment row, with the actions it causes; the message stands only where there is one."""
    segments = segment_stream(chunks, limit, ttl_ms)
    updates = segments.withColumnRenamed("response_id", "reply_id").withColumn("number", F.col("seq")).withColumn("seq", F.col("step"))
    marked = mark_stream(updates, cooldown_ms, more=["number", "chunk", "incomplete"])
    actions = action_list()
    return marked.select(
        F.col("reply_id").alias("response_id"),
        F.col("seq").alias("step"),
        F.col("number").alias("seq"),
        "ts",
        "chunk",
        F.when(F.size(actions) > 0, F.col("message")).alias("message"),
        actions.alias("actions"),
        F.col("end_of_response").alias("stop"),
        "incomplete",
    )


def stream_commands(
    events: DataFrame,
    commands: DataFrame,
    admins: DataFrame,
    log: ConversationLog,
    checkpoint: str,
    prefix: str = PREFIX,
    default_prompt: str = DEFAULT_PROMPT,
    every: str | None = None,
) -> StreamingQuery:
    """Apply arriving commands: one row per command is added, with what it changes and its reply.

    A user's prompt is state, begun from the log's users, so a reply names the prompt in force and no
    stored row is read again. ``user_states`` gives the state as a table.
    """
    routed = check_permissions(route_commands(events, commands, prefix), commands, admins)
    known = log.read(default_prompt).users.select(F.col("id").alias("user_id"), "system_prompt")
    applied = apply_stream(routed, known, default_prompt)
    return foreach_batch_sink(applied, lambda batch, n: log.append("commands", batch, checkpoint, n), checkpoint, every)


def apply_stream(routed: DataFrame, known: DataFrame, default_prompt: str = DEFAULT_PROMPT) -> DataFrame:
    """Allowed commands with the prompt each sets and the reply to it, by a user's prompt as state."""
    use_rocksdb_state(routed.sparkSession)
    stepped = stepped_commands(routed, default_prompt).filter(F.col("command_key").isin(*KEYED_COMMANDS))
    clears = (F.col("command_key") == "reset-conversation").alias("clears")
    narrow = stepped.select("event_id", "user_id", "ts", "command_key", "arguments", "parameter", F.col("_set").alias("given"), "creates", clears)
    schema = T.StructType([*narrow.schema.fields, T.StructField("before", T.StringType())])
    marked = narrow.groupBy("user_id").transformWithStateInPandas(
        PromptProcessor(default_prompt), schema, outputMode="Append", timeMode="None", initialState=known.groupBy("user_id")
    )
    return marked.withColumnRenamed("given", "_set").select(
        "event_id", "user_id", "ts", "command_key", F.col("_set").alias("system_prompt"), "clears", "creates",
        reply_to(F.col("before")).alias("reply"),
    )


class PromptProcessor(StatefulProcessor):
    """A user's prompt, and the last event that cleared the history (-1 for none)."""

    def __init__(self, default_prompt: str) -> None:
        self.default_prompt = default_prompt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.user = handle.getValueState("user", "system_prompt string, cleared bigint")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.user.update((initialState["system_prompt"].iloc[0], -1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # One user's commands of one micro-batch; none if the user is only begun.
        batches = [batch for batch in rows if len(batch)]
        if not batches:
            return
        arrived = pd.concat(batches).sort_values(["ts", "event_id"])
        known = self.user.exists()
        prompt, cleared = self.user.get() if known else (self.default_prompt, -1)
        before = []
        for event_id, given, clears, creates in zip(*[arrived[c].tolist() for c in ("event_id", "given", "clears", "creates")]):
            before.append(prompt)
            prompt = prompt if pd.isna(given) else given
            cleared = event_id if clears else cleared
            known = known or creates
        if known:
            self.user.update((prompt, cleared))
        yield arrived.assign(before=before)

    def close(self) -> None:
        pass


def user_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, system_prompt, cleared): the state of a command stream, read as a table."""
    state = spark.read.format("statestore").option("stateVarName", "user").load(checkpoint)
    return state.select("key.user_id", "value.system_prompt", "value.cleared")
