"""Every job on the given tables, by name: ``job(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import fence_open, last_separator
from parley.functions.times import from_iso, to_iso
from parley.operators import lookups, params, prompts, responses, routing, texts, turns
from parley.operators import messages as message_jobs
from parley.operators import users as user_jobs
from parley.plans import inputs
from parley.schemas import DEFAULT_PROMPT, PARAMETERS
from parley.session import new_folder
from parley.sources.log import ConversationLog, new_log
from parley.sources.settings import admins_table, commands_table
from parley.sources.tables import read_messages, read_users
from parley.streaming.conversations import answer_updates, stream_answers, stream_commands, stream_turns, user_states
from parley.streaming.segments import segment_stream
from parley.streaming.sinks import foreach_batch_sink, to_batch_folders
from parley.streaming.throttle import throttle_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NEW_DEFAULT = "You answer in one sentence."
SHORT_LIMIT = 500
STREAM_LIMIT = 400
COOLDOWN_MS = 6 * 3600 * 1000
EDIT_MS = 750
USER_COLUMNS = ["id", "system_prompt"]
SETTING_COLUMNS = ["id", "system_prompt", *PARAMETERS]


def query(job: Query) -> Query:
    QUERIES[job.__name__] = job
    return job


# --- lookups


@query
def lookup_users(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.event_users(spark, folder, "id")
    found = lookups.lookup_users(inputs.users(spark, folder), keys)
    return found.select(*USER_COLUMNS, "penalize_nl")


@query
def lookup_messages(spark: SparkSession, folder: str) -> DataFrame:
    ids = inputs.message_requests(spark, folder)
    return lookups.lookup_messages(inputs.messages(spark, folder), ids)


@query
def nth_messages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = inputs.position_requests(spark, folder)
    return lookups.nth_messages(inputs.messages(spark, folder), wanted)


@query
def messages_after(spark: SparkSession, folder: str) -> DataFrame:
    cutoffs = (
        inputs.position_requests(spark, folder)
        .groupBy("user_id")
        .agg(F.min("position").alias("from_position"))
    )
    return lookups.messages_after(inputs.messages(spark, folder), cutoffs)


@query
def users_exist(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.event_users(spark, folder, "id")
    return lookups.users_exist(inputs.users(spark, folder), keys)


@query
def users_have_messages(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.event_users(spark, folder)
    return lookups.users_have_messages(inputs.messages(spark, folder), keys)


@query
def next_positions(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.event_users(spark, folder)
    return lookups.next_positions(inputs.messages(spark, folder), keys)


@query
def user_histories(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.user_requests(spark, folder).selectExpr("id AS user_id")
    return lookups.user_histories(inputs.messages(spark, folder), keys)


@query
def last_messages(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.last_messages(inputs.messages(spark, folder))


# --- users


def _add_users(spark: SparkSession, folder: str) -> user_jobs.UserChange:
    new = inputs.new_users(spark, folder)
    return user_jobs.add_users(inputs.users(spark, folder), new, DEFAULT_PROMPT)


@query
def add_users(spark: SparkSession, folder: str) -> DataFrame:
    return _add_users(spark, folder).users.select(*USER_COLUMNS)


@query
def add_users_status(spark: SparkSession, folder: str) -> DataFrame:
    return _add_users(spark, folder).status


@query
def get_or_create_users(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.new_users(spark, folder)
    found = user_jobs.get_or_create_users(inputs.users(spark, folder), keys, DEFAULT_PROMPT)
    return found.select(*USER_COLUMNS)


def _delete_users(spark: SparkSession, folder: str) -> user_jobs.StoreChange:
    requests = inputs.user_requests(spark, folder)
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return user_jobs.delete_users(known, stored, requests)


@query
def delete_users(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_users(spark, folder).users.select(*USER_COLUMNS)


@query
def delete_users_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_users(spark, folder).messages


@query
def delete_users_status(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_users(spark, folder).status


def _default_prompt(spark: SparkSession, folder: str) -> user_jobs.UserChange:
    known = inputs.users(spark, folder)
    return user_jobs.change_default_prompt(known, DEFAULT_PROMPT, NEW_DEFAULT)


@query
def change_default_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return _default_prompt(spark, folder).users.select(*USER_COLUMNS)


@query
def change_default_prompt_count(spark: SparkSession, folder: str) -> DataFrame:
    return _default_prompt(spark, folder).status


def _user_prompts(spark: SparkSession, folder: str, create: bool = True) -> user_jobs.StoreChange:
    changes = inputs.prompt_changes(spark, folder)
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return user_jobs.change_user_prompts(known, stored, changes, create)


@query
def change_user_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _user_prompts(spark, folder).users.select(*USER_COLUMNS)


@query
def change_user_prompts_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _user_prompts(spark, folder).messages


@query
def change_user_prompts_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _user_prompts(spark, folder, create=False).status


def _reset_params(spark: SparkSession, folder: str) -> user_jobs.StoreChange:
    requests = inputs.reset_requests(spark, folder)
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return user_jobs.reset_params(known, stored, requests, NEW_DEFAULT)


@query
def reset_params(spark: SparkSession, folder: str) -> DataFrame:
    return _reset_params(spark, folder).users.select(*USER_COLUMNS)


@query
def reset_params_status(spark: SparkSession, folder: str) -> DataFrame:
    return _reset_params(spark, folder).status


# --- messages


def _append(spark: SparkSession, folder: str, create: bool = True) -> message_jobs.Appended:
    new = inputs.new_messages(spark, folder)
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return message_jobs.append_messages(known, stored, new, create, DEFAULT_PROMPT)


@query
def append_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _append(spark, folder).messages


@query
def append_messages_users(spark: SparkSession, folder: str) -> DataFrame:
    return _append(spark, folder).users.select(*USER_COLUMNS)


@query
def append_messages_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _append(spark, folder, create=False).rejected


def _delete_messages(spark: SparkSession, folder: str) -> message_jobs.Deleted:
    requests = inputs.message_requests(spark, folder)
    return message_jobs.delete_messages(inputs.messages(spark, folder), requests)


@query
def delete_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_messages(spark, folder).messages


@query
def delete_messages_status(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_messages(spark, folder).status


def _delete_by_position(spark: SparkSession, folder: str) -> message_jobs.Deleted:
    requests = inputs.position_requests(spark, folder)
    return message_jobs.delete_by_position(inputs.messages(spark, folder), requests)


@query
def delete_by_position(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_by_position(spark, folder).messages


@query
def delete_by_position_status(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_by_position(spark, folder).status


@query
def clear_messages(spark: SparkSession, folder: str) -> DataFrame:
    doomed = inputs.user_requests(spark, folder).selectExpr("id AS user_id")
    return message_jobs.clear_messages(inputs.messages(spark, folder), doomed)


# --- parameters


def _param_changes(spark: SparkSession, folder: str, create: bool = True) -> params.ParamChange:
    changes = inputs.param_changes(spark, folder)
    return params.apply_param_changes(inputs.users(spark, folder), changes, create, DEFAULT_PROMPT)


@query
def apply_param_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _param_changes(spark, folder).users.select(*SETTING_COLUMNS)


@query
def param_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = _param_changes(spark, folder).audit
    number = ["old_value", "new_value"]
    is_double = F.col("parameter").isin(*[n for n, kind in PARAMETERS.items() if kind == "double"])
    # Engines spell doubles differently as text, so they are compared as numbers.
    for name in number:
        audit = audit.withColumn(f"{name}_number", F.when(is_double, F.col(name).cast("double")))
        audit = audit.withColumn(name, F.when(~is_double, F.col(name)))
    return audit


@query
def apply_param_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _param_changes(spark, folder, create=False).rejected


@query
def get_params(spark: SparkSession, folder: str) -> DataFrame:
    return params.get_params(inputs.users(spark, folder), inputs.get_requests(spark, folder))


# --- prompts and texts


@query
def format_chats(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.format_chats(inputs.messages(spark, folder))


@query
def user_stats(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.user_stats(inputs.messages(spark, folder))


@query
def stats_replies(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.stats_replies(user_stats(spark, folder))


@query
def last_separators(spark: SparkSession, folder: str) -> DataFrame:
    found = last_separator(F.col("text")).alias("found")
    return inputs.table(spark, folder, "documents").select("doc_id", found).select("doc_id", "found.*")


@query
def open_fences(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.fenced_documents(spark, folder)
    return documents.select("doc_id", fence_open(F.col("text")).alias("whole"))


@query
def split_once(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.fenced_documents(spark, folder)
    return texts.split_once(documents, "text", SHORT_LIMIT).drop("text")


@query
def split_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return texts.split_texts(documents, "text")


@query
def split_fenced_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts.split_texts(inputs.fenced_documents(spark, folder), "text", SHORT_LIMIT)


@query
def iso_times(spark: SparkSession, folder: str) -> DataFrame:
    text = to_iso(F.col("ts"))
    found = inputs.table(spark, folder, "events").select("event_id", text.alias("text"))
    return found.withColumn("ts", from_iso(F.col("text")))


# --- routing


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.chat_events(inputs.table(spark, folder, "events"))
    return routing.route_commands(events, commands_table(spark))


def _allowed(spark: SparkSession, folder: str) -> DataFrame:
    commands, admins = commands_table(spark), admins_table(spark, inputs.ADMINS)
    return routing.check_permissions(_routed(spark, folder), commands, admins)


@query
def route_commands(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder)


@query
def check_permissions(spark: SparkSession, folder: str) -> DataFrame:
    return _allowed(spark, folder)


@query
def parse_param_commands(spark: SparkSession, folder: str) -> DataFrame:
    return routing.parse_param_commands(_routed(spark, folder))


@query
def removal_reactions(spark: SparkSession, folder: str) -> DataFrame:
    return routing.removal_reactions(inputs.reactions(spark, folder), inputs.BOT)


# --- responses


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.chunks(inputs.messages(spark, folder))


@query
def assemble_responses(spark: SparkSession, folder: str) -> DataFrame:
    return responses.assemble_responses(_chunks(spark, folder))


@query
def running_responses(spark: SparkSession, folder: str) -> DataFrame:
    return responses.running_responses(_chunks(spark, folder))


@query
def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return responses.chunk_texts(_chunks(spark, folder))


@query
def throttle_updates(spark: SparkSession, folder: str) -> DataFrame:
    updates = inputs.updates(inputs.table(spark, folder, "events"))
    return responses.throttle_updates(updates, COOLDOWN_MS)


# --- turns and commands


def _turns(spark: SparkSession, folder: str) -> message_jobs.Appended:
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return turns.ingest_turns(known, stored, inputs.turns(inputs.table(spark, folder, "events")))


@query
def ingest_turns(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).messages


@query
def ingest_turns_users(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).users.select(*USER_COLUMNS)


@query
def append_after_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Messages without ids behind stored turns; no id is given twice."""
    told, new = _turns(spark, folder), inputs.new_messages(spark, folder).drop("id")
    return message_jobs.append_messages(told.users, told.messages, new, default_prompt=DEFAULT_PROMPT).messages


def _commands(spark: SparkSession, folder: str) -> turns.Applied:
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return turns.apply_commands(known, stored, _allowed(spark, folder))


@query
def apply_commands(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).users.select(*USER_COLUMNS)


@query
def apply_commands_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).messages


@query
def apply_commands_replies(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).replies


# --- files, streams and the store


@query
def read_stored_users(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "users")
    inputs.users(spark, folder).write.json(path)
    return read_users(spark, path, "json").select(*USER_COLUMNS, "penalize_nl")


def _raw_messages(spark: SparkSession, folder: str) -> str:
    """Stored rows with ISO times; documents and events appear as rows with a bad role or time.

    Lines of pages break off within the record, as after a lost writer.
    """
    path = new_folder(spark, "messages")
    good = inputs.messages(spark, folder).withColumn("timestamp", to_iso(F.col("timestamp")))
    bad_role = inputs.table(spark, folder, "documents").selectExpr(
        f"doc_id + {inputs.NEW_IDS} AS id",
        "doc_id AS user_id",
        "'2024-01-01T00:00:00' AS timestamp",
        "0L AS position",
        "lang AS role",
        "text AS message",
    )
    bad_time = inputs.events(spark, folder).selectExpr(
        f"event_id + 2 * {inputs.NEW_IDS} AS id",
        "user_id",
        "event_type AS timestamp",
        "k AS position",
        "'user' AS role",
        "event_type AS message",
    )
    good.unionByName(bad_role).unionByName(bad_time).write.json(path)
    broken = inputs.table(spark, folder, "pages").selectExpr("""concat('{"id":', page_id, ',"message":"', url) AS value""")
    broken.filter("value IS NOT NULL").write.mode("append").text(path)
    return path


@query
def read_stored_messages(spark: SparkSession, folder: str) -> DataFrame:
    return read_messages(spark, _raw_messages(spark, folder), "json").valid


@query
def read_stored_messages_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return read_messages(spark, _raw_messages(spark, folder), "json").rejected


def _log(spark: SparkSession, folder: str) -> ConversationLog:
    known, stored = inputs.users(spark, folder), inputs.messages(spark, folder)
    return new_log(known, stored, new_folder(spark, "log"))


@query
def snapshot_users(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).read().users.select(*USER_COLUMNS)


@query
def snapshot_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).read().messages


@query
def streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "events")
    events = inputs.chat_events(inputs.event_stream(spark, folder))
    sink = to_batch_folders(path)
    foreach_batch_sink(events, sink, new_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = new_folder(spark, "stream")
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_folder(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def segment_streamed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    texts = inputs.as_messages(inputs.conversation_stream(spark, folder))
    return _run(spark, segment_stream(inputs.chunks(texts), STREAM_LIMIT))


@query
def throttle_streamed_updates(spark: SparkSession, folder: str) -> DataFrame:
    updates = inputs.updates(inputs.event_stream(spark, folder))
    return _run(spark, throttle_stream(updates, COOLDOWN_MS))


@query
def route_streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.chat_events(inputs.event_stream(spark, folder))
    return _run(spark, routing.route_commands(events, commands_table(spark)))


def _stream_turns(spark: SparkSession, folder: str, log: ConversationLog) -> None:
    arriving = inputs.turns(inputs.event_stream(spark, folder))
    stream_turns(arriving, log, new_folder(spark, "checkpoint")).awaitTermination()


def _stream_commands(spark: SparkSession, folder: str, log: ConversationLog) -> str:
    checkpoint = new_folder(spark, "checkpoint")
    arriving = inputs.chat_events(inputs.event_stream(spark, folder))
    stream_commands(
        arriving, commands_table(spark), admins_table(spark, inputs.ADMINS), log, checkpoint
    ).awaitTermination()
    return checkpoint


@query
def store_streamed_turns(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    _stream_turns(spark, folder, log)
    return log.read().messages


@query
def apply_streamed_commands(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    _stream_commands(spark, folder, log)
    return log.read().users.select(*USER_COLUMNS)


@query
def streamed_command_replies(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    _stream_commands(spark, folder, log)
    return log.added("commands").select("event_id", "user_id", "command_key", "reply")


@query
def streamed_user_states(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts that the command stream holds as state."""
    state = user_states(spark, _stream_commands(spark, folder, _log(spark, folder)))
    return state.select(F.col("user_id").alias("id"), "system_prompt")


@query
def store_turns_and_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Messages after both streams, from one log, in a version of its own."""
    log = _log(spark, folder)
    _stream_turns(spark, folder, log)
    _stream_commands(spark, folder, log)
    log.compact()
    return log.read().messages


@query
def show_streamed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over several files to bounded messages to throttled replies, in one streaming query."""
    chunks = inputs.told_chunks(inputs.messages(spark, folder))
    arriving = inputs.in_files(chunks, new_folder(spark, "chunks"))
    shown = _run(spark, answer_updates(arriving, STREAM_LIMIT, EDIT_MS))
    return shown.select("response_id", "step", "ts", "message", F.explode("actions").alias("action"))


@query
def store_streamed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Asked turns and streamed chunks to the stored messages of users who had none."""
    texts = inputs.messages(spark, folder)
    log = new_log(inputs.users(spark, folder), texts.limit(0), new_folder(spark, "log"))
    asked = inputs.in_files(inputs.asked_turns(texts), new_folder(spark, "asked"))
    stream_turns(asked, log, new_folder(spark, "checkpoint")).awaitTermination()
    chunks = inputs.in_files(inputs.told_chunks(texts), new_folder(spark, "chunks"))
    stream_answers(chunks, log, new_folder(spark, "checkpoint"), STREAM_LIMIT, EDIT_MS).awaitTermination()
    return log.read().messages
