"""A conversation log in plain parquet folders, and the users and messages that follow from it.

A version is a folder with a snapshot of users and messages, written once, and below it what streams
have added since, each batch in a folder of its own named by its stream's checkpoint and number:

    version=3/users, version=3/messages
    version=3/turns/stream=<checkpoint>/batch=<number>, likewise commands and answers

A batch that is replayed overwrites its own folder, so it counts once; streams never write to the
same folder, so any number of them add to one version at a time, and adding costs what is added.
Nothing is rewritten: positions, prompts and cleared histories are derived when the log is read, by
the same jobs that work on tables.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.messages import clear_messages
from parley.operators.responses import assemble_responses
from parley.operators.turns import ingest_turns
from parley.operators.users import change_user_prompts, create_missing
from parley.schemas import DEFAULT_PROMPT, MESSAGES, USERS

#: Rows that streams add. A command row says what became of it: the prompt it set, whether it cleared.
ADDED = {
    "turns": "turn_id bigint, user_id bigint, prompt string, answer string, ts timestamp_ntz",
    "commands": "event_id bigint, user_id bigint, ts timestamp_ntz, command_key string, system_prompt string, "
    "clears boolean, creates boolean, reply string",
    "answers": "response_id bigint, step bigint, seq bigint, ts timestamp_ntz, chunk string, message string, "
    "actions array<string>, stop boolean, incomplete boolean",
}


class Snapshot(NamedTuple):
    users: DataFrame
    messages: DataFrame


class ConversationLog:
    """The log below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def versions(self) -> list[int]:
        """Versions whose snapshot is complete; messages are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/messages/_SUCCESS"))
        return sorted(int(one.getPath().getParent().getParent().getName().split("=")[1]) for one in found or [])

    def write_snapshot(self, snapshot: Snapshot) -> int:
        """A new version with these users and messages, and nothing added yet."""
        version = max(self.versions(), default=0) + 1
        for name, schema, table in zip(Snapshot._fields, (USERS, MESSAGES), snapshot):
            table.select(*schema.names).write.mode("overwrite").parquet(f"{self._folder(version)}/{name}")
        return version

    def compact(self, default_prompt: str = DEFAULT_PROMPT) -> int:
        """A new version of what the latest one says now. No stream may be running."""
        return self.write_snapshot(self.read(default_prompt))

    def append(self, kind: str, rows: DataFrame, checkpoint: str, batch: int) -> None:
        """A stream's batch, whole or not at all; a replay takes the place of the first try."""
        stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:24]
        typed = rows.to(self.spark.createDataFrame([], ADDED[kind]).schema)
        typed.write.mode("overwrite").parquet(f"{self._folder()}/{kind}/stream={stream}/batch={batch}")

    def added(self, kind: str) -> DataFrame:
        """All rows that streams have added to the latest version."""
        folder = f"{self._folder()}/{kind}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ADDED[kind])
        return self.spark.read.schema(ADDED[kind]).option("recursiveFileLookup", "true").parquet(folder)

    def turns(self) -> DataFrame:
        """Turns with the answers that were streamed, as far as these have ended."""
        chunks = self.added("answers").filter("chunk IS NOT NULL").select("response_id", "seq", F.col("chunk").alias("content"), "stop")
        answers = assemble_responses(chunks).filter("complete").select(F.col("response_id").alias("turn_id"), "response")
        found = self.added("turns").join(answers, "turn_id", "left")
        return found.withColumn("answer", F.coalesce("response", "answer")).drop("response")

    def actions(self) -> DataFrame:
        """What was shown of streamed answers: (response_id, step, ts, message, action)."""
        return self.added("answers").select("response_id", "step", "ts", "message", F.explode("actions").alias("action"))

    def read(self, default_prompt: str = DEFAULT_PROMPT) -> Snapshot:
        """Users and messages now.

        A user's history is what was told after the last clearing, by (time, id of turn or event). The
        last prompt counts, and system messages follow it. Nobody's rows are moved but those of users
        that have turns or commands.
        """
        folder = self._folder()
        users = self.spark.read.schema(USERS).parquet(f"{folder}/users")
        messages = self.spark.read.schema(MESSAGES).parquet(f"{folder}/messages")
        turns, commands = self.turns(), self.added("commands")
        cleared = F.max(F.struct("ts", "event_id")).alias("cleared")
        clears = commands.filter("clears").groupBy("user_id").agg(cleared)
        told = turns.join(clears, "user_id", "left").filter("cleared IS NULL OR struct(ts, turn_id) > cleared").drop("cleared")
        ids = turns.select("user_id").union(commands.filter("creates").select("user_id")).toDF("id")
        everyone = create_missing(users, ids, default_prompt)
        kept = clear_messages(messages, clears.select("user_id"))
        stored = ingest_turns(everyone, kept, told, default_prompt)
        changes = commands.filter("system_prompt IS NOT NULL").select(
            "user_id", "system_prompt", "ts", F.col("event_id").alias("seq")
        )
        changed = change_user_prompts(stored.users, stored.messages, changes)
        return Snapshot(changed.users.select(*USERS.names), changed.messages.select(*MESSAGES.names))

    def _folder(self, version: int | None = None) -> str:
        return f"{self.path}/version={version or max(self.versions(), default=0)}"


def new_log(users: DataFrame, messages: DataFrame, path: str) -> ConversationLog:
    """A log whose first version holds these users and messages."""
    log = ConversationLog(users.sparkSession, path)
    log.write_snapshot(Snapshot(users, messages))
    return log
