"""Schemas of the tables and streams, and the fixed names and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# The roles a stored message may have.
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)

# Generation parameters and how their raw text is read.
PARAMETERS = {
    "temperature": "double",
    "dynatemp_range": "double",
    "dynatemp_exponent": "double",
    "top_k": "bigint",
    "top_p": "double",
    "min_p": "double",
    "n_predict": "bigint",
    "n_keep": "bigint",
    "tfs_z": "double",
    "typical_p": "double",
    "repeat_penalty": "double",
    "repeat_last_n": "bigint",
    "penalize_nl": "boolean",
    "presence_penalty": "double",
    "frequency_penalty": "double",
    "mirostat": "bigint",
    "mirostat_tau": "double",
    "mirostat_eta": "double",
    "seed": "bigint",
}

_TYPES = {"double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*field) for field in fields])


USERS = _schema(
    ("id", T.LongType(), False),
    ("system_prompt", T.StringType(), False),
    *[(name, _TYPES[kind], True) for name, kind in PARAMETERS.items()],
    ("samplers", T.ArrayType(T.StringType()), True),
)

MESSAGES = _schema(
    ("id", T.LongType(), False),
    ("user_id", T.LongType(), False),
    ("timestamp", T.TimestampNTZType(), False),
    ("position", T.LongType(), False),
    ("role", T.StringType(), False),
    ("message", T.StringType(), False),
)

CHUNKS = _schema(
    ("response_id", T.LongType(), False),
    ("seq", T.LongType(), False),
    ("ts", T.TimestampNTZType(), True),
    ("content", T.StringType(), False),
    ("stop", T.BooleanType(), False),
)

CHAT_EVENTS = _schema(
    ("event_id", T.LongType(), False),
    ("ts", T.TimestampNTZType(), False),
    ("author_id", T.LongType(), False),
    ("is_self", T.BooleanType(), False),
    ("is_dm", T.BooleanType(), False),
    ("content", T.StringType(), False),
)

REACTIONS = _schema(
    ("event_id", T.LongType(), False),
    ("message_id", T.LongType(), False),
    ("message_author_id", T.LongType(), False),
    ("user_id", T.LongType(), False),
    ("emoji", T.StringType(), False),
    ("channel_kind", T.StringType(), False),
)

COMMANDS = _schema(
    ("command_key", T.StringType(), False),
    ("cmd", T.StringType(), False),
    ("requires_admin", T.BooleanType(), False),
)

ADMINS = _schema(("admin_id", T.LongType(), False))

# Default settings.
DEFAULT_PROMPT = "You are a helpful AI assistant. Assist the user best to your ability."
PREFIX = "$"
LENGTH_LIMIT = 1990
COOLDOWN_MS = 750
REMOVAL_EMOJI = "💀"
DEFAULT_COMMANDS = {
    "inference": ("llm", False),
    "help": ("llm-help", False),
    "reset-conversation": ("llm-reset", False),
    "stats": ("llm-stats", False),
    "refresh": ("llm-refresh", True),
    "set-param": ("llm-set-param", False),
    "get-param": ("llm-get-param", False),
    "reset-param": ("llm-reset-param", False),
}
