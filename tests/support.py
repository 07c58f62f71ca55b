"""Small stores in the shape of the jobs' inputs."""

from datetime import datetime

from pyspark.sql import functions as F

from parley.operators.messages import append_messages
from parley.operators.users import add_users
from parley.sources.tables import empty_messages, empty_users

DEFAULT = "Be brief."
PROMPT_A = "Answer in verse."
PROMPT_B = "Answer in prose, please."

DIALOGUE = [
    (user, role, text)
    for user in (1, 2)
    for role, text in [
        ("user", "question one"),
        ("assistant", "answer one"),
        ("user", "question two"),
        ("assistant", "answer two"),
    ]
]


def users_of(spark, prompts, default=""):
    new = spark.createDataFrame(
        [(user, prompt, n) for n, (user, prompt) in enumerate(prompts)],
        "id bigint, system_prompt string, arrival bigint",
    )
    return add_users(empty_users(spark), new, default).users


def new_messages(spark, lines):
    rows = [(user, role, text, datetime(2222, 11, 22), n) for n, (user, role, text) in enumerate(lines)]
    return spark.createDataFrame(
        rows, "user_id bigint, role string, message string, timestamp timestamp_ntz, arrival bigint"
    )


def dialogue_store(spark, lines=DIALOGUE):
    added = append_messages(empty_users(spark), empty_messages(spark), new_messages(spark, lines))
    return added.users.cache(), added.messages.cache()


def history(messages, user):
    rows = messages.filter(F.col("user_id") == user).orderBy("position").collect()
    return [(row.position, row.message) for row in rows]


def prompts_of(users):
    return {row.id: row.system_prompt for row in users.collect()}


def flags(status, flag, order="arrival"):
    return [row[flag] for row in status.orderBy(order).collect()]
