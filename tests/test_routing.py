from datetime import datetime

import pytest

from parley.operators import routing as routing_module
from parley.operators.routing import (
    check_permissions,
    parse_param_commands,
    removal_reactions,
    route_commands,
)
from parley.operators.turns import apply_commands
from parley.schemas import ADMINS, CHAT_EVENTS, COMMANDS, REACTIONS
from parley.sources.settings import admins_table, commands_table
from tests.support import dialogue_store, history, prompts_of

NOW = datetime(2024, 1, 1)


def routed(spark, contents, prefix="$"):
    rows = [(n, NOW, 1, own, direct, text) for n, (text, direct, own) in enumerate(contents)]
    events = spark.createDataFrame(rows, CHAT_EVENTS)
    return route_commands(events, commands_table(spark), prefix)


def test_routes(spark):
    contents = [
        ("$llm hello there", False, False),
        ("$$llm hi", False, False),
        ("$llm", False, False),
        ("hello", False, False),
        ("hello you", True, False),
        ("$nope x", False, False),
        ("$llm-set-param system-prompt Be brief", False, False),
        ("$llm hi", True, True),
        ("$llm ", False, False),
        ("llm hi", True, False),
        ("$llm\nhi", False, False),
        ("$", False, False),
    ]
    found = routed(spark, contents).orderBy("event_id").collect()
    assert [(r.route, r.command_key, r.arguments) for r in found] == [
        ("command", "inference", "hello there"),
        ("command", "inference", "hi"),
        ("usage", "inference", None),
        ("ignored", None, None),
        ("dm_inference", "inference", "hello you"),
        ("unknown", "nope", "x"),
        ("command", "set-param", "system-prompt Be brief"),
        ("ignored", None, None),
        ("command", "inference", ""),
        ("command", "inference", "hi"),
        ("unknown", "llm\nhi", None),
        ("unknown", "", None),
    ]


def test_a_longer_prefix_strips_its_characters(spark):
    found = routed(spark, [("!?llm hi", False, False), ("?!llm hi", False, False)], "!?").collect()
    assert sorted(row.route for row in found) == ["command", "ignored"]


def test_permissions(spark):
    rows = [(1, NOW, user, False, False, text) for user in (1, 2) for text in ("$llm-refresh", "$llm-stats")]
    events = route_commands(spark.createDataFrame(rows, CHAT_EVENTS), commands_table(spark))
    checked = check_permissions(events, commands_table(spark), admins_table(spark, [2]))
    assert {(r.user_id, r.command_key): r.allowed for r in checked.collect()} == {
        (1, "refresh"): False, (1, "stats"): True, (2, "refresh"): True, (2, "stats"): True
    }


def test_param_commands(spark):
    texts = ["$llm-set-param", "$llm-set-param mood", "$llm-set-param mood ", "$llm-set-param top_k 5 6"]
    parsed = parse_param_commands(routed(spark, [(t, False, False) for t in texts])).orderBy("event_id")
    assert [(r.parameter, r.raw_value, r.status) for r in parsed.collect()] == [
        (None, None, "missing_args"), (None, None, "missing_value"), ("mood", "", "ok"), ("top_k", "5 6", "ok")
    ]


def test_reactions(spark):
    bot, skull = 9, "💀"
    rows = [
        (0, 1, bot, 2, skull, "text"),
        (1, 1, bot, bot, skull, "text"),
        (2, 1, 3, 2, skull, "text"),
        (3, 1, bot, 2, "👍", "text"),
        (4, 1, bot, 2, skull, "voice"),
        (5, 1, bot, 2, skull, "thread"),
    ]
    kept = removal_reactions(spark.createDataFrame(rows, REACTIONS), bot)
    assert sorted(row.event_id for row in kept.collect()) == [0, 5]


def test_commands_change_the_store(spark):
    users, messages = dialogue_store(spark, [(1, "system", "old"), (1, "user", "hi"), (2, "user", "hi")])
    texts = [
        "$llm-get-param",
        "$llm-set-param system-prompt Be kind",
        "$llm-get-param system-prompt",
        "$llm-set-param mood good",
        "$llm-set-param system-prompt",
        "$llm-reset-param system-prompt",
        "$llm-get-param mood",
    ]
    events = routed(spark, [(t, False, False) for t in texts])
    allowed = check_permissions(events, commands_table(spark), admins_table(spark))
    for max_group in (1, 1000):
        applied = apply_commands(users, messages, allowed, "default", max_group)
        assert prompts_of(applied.users) == {1: "default", 2: ""}
        assert history(applied.messages, 1) == [(0, "default"), (1, "hi")]
        assert [r.reply for r in applied.replies.orderBy("event_id").collect()] == [
            "* **System prompt**: ``",
            "Updated system prompt!\nOld: ```\n\n```\nNew: ```\nBe kind```",
            "Your system prompt is `Be kind`",
            "Unknown parameter: mood",
            "Missing value of the parameter!",
            "Updated system prompt!\nOld: ```\nBe kind\n```\nNew: ```\ndefault```",
            "Unknown parameter: mood",
        ]


@pytest.mark.parametrize("most", [256, 0])
def test_a_shared_word_and_a_repeated_admin_give_one_row(spark, monkeypatch, most):
    small = routing_module.broadcast_if_small
    monkeypatch.setattr(routing_module, "broadcast_if_small", lambda df: small(df, most))
    events = spark.createDataFrame([(1, NOW, 7, False, False, "$go now")], CHAT_EVENTS)
    commands = spark.createDataFrame([("refresh", "go", True), ("help", "go", False), ("stats", "go", False)], COMMANDS)
    routed = route_commands(events, commands)
    assert [row.command_key for row in routed.collect()] == ["help"]
    admins = spark.createDataFrame([(7,), (7,)], ADMINS)
    assert check_permissions(routed, commands, admins).count() == 1
