from parley.operators.lookups import lookup_users, users_exist, users_have_messages
from parley.operators.users import (
    add_users,
    change_default_prompt,
    change_user_prompts,
    delete_users,
    get_or_create_users,
    reset_params,
)
from parley.sources.tables import empty_messages
from tests.support import (
    DEFAULT,
    PROMPT_A,
    PROMPT_B,
    dialogue_store,
    flags,
    history,
    prompts_of,
    users_of,
)

REQUESTS = "id bigint, system_prompt string, arrival bigint"


def test_add_users_without_default(spark):
    users = users_of(spark, [(1, None), (2, ""), (123, PROMPT_A), (456, PROMPT_B)])
    assert prompts_of(users) == {1: "", 2: "", 123: PROMPT_A, 456: PROMPT_B}
    again = add_users(users, spark.createDataFrame([(1, None, 0), (1, "other", 1)], REQUESTS))
    assert flags(again.status, "created") == [False, False]
    assert prompts_of(again.users) == prompts_of(users)


def test_add_users_with_default(spark):
    users = users_of(spark, [(1, None), (2, ""), (123, PROMPT_A), (456, None)], DEFAULT)
    assert prompts_of(users) == {1: DEFAULT, 2: "", 123: PROMPT_A, 456: DEFAULT}


def test_first_arrival_wins(spark):
    new = spark.createDataFrame([(7, "late", 5), (7, None, 2), (7, "later", 9)], REQUESTS)
    added = add_users(users_of(spark, [(1, None)]), new, DEFAULT)
    assert prompts_of(added.users)[7] == DEFAULT
    assert flags(added.status, "created") == [True, False, False]


def test_get_or_create(spark):
    users = users_of(spark, [(1, "one"), (2, "two")], DEFAULT)
    keys = spark.createDataFrame([(1, None, 0), (2, "no", 1), (3, None, 2), (4, "four", 3)], REQUESTS)
    found = get_or_create_users(users, keys, DEFAULT)
    assert prompts_of(found) == {1: "one", 2: "two", 3: DEFAULT, 4: "four"}


def test_change_default_prompt(spark):
    users = users_of(spark, [(1, None), (2, ""), (123, None), (456, PROMPT_B)], DEFAULT)
    changed = change_default_prompt(users, DEFAULT, PROMPT_A)
    assert prompts_of(changed.users) == {1: PROMPT_A, 2: "", 123: PROMPT_A, 456: PROMPT_B}
    assert changed.status.first().rows_changed == 2


CHANGES = "user_id bigint, system_prompt string, ts timestamp_ntz, seq bigint"


def test_change_user_prompts(spark):
    users = users_of(spark, [(1, None), (2, "")], DEFAULT)
    changes = spark.createDataFrame([(1, "x", None, 0), (1, PROMPT_A, None, 1), (666, PROMPT_A, None, 2)], CHANGES)
    created = change_user_prompts(users, empty_messages(spark), changes)
    assert prompts_of(created.users) == {1: PROMPT_A, 2: "", 666: PROMPT_A}
    assert created.status.isEmpty()
    refused = change_user_prompts(users, empty_messages(spark), changes, create_users=False)
    assert prompts_of(refused.users) == {1: PROMPT_A, 2: ""}
    assert [row.user_id for row in refused.status.collect()] == [666]


def test_prompt_change_rewrites_system_messages(spark):
    lines = [(1, "system", "old"), (1, "user", "old"), (2, "system", "old")]
    users, messages = dialogue_store(spark, lines)
    changes = spark.createDataFrame([(1, "new", None, 0)], CHANGES)
    changed = change_user_prompts(users, messages, changes)
    assert history(changed.messages, 1) == [(0, "new"), (1, "old")]
    assert history(changed.messages, 2) == [(0, "old")]


def test_reset_params(spark):
    users, messages = dialogue_store(spark)
    requests = spark.createDataFrame(
        [(1, "system-prompt", None, 0), (2, "mood", None, 1), (2, None, None, 2)],
        "user_id bigint, parameter string, ts timestamp_ntz, seq bigint",
    )
    reset = reset_params(users, messages, requests, DEFAULT)
    assert prompts_of(reset.users) == {1: DEFAULT, 2: ""}
    assert flags(reset.status, "status", "seq") == ["ok", "Unknown parameter: mood", "Missing parameter name!"]


def test_delete_users(spark):
    users, messages = dialogue_store(spark)
    requests = spark.createDataFrame([(1, 0), (123, 1), (9999, 2), (1, 3)], "id bigint, arrival bigint")
    deleted = delete_users(users, messages, requests)
    assert flags(deleted.status, "deleted") == [True, False, False, False]
    assert prompts_of(deleted.users) == {2: ""}
    assert history(deleted.messages, 1) == [] and len(history(deleted.messages, 2)) == 4


def test_existence(spark):
    users, messages = dialogue_store(spark)
    keys = spark.createDataFrame([(1,), (5,)], "id bigint")
    assert {r.id: r.user_exists for r in users_exist(users, keys).collect()} == {1: True, 5: False}
    asked = keys.selectExpr("id AS user_id")
    found = {r.user_id: r.has_messages for r in users_have_messages(messages, asked).collect()}
    assert found == {1: True, 5: False}
    assert [r.penalize_nl for r in lookup_users(users, keys).collect()] == [False]
