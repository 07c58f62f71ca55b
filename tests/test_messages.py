from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parley.operators.lookups import (
    last_messages,
    lookup_messages,
    messages_after,
    next_positions,
    nth_messages,
    user_histories,
)
from parley.operators.messages import (
    Removals,
    append_messages,
    clear_messages,
    delete_by_position,
    delete_messages,
)
from parley.sources.tables import empty_messages, empty_users
from tests.support import DEFAULT, dialogue_store, flags, history, new_messages, prompts_of, users_of


def test_append_creates_users_and_positions(spark):
    users, messages = dialogue_store(spark)
    assert prompts_of(users) == {1: "", 2: ""}
    expected = ["question one", "answer one", "question two", "answer two"]
    assert history(messages, 2) == list(enumerate(expected))
    assert messages.select("id").distinct().count() == 8


@pytest.mark.parametrize("max_group", [1, 1_000_000])
def test_append_continues(spark, max_group):
    users, messages = dialogue_store(spark)
    lines = [(1, "user", f"more {n}") for n in range(40)] + [(3, "user", "hello")]
    added = append_messages(users, messages, new_messages(spark, lines), True, DEFAULT, max_group)
    assert history(added.messages, 1)[4:] == [(n + 4, f"more {n}") for n in range(40)]
    assert history(added.messages, 3) == [(0, "hello")]
    assert prompts_of(added.users)[3] == DEFAULT
    assert added.messages.select("id").distinct().count() == 49


def test_append_keeps_given_times_and_fills_missing_ones(spark):
    rows = [(123, "user", "a", datetime(2222, 11, 22), 0), (123, "user", "b", None, 1)]
    schema = "user_id bigint, role string, message string, timestamp timestamp_ntz, arrival bigint"
    before = datetime.now()
    new = spark.createDataFrame(rows, schema)
    added = append_messages(empty_users(spark), empty_messages(spark), new).added
    given_time, filled = [row.timestamp for row in added.orderBy("position").collect()]
    assert given_time == datetime(2222, 11, 22)
    assert abs(filled - before) < timedelta(days=1)


def test_append_rejects(spark):
    users = users_of(spark, [(1, None)])
    new = new_messages(spark, [(1, "user", "ok"), (2, "user", "no user"), (1, "robot", "no role")])
    added = append_messages(users, empty_messages(spark), new, create_users=False)
    assert history(added.messages, 1) == [(0, "ok")]
    assert {row.message for row in added.rejected.collect()} == {"no user", "no role"}
    assert prompts_of(added.users) == {1: ""}


def test_delete_by_id(spark):
    _, messages = dialogue_store(spark)
    doomed = messages.filter("user_id = 1 AND position = 2").first().id
    requests = spark.createDataFrame([(doomed, 0), (0xDEADBEEF, 1), (doomed, 2)], "id bigint, arrival bigint")
    deleted = delete_messages(messages, requests)
    assert flags(deleted.status, "deleted") == [True, False, False]
    assert history(deleted.messages, 1) == [(0, "question one"), (1, "answer one"), (2, "answer two")]
    assert len(history(deleted.messages, 2)) == 4


POSITIONS = "user_id bigint, position bigint, arrival bigint"


@pytest.mark.parametrize(("per_round", "max_group"), [(1000, 1000), (1, 1000), (1, 1)])
def test_delete_by_position(spark, per_round, max_group):
    _, messages = dialogue_store(spark)
    rows = [(1, 1, 0), (1, 1, 1), (123, 2, 2), (2, 10, 3)]
    requests = spark.createDataFrame(rows, POSITIONS)
    deleted = delete_by_position(messages, requests, per_round, max_group)
    assert flags(deleted.status, "deleted") == [True, True, False, False]
    assert history(deleted.messages, 1) == [(0, "question one"), (1, "answer two")]
    assert len(history(deleted.messages, 2)) == 4


def test_clear(spark):
    _, messages = dialogue_store(spark)
    cleared = clear_messages(messages, spark.createDataFrame([(1,), (123,)], "user_id bigint"))
    assert history(cleared, 1) == [] and len(history(cleared, 2)) == 4


def test_lookups(spark):
    _, messages = dialogue_store(spark)
    wanted = spark.createDataFrame([(1, 2), (2, 1), (2, 9)], "user_id bigint, position bigint")
    found = nth_messages(messages, wanted).orderBy("user_id").collect()
    assert [row.message for row in found] == ["question two", "answer one"]
    ids = messages.filter("user_id = 2").select("id")
    assert lookup_messages(messages, ids).count() == 4
    cutoffs = spark.createDataFrame([(1, 1)], "user_id bigint, from_position bigint")
    assert sorted(r.position for r in messages_after(messages, cutoffs).collect()) == [2, 3]
    keys = spark.createDataFrame([(2,), (555,)], "user_id bigint")
    assert [r.position for r in user_histories(messages, keys).collect()] == [0, 1, 2, 3]
    assert {r.user_id: r.next_position for r in next_positions(messages, keys).collect()} == {2: 4, 555: 0}
    assert {r.message for r in last_messages(messages).collect()} == {"answer two"}


STEPS = st.lists(
    st.one_of(
        st.tuples(st.just("append"), st.integers(1, 4)),
        st.tuples(st.just("position"), st.lists(st.integers(0, 6), min_size=1, max_size=4)),
        st.tuples(st.just("ids"), st.sets(st.integers(0, 6), min_size=1)),
        st.tuples(st.just("clear"), st.none()),
    ),
    min_size=1,
    max_size=3,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(steps=STEPS)
def test_any_mix_keeps_positions_dense(spark, steps):
    """The same steps on plain lists tell what must be left."""
    users, messages = dialogue_store(spark)
    model = {u: [text for _, text in history(messages, u)] for u in (1, 2)}
    for number, (step, value) in enumerate(steps):
        if step == "append":
            lines = [(1, "user", f"{number}-{n}") for n in range(value)]
            messages = append_messages(users, messages, new_messages(spark, lines)).messages
            model[1] += [text for _, _, text in lines]
        elif step == "position":
            rows = [(1, position, n) for n, position in enumerate(value)]
            messages = delete_by_position(messages, spark.createDataFrame(rows, POSITIONS)).messages
            for position in value:
                del model[1][position : position + 1]
        elif step == "ids":
            stored = {r.position: r.id for r in messages.filter("user_id = 1").collect()}
            rows = [(stored.get(position, -1), n) for n, position in enumerate(value)]
            messages = delete_messages(messages, spark.createDataFrame(rows, "id bigint, arrival bigint")).messages
            model[1] = [text for n, text in enumerate(model[1]) if n not in value]
        else:
            messages = clear_messages(messages, spark.createDataFrame([(1,)], "user_id bigint"))
            model[1] = []
        messages = messages.checkpoint()
    assert history(messages, 1) == list(enumerate(model[1]))
    assert history(messages, 2) == list(enumerate(model[2]))


@settings(max_examples=200, deadline=None)
@given(length=st.integers(0, 60), positions=st.lists(st.integers(-1, 70), max_size=120), recent=st.integers(1, 9))
def test_removals_follow_a_plain_list(length, positions, recent):
    items, expected = list(range(length)), []
    for position in positions:
        expected.append(items.pop(position) if 0 <= position < len(items) else None)
    removals = Removals(length)
    removals.RECENT = recent
    half = len(positions) // 2
    assert removals.resolve(positions[:half]) + removals.resolve(positions[half:]) == expected
