from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parley.operators.responses import assemble_responses, running_responses, text_ends, throttle_updates
from parley.schemas import CHUNKS

START = datetime(2024, 1, 1)
UPDATES = (
    "reply_id bigint, ts timestamp_ntz, seq bigint, message string, new_message boolean, "
    "end_of_message boolean, end_of_response boolean, started_ts timestamp_ntz"
)


@pytest.mark.parametrize("per_part", [2, 100])
def test_assembled_and_running_text(spark, per_part):
    words = ["One ", "answer ", "in ", "five ", "chunks"]
    rows = [(1, n, START, word, n == 4) for n, word in enumerate(words)] + [(2, 0, START, "open", False)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    whole = assemble_responses(chunks, per_part).orderBy("response_id").collect()
    assert [(r.response, r.chunks, r.complete) for r in whole] == [("".join(words), 5, True), ("open", 1, False)]
    running = running_responses(chunks, per_part).filter("response_id = 1").orderBy("seq").collect()
    assert [r.response for r in running] == ["".join(words[: n + 1]) for n in range(5)]


def test_very_many_chunks_keep_their_beginning(spark):
    count = 70_000
    rows = spark.range(count).selectExpr(
        "1L AS response_id", "id AS seq", "timestamp_ntz '2024-01-01' AS ts", "'w ' AS content", f"id = {count - 1} AS stop"
    )
    assert [len(r.response) for r in assemble_responses(rows).collect()] == [2 * count]
    last = text_ends(rows).orderBy("seq", ascending=False).first()
    assert (last.seq, last.end) == (count - 1, 2 * count)


def expected_actions(rows, cooldown):
    """The rules one row at a time."""
    last, found = {}, []
    for reply, ts, seq, message, new, end, final, started in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last.setdefault(reply, started)
        if new:
            found.append((reply, seq, "reply"))
        elif message.strip():
            due = last[reply] is None or ts - last[reply] >= timedelta(milliseconds=cooldown)
            if end or due:
                found.append((reply, seq, "edit"))
                last[reply] = ts
        if final:
            found.append((reply, seq, "final"))
    return sorted(found)


ROWS = st.lists(
    st.tuples(
        st.integers(1, 2), st.integers(0, 60), st.sampled_from(["a", "a", "a", " "]), *[st.integers(0, 9)] * 3
    ),
    min_size=1,
    max_size=120,
)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(drawn=ROWS, cooldown=st.integers(0, 20), started=st.booleans())
def test_throttle_is_the_same_in_blocks(spark, drawn, cooldown, started):
    rows = [
        (reply, START + timedelta(milliseconds=at), n, text, new == 0, end == 0, final == 0, START if started else None)
        for n, (reply, at, text, new, end, final) in enumerate(drawn)
    ]
    updates = spark.createDataFrame(rows, UPDATES)
    for max_group in (1, 1_000_000):
        shown = throttle_updates(updates, cooldown, max_group).collect()
        assert sorted((r.reply_id, r.seq, r.action) for r in shown) == expected_actions(rows, cooldown)
