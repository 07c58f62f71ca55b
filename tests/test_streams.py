from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.functions.text import segments
from parley.operators.responses import display_actions, throttle_updates
from parley.schemas import CHAT_EVENTS, CHUNKS
from parley.session import new_folder
from parley.sources.events import stream_events
from parley.sources.log import ADDED, new_log
from parley.sources.settings import admins_table, commands_table
from parley.sources.tables import empty_messages, empty_users
from parley.streaming.conversations import answer_updates, stream_answers, stream_commands, stream_turns, user_states
from parley.streaming.segments import EarlyChunks, segment_stream
from parley.streaming.sinks import foreach_batch_sink, to_batch_folders
from parley.streaming.throttle import throttle_stream
from tests.support import dialogue_store, history, prompts_of
from tests.test_responses import START, UPDATES, expected_actions


def files(spark, batches, schema):
    """One file per batch, read one per micro-batch."""
    path = new_folder(spark, "input")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stream_events(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def run(spark, stream):
    path = new_folder(spark, "output")
    sink = to_batch_folders(path)
    foreach_batch_sink(stream, sink, new_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


def chunk_rows(response, text):
    words = [word + " " for word in text.split(" ")]
    words[-1] = words[-1][:-1]
    return [(response, n, START, w, n == len(words) - 1) for n, w in enumerate(words)]


def test_segments_of_shuffled_chunks(spark):
    """Chunks come late, early and in several batches; an unfinished response stays open."""
    plain = "one two three four. five six " * 6
    fenced = "look ```py\nprint(1) " + "and so on " * 8 + "``` done. " + "x" * 90
    rows = chunk_rows(1, plain) + chunk_rows(2, fenced)
    unfinished = [(3, n, START, "word ", False) for n in range(3)]
    batches = [rows[20::2] + unfinished, rows[:20:3], rows[1:20:3] + rows[21::2], rows[2:20:3]]
    found = run(spark, segment_stream(files(spark, batches, CHUNKS), 30)).cache()
    for response, text in ((1, plain), (2, fenced)):
        closing = found.filter(f"response_id = {response} AND (end_of_message OR end_of_response)")
        messages = [row.message for row in closing.orderBy("message_no").collect()]
        assert [m for m in messages if m] == [s for s in segments(text, 30) if s]
        chunks = found.filter(f"response_id = {response} AND chunk IS NOT NULL").orderBy("seq", "message_no")
        assert "".join(row.chunk for row in chunks.collect()) == text
    assert found.filter("response_id = 3 AND end_of_response").isEmpty()
    assert found.filter("response_id = 3").count() == 3


def expiring(spark):
    """Chunk 2 of response 1 is missing and none says stop; later chunks of others move the time."""
    first = [(1, n, START + timedelta(seconds=n), f"w{n} ", False) for n in (0, 1, 3, 4)]
    later = [[(9, n, START + timedelta(seconds=60 * (n + 1)), "x ", False)] for n in range(3)]
    return [first, *later]


def test_a_response_that_never_stops_is_put_out(spark):
    """Time is that of the chunks: what is held comes out flagged, the same in every run."""
    runs = []
    for batches in (expiring(spark), [*expiring(spark)[:1], expiring(spark)[1] + expiring(spark)[2], *expiring(spark)[3:]]):
        found = run(spark, segment_stream(files(spark, batches, CHUNKS), 30, ttl_ms=20_000)).filter("response_id = 1")
        runs.append(sorted((r.step, r.seq, r.chunk, r.message, r.length, r.incomplete, r.end_of_response) for r in found.collect()))
    assert runs[0] == runs[1]
    assert [(row[2], row[5]) for row in runs[0]] == [("w0 ", False), ("w1 ", False), ("w3 ", True), ("w4 ", True), ("", True)]
    assert runs[0][-1] == (4, 4, "", "w0 w1 w3 w4 ", 12, True, True)


def test_a_response_that_stops_does_not_expire(spark):
    rows = chunk_rows(1, "one two three four. five six " * 6)
    batches = [rows, *[[(9, n, START + timedelta(hours=n + 1), "x ", False)] for n in range(3)]]
    found = run(spark, segment_stream(files(spark, batches, CHUNKS), 30, ttl_ms=3_600_000)).filter("response_id = 1")
    assert found.filter("incomplete").isEmpty() and found.filter("end_of_response").count() == 1


def test_throttle_across_batches(spark):
    rows = [
        (1 + n % 2, START + timedelta(milliseconds=7 * n), n, "text" if n % 5 else " ", n % 11 == 3, n % 13 == 5, n == 59, START)
        for n in range(60)
    ]
    stream = files(spark, [rows[:20], rows[20:45], rows[45:]], UPDATES)
    shown = run(spark, throttle_stream(stream, 50)).collect()
    assert sorted((r.reply_id, r.seq, r.action) for r in shown) == expected_actions(rows, 50)
    batch = throttle_updates(spark.createDataFrame(rows, UPDATES), 50).collect()
    assert sorted(tuple(r) for r in batch) == sorted(tuple(r) for r in shown)


TURNS = ADDED["turns"]


def empty_log(spark):
    return new_log(empty_users(spark), empty_messages(spark), new_folder(spark, "log"))


def test_turns_reach_the_log(spark):
    log = empty_log(spark)
    batches = [[(1, 7, "hi", "hello", START), (2, 7, "why", None, START)], [(3, 7, "so", "yes", START), (4, 8, "a", "b", START)]]
    stream_turns(files(spark, batches, TURNS), log, new_folder(spark, "checkpoint")).awaitTermination()
    read = log.read("Be kind")
    assert prompts_of(read.users) == {7: "Be kind", 8: "Be kind"}
    expected = ["Be kind", "hi", "hello", "why", "so", "yes"]
    assert history(read.messages, 7) == list(enumerate(expected))
    assert history(read.messages, 8) == [(0, "Be kind"), (1, "a"), (2, "b")]


def answer_chunks():
    """Two responses whose chunks come 100 ms apart, in three files out of order."""
    words = [chunk_rows(1, "one two three four. five six " * 6), chunk_rows(2, "look ```py\nprint(1) " + "and so on " * 8 + "``` done.")]
    rows = [(i, n, START + timedelta(milliseconds=100 * n), text, stop) for some in words for i, n, _, text, stop in some]
    return rows, [rows[1::3], rows[2::3], rows[::3]]


def test_chunks_become_replies_and_a_stored_answer(spark):
    log = empty_log(spark)
    rows, batches = answer_chunks()
    asked = [[(1, 7, "hi", None, START), (2, 7, "code", None, START), (3, 7, "no answer", None, START)]]
    stream_turns(files(spark, asked, TURNS), log, new_folder(spark, "checkpoint")).awaitTermination()
    stream_answers(files(spark, batches, CHUNKS), log, new_folder(spark, "checkpoint"), 30, 750).awaitTermination()
    texts = {i: "".join(row[3] for row in rows if row[0] == i) for i in (1, 2)}
    expected = ["Be kind", "hi", texts[1], "code", texts[2], "no answer"]
    assert history(log.read("Be kind").messages, 7) == list(enumerate(expected))
    # What is shown is what throttling the segments of all chunks in order gives.
    segments_in_order = run(spark, segment_stream(files(spark, [rows], CHUNKS), 30))
    updates = segments_in_order.withColumn("seq", F.col("step")).withColumnRenamed("response_id", "reply_id")
    wanted = sorted(tuple(r) for r in throttle_updates(updates.select(*UPDATE_COLUMNS), 750).collect())
    assert sorted(tuple(r) for r in log.actions().collect()) == wanted
    replies = [r.message for r in log.actions().filter("response_id = 1 AND action = 'reply'").collect()]
    assert replies and log.added("answers").filter("message IS NOT NULL AND size(actions) = 0").isEmpty()


UPDATE_COLUMNS = ["reply_id", "seq", "ts", "message", "new_message", "end_of_message", "end_of_response", "started_ts"]


def test_an_answer_that_breaks_off_is_stored_as_far_as_it_came(spark):
    log = empty_log(spark)
    stream_turns(files(spark, [[(1, 7, "hi", None, START)]], TURNS), log, new_folder(spark, "checkpoint")).awaitTermination()
    stream_answers(files(spark, expiring(spark), CHUNKS), log, new_folder(spark, "checkpoint"), 30, 750, 20_000).awaitTermination()
    assert history(log.read("Be kind").messages, 7)[1:] == [(1, "hi"), (2, "w0 w1 w3 w4 ")]
    assert not log.added("answers").filter("response_id = 1 AND incomplete").isEmpty()


COMMAND_BATCHES = [
    [(1, START, 1, False, False, "$llm-set-param system-prompt Be new"), (2, START, 2, False, False, "$llm-reset")],
    [(3, START, 1, False, False, "$llm-get-param"), (4, START, 9, False, False, "$llm-get-param"), (5, START, 8, False, False, "hi")],
    [(6, START, 9, False, False, "$llm-reset-param system-prompt"), (7, START, 1, False, False, "$llm-set-param mood x")],
]


def test_commands_and_turns_share_a_log(spark):
    users, messages = dialogue_store(spark)
    log = new_log(users, messages, new_folder(spark, "log"))
    checkpoint = new_folder(spark, "checkpoint")
    events = files(spark, COMMAND_BATCHES, CHAT_EVENTS)
    turns = files(spark, [[(1, 1, "a", "b", START)], [(99, 2, "c", "d", START)]], TURNS)
    running = [
        stream_commands(events, commands_table(spark), admins_table(spark), log, checkpoint, default_prompt="default"),
        stream_turns(turns, log, new_folder(spark, "checkpoint")),
    ]
    for one in running:
        one.awaitTermination()
    read = log.read("default")
    assert prompts_of(read.users) == {1: "Be new", 2: "", 9: "default"}
    assert [text for _, text in history(read.messages, 1)] == ["question one", "answer one", "question two", "answer two", "a", "b"]
    assert history(read.messages, 2) == [(0, ""), (1, "c"), (2, "d")]
    told = {row.event_id: row.reply for row in log.added("commands").collect()}
    assert told[2] == "Message history cleared!" and told[7] == "Unknown parameter: mood"
    assert told[3] == "* **System prompt**: `Be new`"
    assert told[4] == "* **System prompt**: `default`" and "default" in told[6]
    assert len(told) == 6  # a row per command, none rewritten
    states = {row.user_id: (row.system_prompt, row.cleared) for row in user_states(spark, checkpoint).collect()}
    assert states == {1: ("Be new", -1), 2: ("", 2), 9: ("default", -1)}


class CountedMap(dict):
    """A map state that counts how often it is asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return (self[key],) if key in self else None

    def updateValue(self, key, value):
        self.asked += 1
        (self[key],) = value

    def removeKey(self, key):
        self.asked += 1
        self.pop(key, None)


def test_early_chunks_cost_a_look_at_the_state_per_block():
    state = CountedMap()
    early = EarlyChunks(state, 0)
    for seq in range(1, 600):
        early.hold(seq, None, f"w{seq}", False)
    early.hold(7, None, "again", False)
    early.store()
    assert early.held == 599 and sorted(state) == [(0,), (1,), (2,)] and state.asked == 3
    later = EarlyChunks(state, 599)
    taken = [later.take(seq) for seq in range(1, 601)]
    later.store()
    assert taken[6] == (7, None, "again", False) and taken[599] is None
    assert [one[0] for one in taken[:599]] == list(range(1, 600))
    assert later.held == 0 and not state and state.asked <= 9
