from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.functions.times import from_iso, to_iso
from parley.session import new_folder
from parley.sources.log import ADDED, new_log
from parley.sources.tables import empty_messages, empty_users, read_messages, read_users
from tests.support import dialogue_store, history, prompts_of

NOW = datetime(2024, 1, 1)
TURNS = ADDED["turns"]


def test_a_snapshot_is_read_back(spark):
    users, messages = dialogue_store(spark)
    log = new_log(users, messages, new_folder(spark, "log"))
    read = log.read()
    assert prompts_of(read.users) == {1: "", 2: ""}
    assert history(read.messages, 2) == history(messages, 2)
    assert read.messages.schema.names == messages.schema.names


def turn_rows(spark, *rows):
    return spark.createDataFrame([(*row, NOW) for row in rows], TURNS)


def test_batches_count_once_and_streams_never_meet(spark):
    log = new_log(empty_users(spark), empty_messages(spark), new_folder(spark, "log"))
    log.append("turns", turn_rows(spark, (1, 7, "hi", "first try")), "/checkpoints/a", 0)
    log.append("turns", turn_rows(spark, (1, 7, "hi", "hello")), "/checkpoints/a/", 0)  # the same batch again
    log.append("turns", turn_rows(spark, (2, 7, "why", None)), "/checkpoints/b", 0)
    log.append("turns", turn_rows(spark, (3, 7, "so", "yes")), "/checkpoints/a", 1)
    assert history(log.read("Be kind").messages, 7) == list(enumerate(["Be kind", "hi", "hello", "why", "so", "yes"]))


def test_a_new_version_holds_what_the_last_one_said(spark):
    users, messages = dialogue_store(spark)
    log = new_log(users, messages, new_folder(spark, "log"))
    log.append("turns", turn_rows(spark, (1, 2, "more", "words"), (2, 9, "a", "b")), "/checkpoints/a", 0)
    commands = [(5, 1, NOW, "reset-conversation", None, True, False, ""), (6, 9, NOW, "set-param", "Be odd", False, True, "")]
    log.append("commands", spark.createDataFrame(commands, ADDED["commands"]), "/checkpoints/b", 0)
    read = log.read("default")
    before = [sorted(map(tuple, table.collect()), key=repr) for table in read]
    assert history(read.messages, 1) == [] and history(read.messages, 9) == [(0, "Be odd"), (1, "a"), (2, "b")]
    assert log.compact("default") == 2 and log.added("turns").isEmpty()
    assert [sorted(map(tuple, table.collect()), key=repr) for table in log.read()] == before
    # A version without all of its snapshot is none.
    users.write.parquet(f"{log.path}/version=3/users")
    assert log.versions() == [1, 2] and log.read().messages.count() == read.messages.count()


def test_a_clearing_ends_what_was_told_before_it(spark):
    users, messages = dialogue_store(spark)
    log = new_log(users, messages, new_folder(spark, "log"))
    at = [NOW + timedelta(seconds=n) for n in range(3)]
    turns = [(1, 1, "before", "x", at[0]), (2, 1, "behind", "y", at[2])]
    log.append("turns", spark.createDataFrame(turns, TURNS), "/checkpoints/a", 0)
    clear = [(3, 1, at[1], "reset-conversation", None, True, False, "")]
    log.append("commands", spark.createDataFrame(clear, ADDED["commands"]), "/checkpoints/b", 0)
    assert history(log.read().messages, 1) == [(0, ""), (1, "behind"), (2, "y")]
    assert len(history(log.read().messages, 2)) == 4


def test_empty_tables(spark):
    log = new_log(empty_users(spark), empty_messages(spark), new_folder(spark, "log"))
    assert log.read().users.isEmpty() and log.read().messages.isEmpty() and log.actions().isEmpty()


def test_readers_check_roles_and_times(spark):
    rows = [
        (1, 1, "2024-01-01T10:00:00", 0, "user", "a"),
        (2, 1, "2024-01-01T10:00:00.123456", 1, "assistant", ""),
        (3, 1, "soon", 2, "user", "c"),
        (4, 1, "2024-01-01T10:00:00", 3, "robot", "d"),
        (5, 1, None, 4, "user", "e"),
    ]
    schema = "id bigint, user_id bigint, timestamp string, position bigint, role string, message string"
    for kind in ("json", "parquet", "csv"):
        path = new_folder(spark, kind)
        writer = spark.createDataFrame(rows, schema).write.option("header", "true")
        writer.option("emptyValue", '""').format(kind).save(path)
        read = read_messages(spark, path, kind)
        valid = read.valid.orderBy("id").collect()
        assert [r.timestamp for r in valid] == [
            datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10, 0, 0, 123456)
        ]
        assert valid[1].message == ""
        assert sorted(r.id for r in read.rejected.collect()) == [3, 4, 5]


def test_rows_without_a_value_are_rejected(spark):
    whole = (1, 1, "2024-01-01T10:00:00", 0, "user", "a")
    rows = [whole] + [tuple(None if at == n else value for n, value in enumerate(whole)) for at in range(6)]
    schema = "id bigint, user_id bigint, timestamp string, position bigint, role string, message string"
    for kind in ("json", "parquet"):
        path = new_folder(spark, kind)
        spark.createDataFrame(rows, schema).write.format(kind).save(path)
        read = read_messages(spark, path, kind)
        assert read.valid.count() == 1 and read.rejected.count() == 6
        assert read.rejected.filter("raw_line IS NOT NULL").isEmpty()


def test_records_that_cannot_be_read_are_rejected_with_their_text(spark):
    good = {
        "json": '{"id":1,"user_id":1,"timestamp":"2024-01-01T10:00:00","position":0,"role":"user","message":"a"}',
        "csv": "id,user_id,timestamp,position,role,message\n1,1,2024-01-01T10:00:00,0,user,a",
    }
    bad = {
        "json": ['{"id":2,"user_id', "no record", good["json"].replace('"id":1', '"id":"one"')],
        "csv": ["one,1,2024-01-01T10:00:00,0,user,b", "2,1,2024-01-01T10:00:00", "3,1,2024-01-01T10:00:00,0,user,c,more"],
    }
    for kind in ("json", "csv"):
        path = new_folder(spark, kind)
        spark.createDataFrame([("\n".join([good[kind], *bad[kind]]),)], "value string").coalesce(1).write.text(path)
        read = read_messages(spark, path, kind)
        assert [(r.id, r.message) for r in read.valid.collect()] == [(1, "a")]
        assert sorted(r.raw_line.strip() for r in read.rejected.collect()) == sorted(bad[kind])


def test_users_read_unset_penalty_as_false(spark):
    users, _ = dialogue_store(spark)
    for kind in ("json", "parquet", "csv"):
        path = new_folder(spark, kind)
        rows = users.drop("samplers") if kind == "csv" else users
        rows.write.option("header", "true").option("emptyValue", '""').format(kind).save(path)
        read = read_users(spark, path, kind)
        assert prompts_of(read) == {1: "", 2: ""}
        assert {r.penalize_nl for r in read.collect()} == {False}


def test_iso_times(spark):
    texts = ["2024-02-29T23:59:59", "2024-02-29T23:59:59.000001"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in rows.select(to_iso(from_iso(F.col("t"))).alias("t")).collect()] == texts


def test_only_naive_iso_times_are_read(spark):
    good = ["2024-02-29", "20240229", "2024-02-29T10", "2024-02-29 10:20", "20240229T102030", "2024-02-29T10:20:30.5"]
    bad = ["2024", "2024-01", "2024-1-1", " 2024-01-01", "2024-01-01 ", "2024-01-01T10:00:00+02:00", "2024-02-30", "2024-01-01T10:", "x", ""]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", from_iso(F.col("t")).alias("ts"))
    read = {row.t: row.ts is not None for row in rows.collect()}
    assert read == {t: t in good for t in good + bad}
