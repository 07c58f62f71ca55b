import pytest
from pyspark.sql import functions as F

from parley.functions.parsing import parse_bool, parse_double, parse_integer
from parley.operators.params import apply_param_changes, get_params
from parley.schemas import PARAMETERS
from tests.support import DEFAULT, users_of

CHANGES = "user_id bigint, parameter string, raw_value string, ts timestamp_ntz, seq bigint"


def changes(spark, *writes):
    rows = [(user, name, raw, None, n) for n, (user, name, raw) in enumerate(writes)]
    return spark.createDataFrame(rows, CHANGES)


def test_valid_values(spark):
    given = {"double": ("0.5678", 0.5678), "bigint": ("123456789", 123456789), "boolean": ("True", True)}
    writes = [(1, name, given[kind][0]) for name, kind in PARAMETERS.items()]
    result = apply_param_changes(users_of(spark, [(1, None)]), changes(spark, *writes))
    row = result.users.first()
    assert {name: row[name] for name in PARAMETERS} == {n: given[k][1] for n, k in PARAMETERS.items()}
    assert {r.status for r in result.audit.collect()} == {"ok"}


def test_invalid_values_change_nothing(spark):
    writes = [(1, name, "invalid") for name in PARAMETERS]
    result = apply_param_changes(users_of(spark, [(1, None)]), changes(spark, *writes))
    row = result.users.first()
    assert all(row[name] is None for name in PARAMETERS)
    assert {r.status for r in result.audit.collect()} == {f"Invalid {n}: invalid" for n in PARAMETERS}


@pytest.mark.parametrize("max_group", [1, 1000])
def test_audit_names_old_and_new(spark, max_group):
    writes = [(1, "top_k", raw) for raw in ["5", "x", "7", "8.5", "9"]]
    result = apply_param_changes(users_of(spark, [(1, None)]), changes(spark, *writes), max_group=max_group)
    audit = result.audit.orderBy("seq").collect()
    assert [(r.old_value, r.new_value) for r in audit] == [
        (None, "5"), ("5", "5"), ("5", "7"), ("7", "7"), ("7", "9")
    ]
    later = apply_param_changes(result.users, changes(spark, (1, "top_k", "10")), max_group=max_group)
    assert [(r.old_value, r.new_value) for r in later.audit.collect()] == [("9", "10")]


def test_unknown_names_still_create_the_user(spark):
    writes = changes(spark, (5, "volume", "1"), (6, "samplers", "x"))
    result = apply_param_changes(users_of(spark, [(1, None)]), writes, True, DEFAULT)
    assert {r.id for r in result.users.collect()} == {1, 5, 6}
    assert {r.status for r in result.audit.collect()} == {
        "Unknown parameter: volume", "Samplers order configuration is currently WIP"
    }
    refused = apply_param_changes(users_of(spark, [(1, None)]), writes, create_users=False)
    assert refused.rejected.count() == 2 and refused.audit.isEmpty()


def test_a_stored_value_becomes_null_only_by_nan(spark):
    users = apply_param_changes(users_of(spark, [(1, None)]), changes(spark, (1, "top_p", "0.5"))).users
    result = apply_param_changes(users, changes(spark, (1, "top_p", "nan"), (1, "top_p", "oops")))
    assert result.users.first().top_p is None


def test_number_spellings(spark):
    integers = {" 5 ": 5, "5.0": None, "1_000": 1000, "1__0": None, "_1": None, "+7": 7, "-0": 0,
                "12345678901234567890": None, "": None, "1d": None, "\t9\n": 9}
    doubles = {" 5 ": 5.0, "1_0.5": 10.5, "1d": None, ".5": 0.5, "5.": 5.0, ".": None, "1e3": 1000.0,
               "inf": float("inf"), "-Infinity": float("-inf"), "1e": None, "1.5f": None}
    rows = spark.createDataFrame([(text,) for text in [*integers, *doubles]], "raw string")
    found = rows.select("raw", parse_integer(F.col("raw")).alias("i"), parse_double(F.col("raw")).alias("d"))
    found = {row.raw: row for row in found.collect()}
    assert {text: found[text].i for text in integers} == integers
    assert {text: found[text].d for text in doubles} == doubles


def test_boolean_words(spark):
    words = {"1": True, "TRUE": True, "t": True, "Yes": True, "y": True, "0": False, "false": False,
             "F": False, "no": False, "N": False, " true ": None, "2": None, "": None}
    rows = spark.createDataFrame([(word,) for word in words], "raw string")
    assert {r.raw: r.b for r in rows.select("raw", parse_bool(F.col("raw")).alias("b")).collect()} == words


def test_get_params(spark):
    users = users_of(spark, [(1, "p")])
    asked = spark.createDataFrame([(1, None), (1, "system-prompt"), (1, "mood")], "user_id bigint, parameter string")
    assert {r.parameter: r.reply for r in get_params(users, asked).collect()} == {
        None: "* **System prompt**: `p`",
        "system-prompt": "Your system prompt is `p`",
        "mood": "Unknown parameter: mood",
    }
