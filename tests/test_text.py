import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions.text import cut, fence_open, last_separator, segments
from parley.operators.texts import split_once, split_texts

# Fixed value: a text with known cuts at limits 100, 30 and 15.
LONG = "This is a dummy, but also pretty long response"
LINES = [
    "The first line is here, somewhat long already.",
    "The second line also ends in a full stop.",
    "A short one!",
    "And the fourth line closes the whole example.",
]
CODE = """Some words that come before the code block starts:

```py
def greet():
    print("Good morning, everyone!")

if __name__ == "__main__":
    greet()
```

Done!"""


def spark_segments(spark, text, limit):
    rows = split_texts(spark.createDataFrame([(1, text)], "id int, text string"), "text", limit)
    return [row.segment for row in rows.orderBy("segment_no").collect()]


CASES = [
    (LONG, 100, [LONG]),
    (LONG, 30, ["This is a dummy, but also", "pretty long response"]),
    (LONG, 15, ["This is a", "dummy, but", "also pretty", "long response"]),
    ("\n".join(LINES), 100, ["\n".join(LINES[:2]), "\n".join(LINES[2:])]),
    (
        CODE,
        100,
        [
            'Some words that come before the code block starts:\n\n```py\ndef greet():\n```',
            '```py\n    print("Good morning, everyone!")\n\nif __name__ == "__main__":\n    greet()\n```\n\nDone!',
        ],
    ),
    ("", 20, [""]),
    ("x" * 20, 20, ["x" * 20]),
    ("x" * 19, 20, ["x" * 19]),
    ("x" * 45, 20, ["x" * 20, "x" * 20, "x" * 5]),
    (" " + "x" * 30, 20, [" " + "x" * 19, "x" * 11]),
    ("y" * 12 + ". " + "z" * 12, 20, ["y" * 12 + ".", "z" * 12]),
    ("a b\n" + "c" * 10 + ". d" + "e" * 10, 20, ["a b", "c" * 10 + ".", "d" + "e" * 10]),
    ("```" + "x" * 30, 20, ["```" + "x" * 17 + "\n```", "```\n" + "x" * 13]),
]


def test_a_long_tag_is_carried_whole(spark):
    tag = "t" * 32
    found = spark_segments(spark, f"```{tag}\n" + "some words\n" * 30 + "```", 100)
    assert len(found) > 2 and all(segment.startswith(f"```{tag}\n") for segment in found)
    assert segments(f"```{tag}\n" + "some words\n" * 30 + "```", 100) == found


def test_words_of_a_long_line_in_a_fence_stay_whole(spark):
    text = "```py\n" + "word " * 60 + "```"
    found = spark_segments(spark, text, 50)
    assert found == segments(text, 50) and len(found) > 5
    assert all(segment.startswith("```py\n") for segment in found)
    assert set(" ".join(found).replace("```py", " ").replace("```", " ").split()) == {"word"}


@pytest.mark.parametrize(("text", "limit", "expected"), CASES)
def test_known_cuts(spark, text, limit, expected):
    assert segments(text, limit) == expected
    assert spark_segments(spark, text, limit) == expected


def test_a_fence_without_separators_still_ends(spark):
    text = "```\n" + "x" * 100
    found = spark_segments(spark, text, 20)
    assert "".join(found).count("x") == 100
    assert all(len(segment) <= 24 for segment in found)


PIECES = st.sampled_from(["a", "word", " ", ". ", ".", "\n", "```", "```py\n", "é", "💀", "long" * 6])
TEXTS = st.lists(st.lists(PIECES, max_size=60).map("".join), min_size=1, max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS, limit=st.integers(16, 60))
def test_split_agrees_with_single_cuts(spark, texts, limit):
    """The regular expression, the scan and repeated native cuts give the same segments."""
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {n: [] for n in range(len(texts))}
    for row in split_texts(rows, "text", limit).orderBy("id", "segment_no").collect():
        found[row.id].append(row.segment)
    once = {row.id: (row.first, row.rest) for row in split_once(rows, "text", limit).collect()}
    for number, text in enumerate(texts):
        assert found[number] == segments(text, limit)
        assert all(len(segment) <= limit + 4 for segment in found[number])
        step = cut(text, limit)
        expected = (text, None) if step is None else (step[0], step[2] + text[step[1] :])
        assert once[number] == expected


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(["ab", " ", ". ", "\n", "é"]), max_size=200).map("".join), limit=st.integers(8, 50))
def test_plain_segments_lose_only_separators(text, limit):
    kept = "".join("".join(segments(text, limit)).split())
    assert kept == "".join(text.split())


def test_last_separator(spark):
    rows = spark.createDataFrame([("a. b c",), ("\nabc",), ("a\nb. c",), ("abc",), ("x. ",)], "t string")
    found = [r.s and (r.s.position, r.s.separator) for r in rows.select(last_separator(F.col("t")).alias("s")).collect()]
    assert found == [(1, ". "), None, (1, "\n"), None, (1, ". ")]


def test_fence_open(spark):
    rows = spark.createDataFrame([("```",), ("``` ```",), ("",), ("a```b```c```",)], "t string")
    assert [r.o for r in rows.select(fence_open(F.col("t")).alias("o")).collect()] == [True, False, False, True]


def test_small_limits_are_refused(spark):
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([("a",)], "t string"), "t", 5)
