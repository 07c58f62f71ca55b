"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a column that is true where a text fails. On a bounded sample every rule is
timed and its share of failing texts counted; rules are then tried in the order of rejections
per second, and a text that one rule rejects is not shown to the later ones. The order
decides only how much work is done: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that the rules are timed on, about.
SAMPLE_ROWS = 2000
SEED = 9
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    name: str
    fails: Column


def kept_by(made: Column, use) -> Column:
    """``use`` of a column that is computed once, however often ``use`` names it."""
    return F.transform(F.array(made), use)[0]


def characters_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more, the first included.

    Windows are sorted by hash and start; the starts of equal ones are sorted again, and each
    covers three words less what the next one covers too. Linear in the words but for the sorts.
    """

    def covered(starts: Column) -> Column:
        # Three words each, but for the overlap with the window before.
        step = F.transform(starts, lambda start, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), start - F.get(starts, i - 1))))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda total, n: total + n)

    def again(sorted_: Column) -> Column:
        same = lambda one, other: F.coalesce(one["gram"] == other["gram"], F.lit(False))
        twice = F.filter(
            sorted_, lambda w, i: same(w, F.get(sorted_, i + 1)) | same(w, F.get(sorted_, i - 1))
        )
        return kept_by(F.array_sort(F.transform(twice, lambda w: w["start"])), covered)

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 3)
        gram = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.transform(starts, lambda i: F.struct(gram(i).alias("gram"), i.alias("start")))

    def counted(words: Column) -> Column:
        found = kept_by(F.sort_array(windows(words)), again)
        return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(found)

    return kept_by(words, counted)


def repeated_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    with_word = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    return kept_by(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` (doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text counts as empty: all five are 0.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = words_of(whole)
    # One array of words serves both counts.
    both = kept_by(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("again")))
    return (
        documents.withColumn("words", both)
        .withColumn("n_words", F.col("words.n"))
        .withColumn("word_chars", F.length(F.translate(whole, BLANKS, "")).cast("bigint"))
        .withColumn("n_symbols", characters_of(whole, SYMBOLS))
        .withColumn("n_dup_lines", repeated_lines(whole))
        .withColumn("n_repeat_words", F.col("words.again"))
        .drop("words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[Rule]:
    """Rules over the measures and the text; loose, so that ordinary prose passes them all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("same_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("capitals", 10 * characters_of(text, CAPITALS) > 4 * F.col("word_chars")),
        Rule("exclamations", 10 * characters_of(text, "!?") > 3 * F.col("n_words")),
    ]


class Estimate(NamedTuple):
    rule: Rule
    seconds: float
    rejects: float


def estimates(documents: DataFrame, candidates: list[Rule], rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Time and share of rejected rows of each rule on a sample, best rejection per second first.

    About ``rows`` rows are drawn where they lie, in shares of their partitions, and only they
    are measured; each rule is timed on their measures.
    Rules that reject nothing there come last, cheapest first; ties keep the given order.
    """
    share = min(1.0, rows / max(documents.count(), 1))
    sample = measured(documents.sample(share, SEED)).persist()
    total = max(sample.count(), 1)
    found = []
    for rule in candidates:
        began = time.perf_counter()
        rejected = sample.agg(F.count(F.when(rule.fails, 1))).first()[0]
        found.append(Estimate(rule, time.perf_counter() - began, rejected / total))
    sample.unpersist()
    return sorted(found, key=lambda e: (-e.rejects / e.seconds, e.seconds))


def cascade(ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    chain = F.lit(None).cast("string")
    for rule in reversed(ordered):
        chain = F.when(F.coalesce(rule.fails, F.lit(False)), rule.name).otherwise(chain)
    return chain


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per row of ``documents`` (doc_id, text), also where rows repeat or have no doc_id.
    Empty and null texts fail the base.
    """
    measures = measured(documents)
    order = [e.rule for e in estimates(documents, [Rule("base", base_failed()), *rules()])]
    # The base verdict is a column of the result, so it need not be tried again.
    rest = cascade([rule for rule in order if rule.name != "base"])
    return measures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & rest.isNull()).alias("kept"),
    )
