"""Spelling variants: words one edit apart, found by a frontier of states in a relational trie.

Words are prefixes' ends in a path-compressed trie that is a table. A prefix is a node if it ends a
word or has more than one next letter; an edge (node, letter, child, depth, label) leads to the
next node, its label kept as a hash. A state is (word, target, node, position): a word, the word it
becomes by its one edit, and how far that target has been followed.

Two near words part at a node: the longest prefix they share. With the edit where they part, a word
is near the target that has another letter there (`letter` and the rest), or that lacks its letter
there. Insertions are deletions seen from the other word, and of two words that replace a letter the
one with the smaller letter looks for the other, so every near pair is found once. Deleting any
letter of a run of equal ones gives the same word, so only the run's last one is deleted.

Words are spelled forwards and backwards, in a trie each. An edit in a word's second half is searched
forwards and one in its first half backwards, so states begin below nodes of half a word or more:
there are few other letters there, and no state passes the few nodes at the top that all words share.

1. At every such node on a word's path the letter there is replaced or deleted: states on one edge.
2. Level by level, states are joined with the edge that begins with their target's next letter, and
   those stay whose target has the edge's label. Of a node's edges there are at most 90, the letters.
3. A state that reaches a word's end where its target ends is terminal; it counts if the target is
   in the table of words, so hashes only guide the search.

There are as many rounds as a path has nodes, not letters: long words cost no more rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import Powers, as_bytes, map_batches, written

SHORTEST, RAREST, TIMES, HOLED = 7, 2, 10, 31
#: Runs of lower-cased UTF-8 that may become words, U+00C0 to U+00FF being C3 80 to C3 BF.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % SHORTEST)
#: The letters by code point.
LETTERS = pa.array(map(chr, range(256)), pa.string())
#: No edit is searched above nodes of so many letters.
LEAST_DEPTH = SHORTEST // 2
#: Runs that a task counts before it hands on what it has.
HELD = 500_000


def grouped(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the frequent word it is a variant of.

    Texts that are null or empty have no words; texts and words of any length are read whole. Rows
    that repeat are counted each; a null doc_id counts as an empty one. Other columns are not read,
    whatever their names. Of near words with the same n the first in code-point order is the form.
    """
    words = written(_words(documents).withColumn("id", F.monotonically_increasing_id()), "words")
    near = _near(words)
    both = written(near.union(near.select("other", "word")).toDF("word", "other"), "near-words")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # Words of one edit are at most 90 for each letter, so a word's others are no unbounded group.
    best = both.join(others, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best")
    )
    best = best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.col1")).alias("form_n"))
    held = F.col("form_n") >= TIMES * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(held, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(held, F.col("form_n")).alias("form_n"),
    )
    formed = written(formed, "forms")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    root = F.coalesce("root", "word").alias("root")
    return formed.join(roots, "word", "left").select("word", "form", root, "n", "n_near", "form_n")


def _words(documents: DataFrame) -> DataFrame:
    """(word, n): the words that are long and frequent enough, counted before they are shuffled."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                start = zlib.crc32(b":", start)
                for run, n in Counter(RUNS.findall((text or b"").lower())).items():
                    if zlib.crc32(run, start) % HOLED == 0:
                        run = _holed(run, zlib.crc32(run, start))
                    if len(run) >= SHORTEST:
                        held[run] += n
                if len(held) > HELD:
                    yield _rows(held)
                    held = Counter()
        yield _rows(held)

    counted = map_batches(documents.select("doc_id", as_bytes("text").alias("text")), count, "run binary, n bigint")
    total = counted.groupBy(F.col("run").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= RAREST) & (F.length("word") >= SHORTEST))


def _rows(held: Counter) -> dict:
    return {"run": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())}


def _holed(run: bytes, number: int) -> bytes:
    """A run without the code point at ``number`` modulo its length."""
    letters = run.decode()
    at = number % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _prefixes(spelled: DataFrame) -> DataFrame:
    """(id, depth, node, letter): every prefix of ``LEAST_DEPTH`` letters or more by a hash, with the letter behind it.

    Hashes are running sums, so the work is linear in a word's length. Both directions have their own.
    """

    def explode(batches):
        powers = Powers()
        for batch in batches:
            for ids, some in _portions(batch["id"], batch["spelling"]):
                # The next spelling begins behind each spelling's end.
                points = np.frombuffer("\0".join([*some, ""]).encode("utf-32-le"), "<u4")
                ends = np.flatnonzero(points == 0)
                starts = np.concatenate([[0], ends[:-1] + 1])
                sizes = ends + 1 - starts - LEAST_DEPTH
                number = np.repeat(np.arange(len(some)), sizes)
                at = np.arange(len(number)) + (starts + LEAST_DEPTH - np.concatenate([[0], np.cumsum(sizes)[:-1]]))[number]
                ids = np.array(ids, np.int64)
                backwards = np.repeat(ids < 0, ends + 1 - starts)
                hashes = powers.between(powers.sums(points + np.where(backwards, np.uint64(1 << 32), np.uint64(0))), starts[number], at)
                yield {
                    "id": ids[number],
                    "depth": (at - starts[number]).astype(np.int32),
                    "node": hashes.view(np.int64),
                    "letter": LETTERS.take(pa.array(points[at], mask=points[at] == 0)),
                }

    return map_batches(spelled.select("id", "spelling"), explode, "id bigint, depth int, node bigint, letter string")


def _portions(ids: list[int], words: list[str], most: int = 1 << 17):
    """Some words at a time, as every letter becomes a row."""
    start = size = 0
    for end, word in enumerate(words, 1):
        size += len(word)
        if size >= most or end == len(words):
            yield ids[start:end], words[start:end]
            start, size = end, 0


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (word, back, length, depth, node, ends, letter, after): each spelling at each node it passes,
    with its next two letters; edges (node, letter, child, child_depth, label, child_ends)."""
    backwards = words.select((-1 - F.col("id")).alias("id"), F.reverse("word").alias("spelling"))
    spelled = words.select("id", F.col("word").alias("spelling")).union(backwards)
    prefixes = written(_prefixes(spelled), "prefixes")
    ends = F.max(F.col("letter").isNull().cast("int")).alias("ends")
    nodes = prefixes.groupBy("node").agg(F.min("letter").alias("a"), F.max("letter").alias("b"), ends)
    nodes = nodes.filter("ends = 1 OR a <> b").select("node", (F.col("ends") == 1).alias("ends"))
    passed = prefixes.join(nodes, "node").join(spelled, "id")
    # A word passes no more nodes than it has letters.
    own = Window.partitionBy("id").orderBy("depth")
    steps = [F.lead(c).over(own).alias(f"child_{c}") for c in ("node", "depth", "ends")]
    word = F.col("spelling").alias("word")
    back, length = (F.col("id") < 0).alias("back"), F.length("spelling").alias("length")
    paths = passed.select(word, back, length, "depth", "node", "ends", "letter", *steps)
    label = F.xxhash64(_part("word", F.col("depth"), F.col("child_depth") - F.col("depth"))).alias("label")
    paths = written(paths.select("*", _part("word", F.col("depth") + 1, 1).alias("after"), label), "paths")
    edges = paths.filter("child_node IS NOT NULL").select(
        "node", "letter", F.col("child_node").alias("child"), "child_depth", "label", "child_ends"
    )
    half = F.expr("CASE WHEN back THEN length - length DIV 2 ELSE length DIV 2 END")
    return paths.filter(F.col("depth") >= half), written(edges.distinct(), "edges")


def _part(text: str, start: Column | str, size: Column | int) -> Column:
    """``size`` letters behind the first ``start``."""
    start = F.col(start) if isinstance(start, str) else start
    return F.substring(F.col(text), start + 1, F.lit(size) if isinstance(size, int) else size)


def _near(words: DataFrame) -> DataFrame:
    """(word, other): every pair of near words once, from (id, word)."""
    paths, edges = _trie(words)
    level, terminal = _begun(paths, edges), []
    while True:
        level = written(level, "frontier")
        terminal.append(level.filter("done"))
        states = level.filter("NOT done")
        if states.isEmpty():
            break
        level = _advanced(states, edges)
    forwards = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)) for c in ("word", "target")]
    pairs = reduce(DataFrame.union, terminal).select(*forwards).toDF("word", "other").distinct()
    return pairs.join(words.select(F.col("word").alias("other")), "other").select("word", "other")


def _begun(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge behind the edit, and those whose target ends at the edit itself."""
    shortened = paths.filter(f"depth = length - 1 AND ends AND depth >= {SHORTEST}").select(
        "word", "back", _part("word", F.lit(0), F.col("depth")).alias("target"), "node", F.col("depth").alias("position"), F.lit(True).alias("done")
    )
    here = paths.filter("letter IS NOT NULL").select(
        "word", "back", "length", F.col("depth").alias("position"), "node", F.col("letter").alias("old"), "after"
    )
    deleted = F.expr(f"letter = after AND letter <> old AND length > {SHORTEST}")
    met = here.join(edges, "node").filter(F.expr("letter > old") | deleted)
    head, rest = _part("word", F.lit(0), F.col("position")), _part("word", F.col("position") + 1, F.col("length"))
    targets = F.array(F.when(F.expr("letter > old"), F.concat(head, "letter", rest)), F.when(deleted, F.concat(head, rest)))
    return _followed(met.withColumn("target", F.explode(F.array_compact(targets)))).unionByName(shortened)


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further, where their target has that edge."""
    ahead = states.drop("done").withColumn("letter", _part("target", "position", 1))
    return _followed(ahead.join(edges, ["node", "letter"]))


def _followed(states: DataFrame) -> DataFrame:
    """The states whose target has the label of their edge, at its child; dropped if the target ends
    where no word does."""
    length = F.length("target")
    label = F.xxhash64(_part("target", "position", F.col("child_depth") - F.col("position")))
    done = F.col("child_depth") == length
    same = states.filter((F.col("child_depth") <= length) & (label == F.col("label")) & (~done | F.col("child_ends")))
    return same.select(
        "word", "back", "target", F.col("child").alias("node"), F.col("child_depth").alias("position"), done.alias("done")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, twice as far each round.

    Each form occurs ``TIMES`` as often as its word, so 64-bit counts end every chain within 19.
    """
    reached = written(forms, "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "roots")
        if step.filter("moved").isEmpty():
            return reached
        reached = step.drop("moved")
