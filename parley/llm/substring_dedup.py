"""Repeated passages by a compacted De Bruijn graph of word windows.

An edge is a window of 35 consecutive words. Written out, the edges would be 35 times the
corpus; instead

1. **Paths.** Consecutive edges that share their minimizer (the smallest hash of an 8-word
   k-mer in them, at one place) are one path: one row of (minimizer, hash of the path's words,
   places), with all places in a text, so periodic texts have few rows. The minimizer follows
   from the edge's words alone, so an edge that occurs twice has one minimizer in both places.
2. **Nonbranching paths.** A minimizer with one path holds no repeated edge. One whose paths
   all spell the same words is nonbranching: all its edges are repeated, and a join marks the
   path as a whole.
3. **Branching paths** are spelled edge by edge, each distinct path once, from the words at
   one of its source coordinates, and counted with the number of its places.
4. The marks of a document are joined to its text, which is cut by them.

All steps are counts and equi-joins; no step pairs the places of a passage. What paths are joined
with is written first, so that Spark can split the partition of a minimizer that many texts have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Powers, as_bytes, gram_hashes, map_batches, only, passing, spaced_words, word_hashes, written

WINDOW = 35
KMER = 8
#: k-mers in a window, and so the most edges of one path; their marks fit one 64-bit number.
SPAN = WINDOW - KMER + 1
KEY = ["key", "digest"]
MARKS = ["starts", "masks", "further"]
#: Places of a path in its text: its start, and as 32-bit numbers those of ``further``.
PLACES = "1L + coalesce(length(further), 0) div 4"


def repeated_words_removed(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row per row of ``documents`` (doc_id, text).

    A word goes if it is covered by a 35-word window that also starts anywhere else, in the
    same or another row. Null texts have no words; texts of fewer than 35 words lose none.
    ``kept_text`` is null where nothing went. Rows that repeat a doc_id, or have none, are
    documents like others, so the words of a wholly repeated row go in both.
    """
    keyed = _keyed(documents)
    marked = keyed.join(_marks(keyed), KEY, "left")

    def cut(batches):
        for batch in batches:
            sizes, removed, digests, kept = [], [], [], []
            for text, *marks in zip(*(batch[name] for name in ("text", *MARKS))):
                words = spaced_words(text)
                keep = _uncovered(len(words), *marks)
                left = words if keep is None else [words[i] for i in np.flatnonzero(keep)]
                joined = b" ".join(left)
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(None if keep is None else joined)
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept": pa.array(kept, pa.binary()),
            }

    out = map_batches(
        marked.select("doc_id", "text", *MARKS),
        cut,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary",
    )
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept_text"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated words gone from ``text`` and ``n_chars`` brought in line.

    Texts that lose nothing stay as they are; all other columns and all rows are kept.
    """
    names = documents.columns
    digest = F.xxhash64(documents["text"])
    marks = _marks(_keyed(only(documents, "doc_id", "text")))
    marks = marks.select(*[F.col(n).alias(f"__{n}") for n in marks.columns])
    same = (F.coalesce(documents["doc_id"], F.lit(0)) == marks["__key"]) & (digest == marks["__digest"])
    cut = F.pandas_udf(_cut_texts, "string")
    text = F.when(F.col("__starts").isNull(), documents["text"]).otherwise(
        cut(as_bytes(documents["text"]), *[F.col(f"__{name}") for name in MARKS])
    )
    joined = documents.join(marks, same, "left").withColumn("__text", text)
    size = F.when(F.col("__starts").isNull(), documents["n_chars"]).otherwise(F.length("__text"))
    changed = {"text": F.col("__text"), "n_chars": size.cast("bigint")}
    return joined.select(*[changed.get(n, documents[n]).alias(n) for n in names])


def _cut_texts(texts, starts, masks, further):
    import pandas as pd

    out = []
    for text, *marks in zip(texts, starts, masks, further):
        if marks[0] is None:
            out.append(None)
            continue
        words = spaced_words(text)
        keep = _uncovered(len(words), *marks)
        out.append(b" ".join(words[i] for i in np.flatnonzero(keep)).decode())
    return pd.Series(out, dtype=object)


def _keyed(documents: DataFrame) -> DataFrame:
    """A row's key is its doc_id and a hash of its text; wholly repeated rows share it."""
    return documents.select(
        F.col("doc_id"),
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("key"),
        F.xxhash64("text").alias("digest"),
        as_bytes("text").alias("text"),
    )


def _uncovered(size: int, starts, masks, further) -> np.ndarray | None:
    """Which words no marked window covers; null if none is marked."""
    if starts is None or not len(starts):
        return None
    masks = np.asarray(masks, np.int64).astype(np.uint64)
    bits = (masks[:, None] >> np.arange(SPAN, dtype=np.uint64)) & np.uint64(1)
    row, offset = np.nonzero(bits)
    first = np.asarray(starts, np.int64)[row] + offset
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + WINDOW, -1)
    for own, more in zip(bits, further):
        if more is not None:
            for offset in np.flatnonzero(own):
                first = np.frombuffer(more, np.int32) + offset  # each once
                change[first] += 1
                change[first + WINDOW] -= 1
    return np.cumsum(change[:size]) == 0


def _least(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every SPAN consecutive values and its place, the leftmost among equals."""
    places, step = np.arange(len(values)), 1
    while step < SPAN:
        ahead = min(step, SPAN - step)
        smaller = values[ahead:] < values[:-ahead]
        values, places = (np.where(smaller, both[ahead:], both[:-ahead]) for both in (values, places))
        step += ahead
    return values, places


def _paths_of(words: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(minimizer, spelled, start, edges) of the paths of one text.

    A path's edges share the place of their minimizer, so an edge that a path repeats, as
    periodic texts do, is in another path each time. A path has at most SPAN edges.
    """
    least, places = _least(gram_hashes(words, KMER))
    start = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    edges = np.diff(np.append(start, len(least)))
    spelled = powers.between(powers.sums(words), start, start + edges + WINDOW - 1)
    return least[start], spelled, start, edges


def _met_again(least: np.ndarray, spelled: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """The first places of the paths of one text, by number, and the starts of each path's further ones."""
    order = np.lexsort((spelled, least))
    new = np.append(True, (spelled[order[1:]] != spelled[order[:-1]]) | (least[order[1:]] != least[order[:-1]]))
    if new.all():
        return np.arange(len(start)), [None] * len(start)
    borders = np.append(np.flatnonzero(new), len(order))
    start = start[order].astype(np.int32)
    return order[new], [start[a + 1 : b].tobytes() or None for a, b in zip(borders[:-1], borders[1:])]


def _paths(keyed: DataFrame) -> DataFrame:
    """A row for each distinct path of a text."""

    def find(batches):
        powers = Powers()
        for batch in batches:
            found, further = [], []
            for key, digest, text in zip(batch["key"], batch["digest"], batch["text"]):
                words = word_hashes(text, powers)
                if len(words) >= WINDOW:
                    least, spelled, start, edges = _paths_of(words, powers)
                    first, more = _met_again(least, spelled, start)
                    own = np.full((2, len(first)), [[key], [digest]], np.int64)
                    found.append((least[first].astype(np.int64), spelled[first].astype(np.int64), *own, start[first], edges[first]))
                    further += more
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                names = ["least", "spelled", "key", "digest", "start", "edges"]
                made = dict(zip(names, columns))
                made["start"], made["edges"] = made["start"].astype(np.int32), made["edges"].astype(np.int32)
                yield made | {"further": pa.array(further, pa.binary())}

    return map_batches(
        keyed.select("key", "digest", "text"),
        find,
        "least bigint, spelled bigint, key bigint, digest bigint, start int, edges int, further binary",
    )


def _marks(keyed: DataFrame) -> DataFrame:
    """(key, digest, starts, masks, further): bit i of a mask marks the window at its start + i, and at
    its further starts + i.

    A document's marks are one row; there is at most one per window start of its text, also
    where rows repeat a text and its key.
    """
    with passing(_paths(keyed), "paths") as paths:
        met = paths.groupBy("least").agg(
            F.sum(F.expr(PLACES)).alias("n"), F.min("spelled").alias("low"), F.max("spelled").alias("high")
        )
        shared = met.filter("n > 1").select("least", (F.col("low") != F.col("high")).alias("branching"))
        with passing(shared, "shared") as shared:
            seen = written(paths.join(shared, "least"), "shared-paths")
    masks = written(_spelled_masks(keyed, seen.filter("branching")), "masks")
    whole = F.expr("shiftleft(1L, edges) - 1")
    plain = seen.filter("not branching").select(*KEY, "start", whole.alias("mask"), "further")
    branched = seen.filter("branching").join(masks, ["least", "spelled"]).select(*KEY, "start", "mask", "further")
    marked = F.collect_set(F.struct("start", "mask", "further")).alias("marks")
    names = zip(("start", "mask", "further"), MARKS)
    return plain.union(branched).groupBy(*KEY).agg(marked).select(*KEY, *[F.col(f"marks.{n}").alias(m) for n, m in names])


def _spelled_masks(keyed: DataFrame, branching: DataFrame) -> DataFrame:
    """(least, spelled, mask): which edges of each distinct branching path are repeated."""
    place = F.min(F.struct(*KEY, "start", "edges")).alias("place")
    distinct = branching.groupBy("least", "spelled").agg(F.sum(F.expr(PLACES)).alias("n"), place)
    path = F.struct("least", "spelled", "n", "place.start", "place.edges")
    sources = distinct.groupBy(F.col("place.key").alias("key"), F.col("place.digest").alias("digest")).agg(
        F.collect_list(path).alias("paths")
    )

    def spell(batches):
        powers = Powers()
        for batch in batches:
            found = []
            for text, paths in zip(batch["text"], batch["paths"]):
                sums = powers.sums(word_hashes(text, powers))
                least, spelled, n, start, edges = np.array([tuple(p.values()) for p in paths], np.int64).T
                path = np.repeat(np.arange(len(paths)), edges)
                offset = np.arange(len(path)) - np.repeat(np.cumsum(edges) - edges, edges)
                first = start[path] + offset
                edge = powers.between(sums, first, first + WINDOW).astype(np.int64)
                found.append((least[path], spelled[path], n[path], offset, edge))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                yield dict(zip(["least", "spelled", "n", "offset", "edge"], columns))

    # A source may stand in several equal rows; its path is spelled once all the same.
    texts = keyed.join(sources, KEY).select("text", "paths")
    edges = map_batches(texts, spell, "least bigint, spelled bigint, n bigint, offset bigint, edge bigint")
    edges = written(edges, "edges")
    repeated = edges.groupBy("edge").agg(F.sum("n").alias("n")).filter("n > 1").select("edge")
    bit = F.expr("shiftleft(1L, cast(offset AS int))")
    return edges.join(repeated, "edge", "left_semi").groupBy("least", "spelled").agg(F.bit_or(bit).alias("mask"))
