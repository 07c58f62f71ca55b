"""Packing of tokenized documents into sequences by cutting-stock column generation.

1. Each document becomes ids and an end id, cut at every 4096; only its last piece is shorter.
2. Pieces are counted by size, exactly up to 256 tokens and in steps of 16 above. The histogram,
   bounded by the number of sizes, goes to the driver. Short pieces of one size are bundled so that
   a bundle is nearly a multiple of 16 long. Column generation finds patterns of bundles and longer
   pieces that fill sequences.
3. A piece's rank in its size decides its bundle, pattern, sequence and slot by arithmetic. Ranks
   are counted within a partition and lifted by the counts of the partitions before it, so no
   task ever sees all pieces of a size.
"""

from __future__ import annotations

import os
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import REMEMBERED_WORDS, Remembered, as_bytes, map_batches, written
from parley.llm.cutting_stock import plan

LENGTH = 4096
END = 2
#: Pieces up to this size are counted exactly; a bundle of them has at most BUNDLE tokens.
EXACT, BUNDLE = 256, 512
#: What the classes of the plan are multiples of.
STEP = 16
#: Upper ends of the sizes of pieces, and of the size classes of the plan.
SIZES = np.concatenate([np.arange(1, EXACT + 1), np.arange(EXACT + STEP, LENGTH + 1, STEP)])
CLASSES = np.arange(STEP, LENGTH + 1, STEP)
TOKENIZER = "word_bpe_49k.json"
#: ASCII and Latin-1 letters, whose lower case is one letter, and ASCII signs behind them.
LETTERS = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[!-/:-@\\[-`{-~]*)$"
#: Texts that are tokenized together.
TOGETHER = 1000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(documents: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Null and empty texts consist of the end id alone. Each row of ``documents`` is packed, also
    where rows repeat or have no doc_id. ``with_ids`` adds the piece's ids as
    little-endian 32-bit numbers. A sequence's pieces lie gapless from offset 0.
    """
    pieces = written(_pieces(documents, tokenizer or tokenizer_path(), with_ids), "pieces")
    counts = pieces.groupBy("part", "class").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lifts = counts.select("part", "class", F.coalesce(before, F.lit(0)).alias("lift"))
    number = np.zeros(len(SIZES), np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most one row per class
        number[row["class"]] = row["n"]
    bundles, demand = _bundles(number)
    ranked = pieces.join(lifts, ["part", "class"]).withColumn("rank", F.col("lift") + F.col("local"))
    return _placed(ranked, bundles, plan(CLASSES, demand, LENGTH), ["ids"] if with_ids else [])


class WordIds(Remembered):
    """Ids of a word as little-endian 32-bit bytes.

    The tokenizer drops white space and no token reaches across it, so a text's ids are those
    of its words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(2 * REMEMBERED_WORDS)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id ends a run of letters.
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[number for piece, number in pieces.items() if piece.endswith("</w>")]] = True

    def of(self, texts: list[bytes | None]) -> list[memoryview]:
        """The ids of each text. Each word is looked up once, however often the texts have it."""
        self.rest()
        split = pc.ascii_split_whitespace(pa.array([text or b"" for text in texts], pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = _listed(words.dictionary)
        before = self.before
        new = []
        for word in distinct:
            if word not in self:
                if (known := before.get(word)) is not None:
                    self[word] = known
                else:
                    new.append(word)
        self._learn(new)
        ids = pa.array(map(self.__getitem__, distinct), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        borders = ends[split.offsets.to_numpy()].tolist()
        whole = memoryview(ids.buffers()[2] or b"")
        return [whole[a:b] for a, b in zip(borders, borders[1:])]

    def made(self, key: bytes) -> bytes:
        ids = self.tokenizer.encode(key.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Signs are tokens apart from letters and case is dropped, so new words share letters.

        Words of other kinds are left to ``made``.
        """
        words = pa.array(new, pa.large_string())
        found = pc.extract_regex(words, LETTERS)
        words, found = words.filter(found.is_valid()), found.drop_null()
        cores = pc.utf8_lower(found.field("core")).dictionary_encode()
        signs = found.field("signs").dictionary_encode()
        behind = [self[sign] if sign else b"" for sign in _listed(signs.dictionary)]
        ids = pc.binary_join_element_wise(
            self._of_letters(cores.dictionary).take(cores.indices),
            pa.array(behind, pa.large_binary()).take(signs.indices),
            pa.scalar(b"", pa.large_binary()),
        )
        self.update(zip(_listed(words), _listed(ids)))

    def _of_letters(self, cores: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of words that are one run of letters each, tokenized as one text."""
        text = "\n".join(cores.to_numpy(zero_copy_only=False).tolist())
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []
        ids = np.array(found, "<u4")
        ends = np.append(0, 4 * (np.flatnonzero(self.ends[ids]) + 1)).astype(np.int64)
        if len(ends) != len(cores) + 1:
            raise ValueError("a word of letters is not one run for the tokenizer")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cores), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _listed(values: pa.Array) -> list[bytes]:
    """The bytes of an array without nulls; ``to_pylist`` takes several times as long."""
    return values.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _pieces(documents: DataFrame, tokenizer: str, with_ids: bool) -> DataFrame:
    """Pieces with their partition, size class and running number there."""

    def cut(batches):
        words = WordIds(tokenizer)
        end = np.uint32(END).astype("<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(len(SIZES), np.int64)
        for batch in batches:
            rows = []
            texts = batch["text"]
            found = (ids for at in range(0, len(texts), TOGETHER) for ids in words.of(texts[at : at + TOGETHER]))
            for doc_id, ids in zip(batch["doc_id"], found):
                ids = b"".join((ids, end))
                total = len(ids) // 4
                for start in range(0, total, LENGTH):
                    piece = ids[4 * start : 4 * (start + LENGTH)]
                    size = len(piece) // 4
                    group = int(np.searchsorted(SIZES, size))
                    rows.append((doc_id, start, size, zlib.crc32(piece), total, group, seen[group], piece))
                    seen[group] += 1
            if not rows:
                continue
            columns = list(zip(*rows))
            out = {
                n: pa.array(values, pa.int64())
                for n, values in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "local"), columns)
            }
            out["part"] = np.full(len(rows), part, np.int64)
            if with_ids:
                out["ids"] = pa.array(columns[-1], pa.binary())
            yield out

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class bigint, local bigint, part bigint"
    schema += ", ids binary" if with_ids else ""
    return map_batches(documents.select("doc_id", as_bytes("text").alias("text")), cut, schema)


class _Bundles(NamedTuple):
    """Of each class: pieces in a bundle, full bundles, planned size and first rank there of the
    full ones and of the one that holds the rest."""

    held: np.ndarray
    full: np.ndarray
    size: np.ndarray
    first: np.ndarray
    rest_size: np.ndarray
    rest_first: np.ndarray


def _bundles(number: np.ndarray) -> tuple[_Bundles, np.ndarray]:
    """Bundles of so many pieces of each class, and how many there are of each planned size."""
    demand = np.zeros(len(CLASSES), np.int64)
    out = _Bundles(*np.zeros((6, len(SIZES)), np.int64))
    for group, (size, n) in enumerate(zip(SIZES.tolist(), number.tolist())):
        # The fewest pieces whose bundle has the least room to spare for each of them.
        counts = range(1, BUNDLE // size + 1) if size <= EXACT else [1]
        held = min(counts, key=lambda count: -(-count * size // STEP) / count)
        full, rest = divmod(n, held)
        out.held[group], out.full[group] = held, full
        for pieces, bundles, sizes, firsts in ((held, full, out.size, out.first), (rest, min(rest, 1), out.rest_size, out.rest_first)):
            if bundles:
                planned = -(-pieces * size // STEP) - 1
                sizes[group], firsts[group] = planned, demand[planned]
                demand[planned] += bundles
    return out, demand


def _intervals(patterns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Columns (planned size, first rank, bundles in a sequence, first sequence, first slot), by size and rank."""
    rows, served, sequence = [], np.zeros(len(CLASSES), np.int64), 0
    for held, count in patterns:
        slot = 0
        for group in np.flatnonzero(held)[::-1]:
            rows.append((group, served[group], held[group], sequence, slot))
            served[group] += held[group] * count
            slot += held[group]
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def _placed(ranked: DataFrame, bundles: _Bundles, patterns: list[tuple[np.ndarray, int]], more: list[str]) -> DataFrame:
    """Every ranked piece at its place; bundles and intervals are bounded by classes, not by pieces."""
    group, first, held, sequence, slot = _intervals(patterns)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            kind, rank = np.array(batch["class"], np.int64), np.array(batch["rank"], np.int64)
            bundle, inside = np.divmod(rank, bundles.held[kind])
            rest = bundle >= bundles.full[kind]
            planned = np.where(rest, bundles.rest_size[kind], bundles.size[kind])
            rank = np.where(rest, bundles.rest_first[kind], bundles.first[kind] + bundle)
            chosen = np.empty(len(kind), np.int64)
            for one in np.unique(planned):
                low, high = np.searchsorted(group, [one, one + 1])
                own = planned == one
                chosen[own] = low + np.searchsorted(first[low:high], rank[own], side="right") - 1
            since = rank - first[chosen]
            out = {n: pa.array(batch[n], pa.int64()) for n in names}
            out["sequence_id"] = sequence[chosen] + since // held[chosen]
            out["slot"] = (slot[chosen] + since % held[chosen]) * BUNDLE + inside
            yield out | {n: pa.array(batch[n], pa.binary()) for n in more}

    schema = ", ".join(f"{n} bigint" for n in [*names, "sequence_id", "slot"]) + "".join(f", {n} binary" for n in more)
    placed = map_batches(ranked.select(*names, "class", "rank", *more), place, schema)
    # At most LENGTH pieces stand in one sequence.
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return placed.select(*names, "sequence_id", offset, *more)
