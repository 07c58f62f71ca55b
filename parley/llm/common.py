"""What the operators of this package share: words, word hashes and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import drop_folder, new_folder

#: Words that a task remembers something about, in each of two generations; only time and
#: memory depend on it.
REMEMBERED_WORDS = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it again after a loss."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@contextmanager
def passing(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``written`` for the block: what reads the table must have been written when it ends."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, purpose)
    try:
        df.write.parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        drop_folder(spark, folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, so that no other column can clash with an operator's own."""
    return df.select(*[F.col(f"`{name}`").alias(name) for name in names])


def as_bytes(text: Column | str) -> Column:
    """The bytes of a text, so that Python never decodes it; null stays null."""
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; those six are the blanks that bytes.split() knows."""
    return text.split() if text else []


class Remembered(dict):
    """Values of keys, made when first asked for.

    When a generation is full the one before goes, so frequent keys stay and memory is bounded
    by two generations and the keys of one text or a few.
    """

    def __init__(self, most: int = REMEMBERED_WORDS) -> None:
        super().__init__()
        self.before: dict = {}
        self.most = most

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.made(key)
        self[key] = value
        return value

    def rest(self) -> None:
        """Called between texts: begins a new generation if this one is full."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()

    def made(self, key):
        raise NotImplementedError


#: One number for each byte value, and 0 for the blanks.
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Powers:
    """Powers of the multiplier and of its inverse, as far as the longest text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up), 1 << 14)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
                for base in (MULTIPLIER, INVERSE)
            )
        return self.up, self.down

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums of ``values`` times powers, from 0 on."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.of(len(values) + 1)[0][: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the values from ``first`` to before ``end``, whatever stands before them."""
        content = (sums[end] - sums[first]) * self.of(len(sums))[1][first]
        return mixed(content + mixed((end - first).astype(np.uint64)))


#: Words longer than this are hashed by a library, as no text can be built to defeat that.
LONG_WORD = 64


def word_hashes(text: bytes | None, powers: Powers) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, without making the words."""
    if not text:
        return np.empty(0, np.uint64)
    letters = np.frombuffer(text, np.uint8)
    blank = np.empty(len(letters) + 2, bool)
    blank[0] = blank[-1] = True
    np.take(BLANK, letters, out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, end = edges[::2], edges[1::2]
    out = powers.between(powers.sums(BYTES[letters]), first, end)
    for i in np.flatnonzero(end - first > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[first[i] : end[i]])
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words, by their word hashes."""
    starts = len(words) - size + 1
    if starts <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(starts, np.uint64)
    for step in range(size):
        total *= MULTIPLIER
        total += words[step : step + starts]
    return mixed(total)


def map_batches(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` on batches as dicts of lists; ``rows`` yields dicts of lists or arrays."""
    names = [part.split()[0] for part in _fields(schema)]

    def run(batches):
        for columns in rows(batch.to_pydict() for batch in batches):
            arrays = [columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name]) for name in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Parts of a DDL schema at its commas outside of angle brackets."""
    parts, depth = [""], 0
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            parts.append("")
        else:
            parts[-1] += char
    return [part.strip() for part in parts]
