"""A minimal perfect hash of distinct numbers: n numbers to 0 .. n-1, each once.

Every level has two places for each number that is left. A number alone at its place stays there; the
others go on to the next level. Its index is the number of taken places before its own.
"""

from __future__ import annotations

import numpy as np

from parley.llm.common import mixed

#: Places for each number of a level, and what tells the levels' hashes apart.
ROOM, STEP = 2, np.uint64(0x9E3779B97F4A7C15)
WORD = np.uint64(64)


class PerfectHash:
    """Indexes of numbers. A number that was not given gets some index or -1, so callers verify."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            counts = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self.before.append(np.concatenate([[0], counts[:-1]]) + total)
            total += int(counts[-1])
        self.size = total

    @classmethod
    def of(cls, numbers: np.ndarray) -> PerfectHash:
        """From distinct unsigned 64-bit numbers."""
        left, levels = numbers.astype(np.uint64), []
        while len(left):
            words = -(-ROOM * len(left) // 64)
            places = _places(left, len(levels), words)
            held = np.bincount(places.astype(np.int64), minlength=64 * words)
            levels.append(np.packbits(held == 1, bitorder="little").view("<u8"))
            left = left[held[places.astype(np.int64)] > 1]
        return cls(levels)

    def index(self, numbers: np.ndarray) -> np.ndarray:
        out = np.full(len(numbers), -1, np.int64)
        left = np.arange(len(numbers))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            places = _places(numbers[left].astype(np.uint64), level, len(bits))
            word, bit = (places // WORD).astype(np.int64), places % WORD
            found = bits[word] >> bit & np.uint64(1) == 1
            lower = bits[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[left[found]] = before[word[found]] + np.bitwise_count(lower)
            left = left[~found]
        return out

    def dumped(self) -> list[bytes]:
        return [bits.tobytes() for bits in self.levels]

    @classmethod
    def loaded(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(bits, "<u8") for bits in levels])


def _places(numbers: np.ndarray, level: int, words: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(STEP) % (1 << 64))
    return mixed(numbers * STEP + salt) % np.uint64(64 * words)
