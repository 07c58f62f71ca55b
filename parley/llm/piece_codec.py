"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary of a piece model is used as it is; the merging is done here. An agenda holds
the neighbouring pairs of a word that make a piece, best score first, leftmost among equals.
When a merge's turn comes it is skipped if a hash keyed by (seed, doc_id, position of the word in
the text, place, piece) falls below the dropout rate; it has another turn only if its parts
change. So every occurrence of a word is drawn on its own, always from the same seed in the same
way. At a rate of 0 the segmentation is the model's own.

The turns of a word form a tree: a turn's outcome decides the next turn. Branches are remembered
once they were taken, and the words of some texts walk through their trees together. Words that
leave their trees, or have none, are merged together, one turn of each at a time, and add their
branches. Their symbols are rows of a matrix; a pair of symbols is looked up in a sorted array.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import MULTIPLIER, REMEMBERED_WORDS, as_bytes, map_batches, mixed

MODEL = "piece_bpe_32k.model"
SEED, DROPOUT = 6, 0.1
MARK = "▁"
#: Stands for a literal mark while merging; no text holds it.
HIDDEN = "\ud800"
#: No piece of the model holds a line break or a mark after another character, so words with
#: the blanks before them are merged on their own.
WORD = re.compile(r"\n| *[^ \n]+| +")
#: The rank of a pair that makes no piece.
NO_PIECE = np.iinfo(np.int32).max
#: Code points, and so symbols that are no pieces.
CODES = 0x110000
#: Symbols of a word up to which it is merged together with others, and how many words are.
SHORT_WORD, MERGED = 48, 1 << 14
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 20
#: Turns that the trees of a task remember, at most, but for those of one text.
TURNS = 2_000_000
WRAP = (1 << 64) - 1
#: Odd factors that spread the bits of a draw.
FACTORS = 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model: ids and ranks of those that merge, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        #: Merges with a smaller rank come first.
        self.ranks: dict[str, float] = {}
        #: A random number of each piece that merges.
        self.turns: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        self.size = model.get_piece_size()
        for number in range(self.size):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = number
                self.bytes.append(bytes([value]))
            elif model.is_control(number) or model.is_unknown(number):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.ranks[piece] = number, -model.get_score(number)
                self.turns[piece] = xxhash.xxh3_64_intdigest(piece.encode())
                self.bytes.append(piece.replace(MARK, " ").encode())
        self._paired()

    def _paired(self) -> None:
        """Numbers of symbols and pairs of them. A piece has its id, any other sign its code point behind the ids."""
        #: The symbol of each code point in a text, where a blank is written as a mark.
        self.symbols = np.arange(CODES, dtype=np.int64) + self.size
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = number
        self.symbols[ord(" ")] = self.symbols[ord(MARK)]
        self.symbols[ord(MARK)] = self.size + ord(HIDDEN)
        #: What fills a row behind its word.
        self.none, self.room = self.size + CODES, self.size + CODES + 1
        parts, made = [], []
        for piece, number in self.ids.items():
            for cut in range(1, len(piece)):
                pair = [self._symbol(part) for part in (piece[:cut], piece[cut:])]
                if None not in pair:
                    parts.append(pair[0] * self.room + pair[1])
                    made.append(number)
        order = np.argsort(np.array(parts, np.int64))
        #: The pairs that make a piece, with it and its rank; the last stands for all others.
        self.pairs = np.append(np.array(parts, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], 0)
        rank, self.turn_of = np.zeros(self.size, np.int32), np.zeros(self.size, np.uint64)
        numbers = list(self.ids.values())
        rank[numbers] = np.unique(list(self.ranks.values()), return_inverse=True)[1]
        self.turn_of[numbers] = list(self.turns.values())
        self.pair_ranks = rank[self.made]
        self.pair_ranks[-1] = NO_PIECE
        self.bytes_of = pa.array(self.bytes, pa.large_binary())
        self.spelled = np.array(self.byte_ids, np.uint32)

    def _symbol(self, part: str) -> int | None:
        number = self.ids.get(part)
        return self.size + ord(part) if number is None and len(part) == 1 else number

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols."""
        pair = left * self.room + right
        at = np.searchsorted(self.pairs, pair)
        at[self.pairs[at] != pair] = -1
        return self.pair_ranks[at], self.made[at]

    def named(self, symbol: int) -> str:
        if symbol >= self.size:
            return chr(symbol - self.size)
        return self.bytes[symbol].decode().replace(" ", MARK)

    def ids_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each symbol has): a sign that is no piece has those of its bytes."""
        unknown = symbols >= self.size
        counts = np.ones(len(symbols), np.int64)
        codes = symbols[unknown] - self.size
        codes[codes == ord(HIDDEN)] = ord(MARK)
        counts[unknown] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        ids, spelled = np.empty(counts.sum(), np.uint32), np.repeat(unknown, counts)
        ids[~spelled] = symbols[~unknown]
        ids[spelled] = self.spelled[np.frombuffer("".join(map(chr, codes.tolist())).encode(), np.uint8)]
        return ids, counts

    def decoded(self, ids: list[int]) -> bytes:
        """The text; the blank that encoding puts before it goes again."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Segmenter:
    """Ids of texts as little-endian 32-bit bytes; ``document`` is the key of the present one."""

    def __init__(self, pieces: Pieces, seed: int, dropout: float, document: int = 0) -> None:
        self.pieces, self.seed, self.document = pieces, seed, document
        #: Draws below this are skipped merges.
        self.limit = min(int(dropout * (1 << 64)), WRAP)
        self._forget()

    def _forget(self) -> None:
        #: word -> its first turn, or -1 if it has no tree: it was met once so far, or is too long.
        self.first: dict[str, int] = {}
        #: Of each turn: the number of its place and piece, and what follows if it is merged or skipped. An end
        #: follows itself. -1 is not known yet.
        self.turn, self.merged, self.skipped = (np.zeros(1 << 12, kind) for kind in (np.uint64, np.int32, np.int32))
        self.count = 0
        #: Of each end: where its ids begin, and how many it has.
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.filled = np.zeros(1 << 12, np.uint32), 0

    def encoded(self, text: str) -> bytes:
        """Ids of a text. A literal mark is spelled in bytes, so it is not taken for a blank."""
        return self.encoded_all([text], [self.document])[0].tobytes()

    def encoded_all(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """The ids of some texts, by the keys of their documents."""
        if self.count > TURNS or len(self.first) > REMEMBERED_WORDS:
            self._forget()
        split = [WORD.findall(" " + text) if text else [] for text in texts]
        words = [word for own in split for word in own]
        sizes = np.array(list(map(len, split)), np.int64)
        drawn = self._drawn(documents, sizes)
        at = self._begun(words)
        before, active = at.copy(), np.flatnonzero(at >= 0)
        while len(active):
            now = at[active]
            then = np.where(self._skipped(drawn[active], self.turn[now]), self.skipped[now], self.merged[now])
            at[active] = then
            active = active[(then >= 0) & (then != now)]
        # Ends' ids are read where they are remembered; those of words merged now are put behind them.
        left, length = np.flatnonzero(at < 0), np.zeros(len(words), np.int64)
        start = length.copy()
        known = np.flatnonzero(at >= 0)
        start[known], length[known] = self.begin[at[known]], self.size[at[known]]
        pool, filled = [self.ids[: self.filled]], self.filled
        size = np.fromiter((len(words[i]) for i in left.tolist()), np.int64, len(left))
        long = size > SHORT_WORD
        short = left[~long][np.argsort(size[~long], kind="stable")]
        for some in (short[i : i + MERGED] for i in range(0, len(short), MERGED)):
            node = before[some]
            symbols, row = self._merged_together([words[i] for i in some.tolist()], drawn[some], node)
            ids, counts = self.pieces.ids_of(symbols)
            length[some] = own = np.bincount(row, counts, len(some)).astype(np.int64)
            start[some] = filled + np.cumsum(own) - own
            self._ended(node, ids, own)
            pool.append(ids)
            filled += len(ids)
        for i in left[long].tolist():
            symbols = list(words[i].replace(MARK, HIDDEN).replace(" ", MARK))
            ids = np.frombuffer(self._ids(self._merged_long(symbols, int(drawn[i]))), "<u4")
            start[i], length[i] = filled, len(ids)
            pool.append(ids)
            filled += len(ids)
        end = np.cumsum(length)
        whole = np.concatenate(pool)[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]
        borders = np.append(0, end)[np.append(0, np.cumsum(sizes))].tolist()
        whole = whole.astype("<u4", copy=False)
        return [whole[a:b] for a, b in zip(borders, borders[1:])]

    def _occurrences(self, count: int) -> np.ndarray:
        """A number for each word of the text, by the seed, the document and the word's position."""
        return self._drawn([self.document], np.array([count]))

    def _drawn(self, documents: list[int], counts: np.ndarray) -> np.ndarray:
        keys = [xxhash.xxh3_64_intdigest(b"%d %d" % (self.seed, document)) for document in documents]
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return mixed(place.astype(np.uint64) * MULTIPLIER + np.repeat(np.array(keys, np.uint64), counts))

    def _begun(self, words: list[str]) -> np.ndarray:
        """The first turns of words. A tree is begun when a word comes again; many come once."""
        first = self.first
        at = np.array([first.get(word, -1) for word in words], np.int64)
        without = np.flatnonzero(at < 0)
        node = self._nodes(len(without))
        for i in without.tolist():
            word = words[i]
            known = first.setdefault(word, -2)
            if known == -2:
                first[word] = -1
            elif known == -1 and len(word) <= SHORT_WORD:
                first[word] = at[i] = node
                node += 1
            else:
                at[i] = known
        self.count = node
        return at

    def _nodes(self, more: int) -> int:
        """The first of some new turns of which nothing is known."""
        start = self.count
        self.count += more
        while self.count > len(self.turn):
            self.turn, self.merged, self.skipped, self.begin, self.size = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.turn, self.merged, self.skipped, self.begin, self.size)
            )
        self.turn[start : self.count] = 0
        self.merged[start : self.count] = self.skipped[start : self.count] = -1
        return start

    def _skipped(self, drawn: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return _draws(drawn, turns) < np.uint64(self.limit)

    def _ended(self, node: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remembers the ids of the ends that words have come to; ``node`` is -1 for words without a tree."""
        node, at = np.unique(node, return_index=True)
        node, at = node[node >= 0], at[node >= 0]
        self.merged[node] = self.skipped[node] = node
        size = counts[at]
        end = np.cumsum(size)
        total = int(size.sum())
        self.begin[node], self.size[node] = self.filled + end - size, size
        while self.filled + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        first = (np.cumsum(counts) - counts)[at]
        self.ids[self.filled : self.filled + total] = ids[np.repeat(first - end + size, size) + np.arange(total)]
        self.filled += total

    def _grown(self, node: np.ndarray, rows: np.ndarray, turns: np.ndarray, skip: np.ndarray) -> None:
        """Takes words to what follows their turns, which is remembered."""
        own = node[rows] >= 0
        rows, turns, skip = rows[own], turns[own], skip[own]
        at = node[rows]
        self.turn[at] = turns
        then = np.where(skip, self.skipped[at], self.merged[at])
        new = then < 0
        distinct, which = np.unique(2 * at[new] + skip[new], return_inverse=True)
        number = self._nodes(len(distinct)) + np.arange(len(distinct))
        odd = distinct & 1 == 1
        self.skipped[distinct[odd] >> 1], self.merged[distinct[~odd] >> 1] = number[odd], number[~odd]
        then[new] = number[which]
        node[rows] = then

    def _merged_together(self, words: list[str], drawn: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols after all merges, their words), a turn of every word at a time.

        ``node`` holds the first turns of the words' trees, or -1, and is brought to their ends.
        """
        pieces, size = self.pieces, np.fromiter(map(len, words), np.int64, len(words))
        stride = int(size.max()) + 1  # a column behind every word
        place = np.arange(size.sum()) + np.repeat(np.arange(len(words)) * stride - np.cumsum(size) + size, size)
        symbol = np.full(len(words) * stride, pieces.none, np.int64)
        symbol[place] = pieces.symbols[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        rank, piece = np.full(len(symbol), NO_PIECE, np.int32), np.zeros(len(symbol), np.int64)
        rank[place], piece[place] = pieces.joined(symbol[place], symbol[place + 1])
        ranks = rank.reshape(-1, stride)
        column = np.tile(np.arange(stride), len(words))
        #: The columns of the symbols beside each symbol.
        after, before = column + 1, column - 1
        active = np.arange(len(words))
        while True:
            at = ranks[active].argmin(axis=1)
            here = active * stride + at
            more = rank[here] < NO_PIECE
            active, at, here = active[more], at[more], here[more]
            if not len(active):
                break
            made = piece[here]
            turns = pieces.turn_of[made] + at.astype(np.uint64) * np.uint64(FACTORS[0])
            skip = self._skipped(drawn[active], turns)
            self._grown(node, active, turns, skip)
            rank[here[skip]] = NO_PIECE
            begin, at, here, made = (some[~skip] for some in (active * stride, at, here, made))
            right = begin + after[here]
            symbol[here], symbol[right], rank[right] = made, -1, NO_PIECE
            after[here] = after[right]
            follower, leader = begin + after[here], begin + before[here]
            before[follower] = at
            own = before[here] >= 0
            left = np.concatenate([here, leader[own]])
            rank[left], piece[left] = pieces.joined(symbol[left], np.concatenate([symbol[follower], made[own]]))
        place = np.flatnonzero((symbol >= 0) & (symbol != pieces.none))
        return symbol[place], place // stride

    def _ids(self, symbols: list[str]) -> bytes:
        ids = array("I")
        for symbol in symbols:
            number = self.pieces.ids.get(symbol)
            if number is not None:
                ids.append(number)
                continue
            ids.extend([self.pieces.byte_ids[byte] for byte in symbol.replace(HIDDEN, MARK).encode()])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def _skips(self, word: int, turn: int) -> bool:
        """The draw of a merge, by the occurrence of its word and its turn; the same as ``_draws``."""
        if not self.limit:
            return False
        draw = (word ^ turn) * FACTORS[0] & WRAP
        draw = (draw ^ draw >> 32) * FACTORS[1] & WRAP
        return (draw ^ draw >> 32) < self.limit

    def _turn(self, place: int, piece: str) -> int:
        """A number for the characters before a merge and its piece."""
        return self.pieces.turns[piece] + place * FACTORS[0] & WRAP

    def _merged(self, symbols: list[str], word: int) -> list[str]:
        """The symbols of one short word after all merges."""
        text = "".join(symbols).replace(MARK, " ").replace(HIDDEN, MARK)
        found, _ = self._merged_together([text], np.array([word], np.uint64), np.array([-1]))
        return [self.pieces.named(symbol) for symbol in found.tolist()]

    def _merged_long(self, symbols: list[str], word: int) -> list[str]:
        """The same for words of any length; the agenda is a heap."""
        ranks, count = self.pieces.ranks, len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        agenda = [(ranks[p], at, p) for at in range(count - 1) if (p := symbols[at] + symbols[at + 1]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, at, piece = heapq.heappop(agenda)
            right = after[at]
            # Gone if one of its parts has been merged since.
            if not symbols[at] or right >= count or symbols[at] + symbols[right] != piece or self._skips(word, self._turn(at, piece)):
                continue
            symbols[at], symbols[right] = piece, ""
            follower = after[at] = after[right]
            if follower < count:
                before[follower] = at
            for left, other in ((at, follower), (before[at], at)):
                if left >= 0 and other < count and (joined := symbols[left] + symbols[other]) in ranks:
                    heapq.heappush(agenda, (ranks[joined], left, joined))
        return [symbol for symbol in symbols if symbol]


def _draws(words: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A draw from all 64-bit numbers for each occurrence of a word and turn."""
    draws = (words ^ turns) * np.uint64(FACTORS[0])
    draws = (draws ^ draws >> np.uint64(32)) * np.uint64(FACTORS[1])
    return draws ^ draws >> np.uint64(32)


def segmented(
    documents: DataFrame, model: str | None = None, seed: int = SEED, dropout: float = DROPOUT, with_ids: bool = False
) -> DataFrame:
    """(doc_id, variant, n_pieces, ids_crc32, lossless), one row per row of ``documents`` (doc_id, text).

    ``lossless`` tells that the ids decode to exactly the text; a null text has no ids, like an
    empty one. ``variant`` is the document's key of all draws, by the seed and its doc_id (null: 0).
    ``with_ids`` adds the ids as little-endian 32-bit numbers.
    """
    path = model or model_path()

    def encode(batches):
        pieces = _pieces(path)
        segmenter = Segmenter(pieces, seed, dropout)
        for doc_ids, texts in _portions(batches):
            variants = [_variant(seed, doc_id) for doc_id in doc_ids]
            found = segmenter.encoded_all([text.decode() for text in texts], variants)
            rows = [(len(ids), zlib.crc32(ids), back == text, ids) for ids, back, text in zip(found, _back(pieces, found), texts)]
            n_pieces, checks, lossless, ids = (list(column) for column in zip(*rows))
            yield {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "variant": pa.array(variants, pa.int64()),
                "n_pieces": pa.array(n_pieces, pa.int64()),
                "ids_crc32": pa.array(checks, pa.int64()),
                "lossless": pa.array(lossless, pa.bool_()),
                "ids": pa.array([own.tobytes() if with_ids else None for own in ids], pa.binary()),
            }

    schema = "doc_id bigint, variant bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean"
    schema += ", ids binary" if with_ids else ""
    return map_batches(documents.select("doc_id", as_bytes("text").alias("text")), encode, schema)


def _portions(batches):
    """(doc_ids, texts) of about ``TOGETHER`` bytes; null texts are empty ones."""
    for batch in batches:
        doc_ids, texts, size = [], [], 0
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= TOGETHER:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
        if doc_ids:
            yield doc_ids, texts


def _back(pieces: Pieces, found: list[np.ndarray]) -> list[bytes]:
    """The texts of some texts' ids, without the blanks that encoding puts before them."""
    whole = pieces.bytes_of.take(pa.array(np.concatenate(found).astype(np.int64)))
    ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
    borders = ends[np.cumsum([0, *map(len, found)])].tolist()
    data = memoryview(whole.buffers()[2] or b"")
    return [bytes(data[min(a + 1, b) : b]) for a, b in zip(borders, borders[1:])]


def _variant(seed: int, doc_id: int | None) -> int:
    return 0 if doc_id is None else xxhash.xxh3_64_intdigest(b"%d %d" % (seed, doc_id)) >> 1


def decoded(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as ``segmented`` writes them; null ids give a null text."""
    path = model or model_path()

    def decode(batches):
        pieces = Pieces(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decoded(np.frombuffer(ids, "<u4").tolist()) for ids in batch["ids"]]
            yield {"doc_id": pa.array(batch["doc_id"], pa.int64()), "text": pa.array(texts, pa.binary())}

    found = map_batches(encoded.select("doc_id", "ids"), decode, "doc_id bigint, text binary")
    return found.select("doc_id", F.col("text").cast("string").alias("text"))
