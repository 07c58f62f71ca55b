"""Alignment of two tokenizers' tokens, and how many documents link each pair of their ids.

Byte offsets where tokens of both end cut a text's tokens into groups; in a group every token of one
is linked with every token of the other.

1. One pass aligns all documents and writes each one's own numbers, its distinct pairs and how often it
   has them; nothing is encoded twice.
2. Each task counts the documents that hold a pair, so what leaves it is one run of (pair, count) per shard
   of pairs, however often the pairs occur.
3. The shards' distinct pairs are united in a tree of ``FAN`` runs a step, and a minimal perfect hash
   of each shard's pairs is built. A run's counts become a dense vector by that hash, and the
   vectors are summed in a tree too. No step holds more than ``FAN`` runs or vectors of one shard, and
   a shard has at most |A| * |B| / ``SHARDS`` pairs whatever the input.
4. The documents' pairs are looked up: the hash gives a place, where the
   pair's own id is verified. Hashes, ids and counts are broadcast up to ``MOST_BROADCAST`` bytes. That
   many pairs and more are joined instead: then documents' pairs go to the counts. The highest count
   of an A id is always broadcast, as there are no more of them than A has ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import as_bytes, map_batches, mixed, written
from parley.llm.perfect_hash import PerfectHash

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS, FAN = 64, 16
MOST_BROADCAST = 128 << 20
#: Bytes of text that are aligned together, links that are expanded together, pairs that a task holds.
BATCH, EXPANDED, HELD = 1 << 20, 1 << 21, 1 << 22
#: Pairs of whole documents that are counted or looked up together.
TOGETHER = 1 << 18
#: The regular expressions of the fast encoder fail on much longer white space.
LONG_BLANK = re.compile(r"\s{4096}")
RUNS = "shard int, part bigint, pairs binary, counts binary"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def aligned(documents: DataFrame, first: str | None = None, second: str | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row.

    Null and empty texts, and those whose tokens' bytes are not a blank and the text, have no tokens:
    zeros and an empty string. Rows that repeat, or have no doc_id, are documents of their own and count
    as such. Texts of any length are aligned whole. Other columns are not read, whatever their names.
    ``n_best`` counts ties. Special strings in a text are plain text.
    """
    paths = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    texts = documents.select("doc_id", as_bytes("text").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = written(texts.mapInArrow(_aligned(paths), f"doc_id {kind}, {LOCAL}, {SHA}, {HELD_PAIRS}"), "aligned")
    counts = pair_counts(rows)
    best = counts.mapInArrow(_highest(paths), "a bigint, n bigint").groupBy("a").agg(F.max("n").alias("n")).toPandas()
    size = counts.agg(F.sum(F.length("pairs") + F.length("counts") + F.aggregate("levels", F.lit(0), lambda n, b: n + F.length(b)))).first()[0]
    if (size or 0) <= most:
        return _looked_up(rows, kind, paths, counts, best)
    return _joined(rows, paths, counts, best)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(shard, levels, pairs, counts): a shard's perfect hash, its pairs by that hash, their documents."""
    runs = written(rows.select("n_pairs", "pairs").mapInArrow(_runs, RUNS), "pair-runs")
    parts = runs.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1

    sets, left = runs.select("shard", "part", "pairs"), parts
    while left > 1:
        sets = _stepped(sets).applyInArrow(_united, "shard int, part bigint, pairs binary")
        left = -(-left // FAN)
    hashes = sets.groupBy("shard").applyInArrow(_hashed, "shard int, levels array<binary>, pairs binary")
    hashes = written(hashes, "pair-hashes")

    groups = max(-(-parts // FAN), 1)
    needed = hashes.select("shard", "levels", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("part"))
    vectors = _stepped(runs).cogroup(needed.groupBy("shard", "part")).applyInArrow(_dense, "shard int, part bigint, counts binary")
    while groups > 1:
        vectors = _stepped(vectors).applyInArrow(_summed, "shard int, part bigint, counts binary")
        groups = -(-groups // FAN)
    return written(hashes.join(vectors.drop("part"), "shard"), "pair-counts")


def _stepped(parts: DataFrame):
    return parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("shard", "part")


class Tokenizers:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(first) as file:
            model = json.load(file)
        special = {token["id"] for token in model["added_tokens"]}
        letters = _byte_letters()
        entries = {i: bytes(letters[c] for c in entry) for entry, i in model["model"]["vocab"].items() if i not in special}
        merged = [entries[i] for i in sorted(entries)[256:]]
        if merged != [bytes(letters[c] for c in "".join(pair)) for pair in model["model"]["merges"]]:
            raise ValueError(f"{first} does not number its merges in their order")
        # The same merges by the library that is four times faster; white space beyond its stack goes to the other.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {entry: i for i, entry in entries.items()}
        self.fast = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = first
        self.whole = None
        self.model = SentencePieceProcessor(model_file=second)
        self.bytes_a = [entries.get(i, b"") for i in range(max([*entries, *special]) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.model.vocab_size())]
        self.sizes = [np.array(list(map(len, some)), np.int64) for some in (self.bytes_a, self.bytes_b)]
        self.spelled = [pa.array(some, pa.large_binary()) for some in (self.bytes_a, self.bytes_b)]

    def _piece(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(number) else piece.replace("▁", " ").encode()

    def first(self, text: str) -> np.ndarray | list[int]:
        if not LONG_BLANK.search(text):
            return self.fast.encode_to_numpy(text)  # there are no special tokens
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def of(self, texts: list[bytes | None]) -> Batch:
        """Tokens of the texts that both tokenizers give back, one behind the other."""
        rows, found, wanted = [], ([], []), []
        for row, text in enumerate(texts):
            if not text:
                continue
            try:
                shown = text.decode()
            except UnicodeDecodeError:
                continue
            rows.append(row)
            found[0].append(self.first(" " + shown))
            found[1].append(self.model.encode(shown))
            wanted.append(b" " + text)
        tokens = [np.array(list(map(len, some)), np.int64) for some in found]
        ids = [
            np.concatenate([np.empty(0, np.int64), *found[0]]).astype(np.int64),
            np.fromiter(chain.from_iterable(found[1]), np.int64, tokens[1].sum()),
        ]
        whole = np.ones(len(rows), bool)
        for own, some, spelled in zip(ids, tokens, self.spelled):
            whole &= np.array([one == other for one, other in zip(_spelled(own, some, spelled), wanted)], bool)
        if not whole.all():
            ids = [own[np.repeat(whole, some)] for own, some in zip(ids, tokens)]
            rows, tokens = np.array(rows, np.int64)[whole], [some[whole] for some in tokens]
        return Batch(len(texts), rows, ids, tokens, self.sizes)


def _spelled(ids: np.ndarray, tokens: np.ndarray, spelled: pa.Array):
    """The bytes of each text's tokens."""
    whole = spelled.take(pa.array(ids))
    ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
    borders = ends[np.cumsum(np.append(0, tokens))].tolist()
    data = memoryview(whole.buffers()[2] or b"")
    return (bytes(data[a:b]) for a, b in zip(borders, borders[1:]))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level entries write each byte as: itself where it shows, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + n): byte for n, byte in enumerate(hidden)}


class Batch:
    """Some texts' tokens in groups. Groups never reach across texts, as both tokenizers end there."""

    def __init__(self, texts: int, rows, ids: list[np.ndarray], tokens: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """``ids`` of all texts, and how many ``tokens`` each of ``rows`` has of them."""
        self.rows, self.ids = np.array(rows, np.int64), ids
        self.tokens = [np.zeros(texts, np.int64) for _ in "ab"]
        for out, some in zip(self.tokens, tokens):
            out[self.rows] = some
        ends = [np.cumsum(size[own]) for size, own in zip(sizes, ids)]
        # Both have the same bytes, so ends are marked by place.
        marks = [np.zeros(end[-1] + 1 if len(end) else 1, bool) for end in ends]
        for mark, end in zip(marks, ends):
            mark[end] = True
        last = [mark[end] for mark, end in zip(reversed(marks), ends)]
        groups = int(last[0].sum())
        #: The group of each token, each group's tokens, and the text of each group.
        self.group = [np.cumsum(some) - some for some in last]
        self.held = [np.bincount(group, minlength=groups) for group in self.group]
        self.begin = [np.cumsum(held) - held for held in self.held]
        self.text = np.repeat(np.arange(texts), self.tokens[0])[self.begin[0]] if groups else np.empty(0, np.int64)
        self.texts, self.span = texts, len(sizes[0]) * len(sizes[1])

    def groups(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times), each pair of a text once; a pair is A's id times B's ids, plus B's id."""
        products = self.held[0] * self.held[1]
        large = products > EXPANDED
        # Text and pair are one number, which is faster to sort.
        single, small = (np.flatnonzero(some & ~large) for some in (products == 1, products > 1))
        key = np.concatenate([self._single(single, size_b), self._small(small, products, size_b)])
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        key, times = key[new], np.diff(np.append(new, len(key)))
        if large.any():
            found = [(key, times), *(part for group in np.flatnonzero(large) for part in self._large(group, size_b))]
            key, times = (np.concatenate(some) for some in zip(*found))
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, times = key[new], np.add.reduceat(times, new)
        return *np.divmod(key, self.span), times

    def _single(self, groups: np.ndarray, size_b: int) -> np.ndarray:
        """The links of groups of one token each."""
        a, b = (ids[begin[groups]] for ids, begin in zip(self.ids, self.begin))
        return self.text[groups] * self.span + a * size_b + b

    def _small(self, groups: np.ndarray, products: np.ndarray, size_b: int) -> np.ndarray:
        """All links of some groups; each has at most ``EXPANDED``."""
        total = products[groups]
        group = np.repeat(groups, total)
        within = np.arange(len(group)) - np.repeat(np.cumsum(total) - total, total)
        a = self.ids[0][self.begin[0][group] + within // self.held[1][group]]
        b = self.ids[1][self.begin[1][group] + within % self.held[1][group]]
        return self.text[group] * self.span + a * size_b + b

    def _large(self, group: int, size_b: int):
        """The distinct links of one group, with their times, some of A's ids at a time."""
        (a, times_a), (b, times_b) = (
            np.unique(ids[begin[group] : begin[group] + held[group]], return_counts=True)
            for ids, begin, held in zip(self.ids, self.begin, self.held)
        )
        step = max(EXPANDED // len(b), 1)
        for at in range(0, len(a), step):
            pair = (a[at : at + step, None] * size_b + b).ravel()
            yield self.text[group] * self.span + pair, (times_a[at : at + step, None] * times_b).ravel()

    def written_groups(self, names: tuple[pa.Array, pa.Array]) -> list[str]:
        """SHA-256 of each text's groups as ids: `a1,a2|b1;a3|b2,b3`."""
        out = [""] * self.texts
        if not len(self.rows):
            return out
        # A's tokens of a group stand before B's, and each id brings the sign behind it.
        place = [np.arange(len(ids)) for ids in self.ids]
        place[0] += self.begin[1][self.group[0]]
        place[1] += (self.begin[0] + self.held[0])[self.group[1]]
        code = np.empty(len(place[0]) + len(place[1]), np.int64)
        for ids, group, at, shift in zip(self.ids, self.group, place, (0, len(names[0]))):
            last = np.concatenate([group[1:] != group[:-1], [True]])
            code[at] = 2 * ids + last + shift
        whole = pa.concat_arrays(names).take(pa.array(code))
        ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
        borders = ends[np.concatenate([[0], np.cumsum((self.tokens[0] + self.tokens[1])[self.rows])])].tolist()
        data = memoryview(whole.buffers()[2])
        for row, start, end in zip(self.rows.tolist(), borders, borders[1:]):
            out[row] = hashlib.sha256(data[start : end - 1]).hexdigest()  # without the last sign
        return out


def _written_ids(tokenizers: Tokenizers) -> tuple[pa.Array, pa.Array]:
    """Every id with what stands behind it inside a group, and at its end."""
    return tuple(
        pa.array([f"{i}{sign}" for i in range(len(size)) for sign in (",", last)], pa.large_string())
        for size, last in zip(tokenizers.sizes, "|;")
    )


def _portions(texts: pa.Array):
    """(first row, texts) of about ``BATCH`` bytes."""
    start, size, some = 0, 0, []
    for row, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1] or b"")
        if size >= BATCH or row + 1 == len(texts):
            yield start, some
            start, size, some = row + 1, 0, []


def _shard(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) >> np.uint64(40)) % np.uint64(SHARDS)


def _runs(batches):
    """The pairs that a task's documents hold, with the number of documents, by shard."""

    def emitted(held, part):
        pairs, counts = _added([some for some, _ in held], [n for _, n in held])
        shard = _shard(pairs)
        order = np.argsort(shard, kind="stable")
        borders = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        rows = [(n, order[a:b]) for n, (a, b) in enumerate(zip(borders, borders[1:])) if b > a]
        columns = [
            pa.array([n for n, _ in rows], pa.int32()),
            pa.array([part] * len(rows), pa.int64()),
            pa.array([pairs[own].tobytes() for _, own in rows], pa.binary()),
            pa.array([counts[own].tobytes() for _, own in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "part", "pairs", "counts"])

    part = TaskContext.get().partitionId()
    held, size = [], 0
    for batch in batches:
        for some in _together(batch):
            pairs, counts = np.unique(_pairs(some), return_counts=True)
            held.append((pairs.astype(np.int64), counts))
            size += len(pairs)
            if size > HELD:
                held = [_added([some for some, _ in held], [n for _, n in held])]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield emitted(held, part)
                    held, size = [], 0
    if size:
        yield emitted(held, part)


def _together(batch: pa.RecordBatch):
    """Parts of a batch of whole documents with about ``TOGETHER`` pairs."""
    total = np.cumsum(batch.column("n_pairs").to_numpy())
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        end = max(int(np.searchsorted(total, before + TOGETHER, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _pairs(some: pa.RecordBatch) -> np.ndarray:
    """The pairs of some documents, one behind the other, in 32 or 64 bits as they were written."""
    data, n = b"".join(some.column("pairs").to_pylist()), int(some.column("n_pairs").to_numpy().sum())
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64)


def _times(some: pa.RecordBatch) -> np.ndarray:
    """How often each document has its pairs."""
    sizes = some.column("n_pairs").to_pylist()
    parts = some.column("times").to_pylist()
    if all(len(part) == n for part, n in zip(parts, sizes)):
        return np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    return np.concatenate([np.frombuffer(part, np.uint8 if len(part) == n else np.int64) for part, n in zip(parts, sizes)])


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts."""
    distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def _numbers(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), np.int64) for value in table.column(column)]


def _row(**columns) -> pa.Table:
    return pa.table(columns)


def _keys(key) -> dict:
    return {"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64())}


def _united(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    pairs = np.unique(np.concatenate(_numbers(table, "pairs")))
    return _row(**_keys(key), pairs=pa.array([pairs.tobytes()], pa.binary()))


def _hashed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    pairs = np.unique(np.concatenate(_numbers(table, "pairs")))
    found = PerfectHash.of(pairs)
    placed = np.empty_like(pairs)
    placed[found.index(pairs)] = pairs
    return _row(
        shard=pa.array([key[0].as_py()], pa.int32()),
        levels=pa.array([found.dumped()], pa.list_(pa.binary())),
        pairs=pa.array([placed.tobytes()], pa.binary()),
    )


def _dense(key: tuple[pa.Scalar, ...], runs: pa.Table, hashes: pa.Table) -> pa.Table:
    """The sum of some runs as a vector by the hash of their shard."""
    found = PerfectHash.loaded(hashes.column("levels")[0].as_py())
    total = np.zeros(found.size, np.int64)
    for pairs, counts in zip(_numbers(runs, "pairs"), _numbers(runs, "counts")):
        total[found.index(pairs)] += counts
    return _row(**_keys(key), counts=pa.array([total.tobytes()], pa.binary()))


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum(_numbers(table, "counts"), axis=0)
    return _row(**_keys(key), counts=pa.array([total.tobytes()], pa.binary()))


def _highest(paths: tuple[str, str]):
    """The highest count of each A id in each shard."""

    def run(batches):
        size_b = len(Tokenizers(*paths).bytes_b)
        for batch in batches:
            for pairs, counts in zip(_numbers(batch, "pairs"), _numbers(batch, "counts")):
                a, place = np.unique(pairs // size_b, return_inverse=True)
                highest = np.zeros(len(a), np.int64)
                np.maximum.at(highest, place, counts)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(highest)], ["a", "n"])

    return run


class Counts:
    """Counts of pairs by their hashes."""

    def __init__(self, shards: list) -> None:
        self.shards = {
            row.shard: (PerfectHash.loaded(row.levels), np.frombuffer(row.pairs, np.int64), np.frombuffer(row.counts, np.int64))
            for row in shards
        }

    def of(self, pairs: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(pairs, return_inverse=True)
        out, shard = np.zeros(len(distinct), np.int64), _shard(distinct)
        for number, (found, own, counts) in self.shards.items():
            here = np.flatnonzero(shard == number)
            at = found.index(distinct[here])
            if (at < 0).any() or (own[at] != distinct[here]).any():
                raise ValueError("a pair of the second pass is not among those of the first")
            out[here] = counts[at]
        return out[place]


SHA = "groups_sha256 string"
LOCAL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
#: A row's number, how many distinct pairs it has, the pairs in order, and how often it has each.
HELD_PAIRS = "row bigint, n_pairs bigint, pairs binary, times binary"


def _aligned(paths: tuple[str, str]):
    """Each text's own numbers and its pairs."""

    def run(batches):
        tokenizers = Tokenizers(*paths)
        names, size_b = _written_ids(tokenizers), len(tokenizers.bytes_b)
        narrow = np.uint32 if len(tokenizers.bytes_a) * size_b <= 1 << 32 else np.int64
        row = np.int64(TaskContext.get().partitionId()) << 40
        for batch in batches:
            for start, some in _portions(batch.column("text")):
                found = tokenizers.of(some)
                text, pair, times = found.links(size_b)
                borders = np.searchsorted(text, np.arange(len(some) + 1))
                pair, few = pair.astype(narrow), times.astype(np.uint8)
                few_times = (few == times).all()
                own = list(zip(borders.tolist(), borders[1:].tolist()))
                columns = {
                    "doc_id": batch.column("doc_id").slice(start, len(some)),
                    "n_a": found.tokens[0],
                    "n_b": found.tokens[1],
                    "n_groups": found.groups(),
                    "n_links": np.bincount(text, times, len(some)).astype(np.int64),
                    "groups_sha256": found.written_groups(names),
                    "row": row + np.arange(len(some)),
                    "n_pairs": np.diff(borders),
                    "pairs": pa.array([pair[a:b].tobytes() for a, b in own], pa.binary()),
                    "times": pa.array(
                        [(few if few_times or (times[a:b] < 256).all() else times)[a:b].tobytes() for a, b in own], pa.binary()
                    ),
                }
                row += len(some)
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
                yield pa.RecordBatch.from_arrays(arrays, list(columns))

    return run


def _table_of(best) -> np.ndarray:
    out = np.zeros(int(best.a.max()) + 1 if len(best) else 1, np.int64)
    out[best.a.to_numpy(np.int64)] = best.n.to_numpy(np.int64)
    return out


def _looked_up(rows: DataFrame, kind: str, paths, counts: DataFrame, best) -> DataFrame:
    """The size of the collected rows has been checked."""
    shared = rows.sparkSession.sparkContext.broadcast((counts.collect(), _table_of(best)))
    kept = [field.split()[0] for field in (*LOCAL.split(", "), SHA)]

    def run(batches):
        counts, highest = Counts(shared.value[0]), shared.value[1]
        size_b = len(Tokenizers(*paths).bytes_b)
        for batch in batches:
            for some in _together(batch):
                pair, times = _pairs(some).astype(np.int64), _times(some)
                text = np.repeat(np.arange(len(some)), some.column("n_pairs").to_numpy())
                n = counts.of(pair)
                sums = [np.zeros(len(some), np.int64) for _ in range(2)]
                np.add.at(sums[0], text, times * (n == highest[pair // size_b]))
                np.add.at(sums[1], text, times * n)
                columns = [some.column(name) for name in ("doc_id", *kept)] + [pa.array(own) for own in sums]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *kept, "n_best", "count_sum"])

    return _ordered(rows.mapInArrow(run, f"doc_id {kind}, {LOCAL}, {SHA}, n_best bigint, count_sum bigint"))


def _joined(rows: DataFrame, paths, counts: DataFrame, best) -> DataFrame:
    """The same by a join of the documents' pairs with the counts, which may be of any size."""

    def listed(batches):
        highest = _table_of(best)
        size_b = len(Tokenizers(*paths).bytes_b)
        for batch in batches:
            for pairs, n in zip(_numbers(batch, "pairs"), _numbers(batch, "counts")):
                columns = [pa.array(pairs), pa.array(n), pa.array(n == highest[pairs // size_b])]
                yield pa.RecordBatch.from_arrays(columns, ["pair", "n", "best"])

    def linked(batches):
        for batch in batches:
            for some in _together(batch):
                row = np.repeat(some.column("row").to_numpy(), some.column("n_pairs").to_numpy())
                columns = [pa.array(own) for own in (row, _pairs(some).astype(np.int64), _times(some))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "pair", "times"])

    links = rows.select("row", "n_pairs", "pairs", "times").mapInArrow(linked, "row bigint, pair bigint, times bigint")
    met = links.join(counts.mapInArrow(listed, "pair bigint, n bigint, best boolean"), "pair")
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    found = rows.join(sums, "row", "left")
    return _ordered(found.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_best", "count_sum")}))


def _ordered(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
