"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. A bounded sample of labelled documents gives the examples. Their words are the terms, all of
   them. Word beginnings that toxic examples have clearly more often are terms as well.
2. Document frequencies of the terms are counted over all documents. A term's weight is
   TF-IDF times an emphasis, 1 for most words, which grows with the standard errors by which
   toxic examples have it more often; beginnings have the part above 1 alone.
3. The examples' vectors form a block-max inverted index, bounded by the sample. Every
   document is scored against it: distance-weighted votes of the nearest examples, calibrated
   on the examples by leaving each one out, in tasks.

Terms are 64-bit hashes. Words that no example has stand in a document's length with the
frequency of a word seen once. Labels are read by doc_id to choose examples. Scores depend on
texts alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.block_max import BlockMaxIndex
from parley.llm.common import BYTES, Powers, Remembered, as_bytes, map_batches, only, written

#: Labelled documents that the classifier is fitted on, at most.
EXAMPLES = 16_000
#: Standard errors from which on a term is emphasised, and the emphasis of each further one.
CLEARLY, EMPHASIS = 3.0, 10.0
NEIGHBOURS = 10
#: Texts whose scores a task remembers, in each of two generations; results do not depend on it.
REMEMBERED_TEXTS = 20_000
#: Texts that search the index together.
TOGETHER = 128
#: Bytes of texts whose words are counted together.
SOME_LETTERS = 1 << 16
#: Examples whose terms are united in one step.
SOME_POINTS = 1000
#: Bytes of the beginnings of longer words.
BEGINNINGS = range(3, 8)
#: ASCII letters and digits lower-cased, other ASCII to blanks, other bytes as they are.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned. A null doc_id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of ``documents`` (doc_id, text).

    ``evidence`` lists the nearest examples (doc_id, cosine). Texts are scored whole, however
    long. Empty and null texts, and those that share no word with an example, get the score of
    the examples' share of toxic ones. Of contradicting labels of one doc_id the toxic one
    counts, labels other than 0 and 1 and null ids are passed over; of rows that repeat a
    doc_id, the least text is the example; equal cosines are ordered by place in the index.
    Without examples all scores are 0. Other columns are not read, whatever their names.
    """
    documents = only(documents, "doc_id", "text")
    shared, calibration = _shared(documents, labels, examples)

    def score(batches):
        scorer = _Scorer(*shared.value, calibration)
        for batch in batches:
            found = scorer.of(batch["text"])
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "score": pa.array([s for s, _ in found], pa.float64()),
                "evidence": pa.array(
                    [[{"doc_id": d, "cosine": c} for d, c in near] for _, near in found],
                    pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])),
                ),
            }

    texts = documents.select("doc_id", as_bytes("text").alias("text"))
    out = map_batches(texts, score, "doc_id bigint, score double, evidence array<struct<doc_id:bigint,cosine:double>>")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select("doc_id", held_out().alias("held_out"), "score", predicted, "evidence")


def accepted(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """The rows of ``documents`` that are not scored as toxic, all columns kept."""
    shared, calibration = _shared(only(documents, "doc_id", "text"), labels, examples)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        scorer = _Scorer(*shared.value, calibration)
        return pd.Series([score for score, _ in scorer.of(list(texts))], dtype="float64")

    return documents.filter(score(as_bytes(documents["text"])) < 0.5)


class _Counts(NamedTuple):
    """The distinct words of a text and distinct beginnings, with how often they occur.

    Both are hashes, even for words and odd for beginnings. ``heads`` are the shortest
    beginnings of the beginnings.
    """

    words: np.ndarray
    often: np.ndarray
    beginnings: np.ndarray
    begun: np.ndarray
    heads: np.ndarray


def _counts(text: bytes | None, powers: Powers, heads: np.ndarray | None = None) -> _Counts:
    """With sorted ``heads``, beginnings of words that begin with one of them alone."""
    none = np.empty(0, np.int64)
    letters = np.frombuffer((text or b"").translate(FOLD), np.uint8)
    blank = np.concatenate([[True], letters == 32, [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    if not len(edges):
        return _Counts(none, none, none, none, none)
    first, end = edges[::2], edges[1::2]
    sums = powers.sums(BYTES[letters])
    hashes = powers.between(sums, first, end).view(np.int64) & ~1
    words, at, counts = np.unique(hashes, return_index=True, return_counts=True)
    longer = end[at] - first[at] > BEGINNINGS[0]
    first, size, often = first[at][longer], (end - first)[at][longer], counts[longer]
    head = powers.between(sums, first, first + BEGINNINGS[0]).view(np.int64) | 1
    if heads is not None:
        own = heads[np.minimum(np.searchsorted(heads, head), len(heads) - 1)] == head if len(heads) else head != head
        first, size, often, head = first[own], size[own], often[own], head[own]
    if not len(first):
        return _Counts(words, counts, none, none, none)
    begun = [(head, often, head)]
    for n in BEGINNINGS[1:]:
        own = size > n
        begun.append((powers.between(sums, first[own], first[own] + n).view(np.int64) | 1, often[own], head[own]))
    keys, often, head = (np.concatenate(column) for column in zip(*begun))
    keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return _Counts(words, counts, keys, np.bincount(which, often).astype(np.int64), head[at])


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where hashes stand in sorted ``keys``, -1 for those that do not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, -1)


class _Terms(NamedTuple):
    """The terms in order of their hashes, the heads of their beginnings, their emphasis and frequencies."""

    keys: np.ndarray
    heads: np.ndarray
    emphasis: np.ndarray
    idf: np.ndarray
    unseen: float

    def among(self, counts: _Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the terms of a text, how often they occur, how often its other words do)."""
        keys = np.concatenate([counts.words, counts.beginnings])
        often = np.concatenate([counts.often, counts.begun])
        number = self.numbers(keys)
        known = number >= 0
        order = np.argsort(number[known], kind="stable")
        return number[known][order], often[known][order], counts.often[~known[: len(counts.words)]]

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of these hashes, -1 for what is no term."""
        return _places(self.keys, keys)

    def vector(self, number: np.ndarray, often: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Weights of terms, as parts of a unit vector to which a text's other words belong too."""
        weights = (1 + np.log(often)) * self.idf[number] * self.emphasis[number]
        rest = (1 + np.log(others)) * self.unseen
        return weights / np.sqrt(max(weights @ weights + rest @ rest, 1e-300))


class _Words:
    """The terms of texts, many texts at once; the same as ``_Terms.among`` gives for each."""

    def __init__(self, terms: _Terms) -> None:
        self.terms, self.powers = terms, Powers()
        #: The numbers of the terms that are beginnings.
        self.begun = np.flatnonzero(terms.keys & 1)
        self.beginnings = terms.keys[self.begun]

    def of(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (numbers of its terms, how often they occur, how often its other words do)."""
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text or b"") > SOME_LETTERS:
                out += self._of_some(some)
                some, size = [], 0
            some.append((text or b"").translate(FOLD))
            size += len(some[-1])
        return out + self._of_some(some)

    def _of_some(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        letters = np.frombuffer(b" ".join(texts), np.uint8)
        blank = np.concatenate([[True], letters == 32, [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, end = edges[::2], edges[1::2]
        ends = np.cumsum([len(text) + 1 for text in texts])
        text = np.searchsorted(ends, first, side="right")
        sums = self.powers.sums(BYTES[letters])
        words, at, which = np.unique(
            self.powers.between(sums, first, end).view(np.int64) & ~1, return_index=True, return_inverse=True
        )
        numbers = self._numbers(words, sums, first[at], end[at])
        pairs, often = np.unique(text * len(words) + which, return_counts=True)
        text, which = np.divmod(pairs, max(len(words), 1))
        numbers = numbers[which]
        known = numbers >= 0
        # A beginning may be one of several words; the number of a text and of a term are one key.
        most = max(len(self.terms.keys), 1)
        keys, which = np.unique((text[:, None] * most + numbers)[known], return_inverse=True)
        counts = np.bincount(which, np.broadcast_to(often[:, None], known.shape)[known], len(keys)).astype(np.int64)
        text, others = text[~known[:, 0]], often[~known[:, 0]]
        each = np.arange(len(texts) + 1)
        stop, other = np.searchsorted(keys, each * most).tolist(), np.searchsorted(text, each).tolist()
        return [
            (keys[stop[i] : stop[i + 1]] - i * most, counts[stop[i] : stop[i + 1]], others[other[i] : other[i + 1]])
            for i in range(len(texts))
        ]

    def _numbers(self, words: np.ndarray, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row for each word: the number of its own term, then of its beginnings'; -1 for none."""
        out = np.full((len(words), 1 + len(BEGINNINGS)), -1)
        out[:, 0] = self.terms.numbers(words)
        if not len(self.begun):
            return out
        size = end - first
        own = np.flatnonzero(size > BEGINNINGS[0])
        own = own[_places(self.terms.heads, self._begun(sums, first[own], BEGINNINGS[0])) >= 0]
        for column, n in enumerate(BEGINNINGS, 1):
            own = own[size[own] > n]
            place = _places(self.beginnings, self._begun(sums, first[own], n))
            out[own, column] = np.where(place >= 0, self.begun[place], -1)
        return out

    def _begun(self, sums: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
        return self.powers.between(sums, first, first + size).view(np.int64) | 1


class _Scorer(Remembered):
    """The score of a text and its nearest examples; copies of a text are scored once."""

    def __init__(self, index: BlockMaxIndex | None, terms: _Terms, prior: float, calibration: tuple[float, float]) -> None:
        super().__init__(REMEMBERED_TEXTS)
        self.index, self.calibration, self.terms, self.prior = index, calibration, terms, prior
        self.words = _Words(terms)

    def of(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        if self.index is None:
            return [(0.0, [])] * len(texts)
        out = []
        for at in range(0, len(texts), TOGETHER):
            out += self._of_some(texts[at : at + TOGETHER])
        return out

    def _of_some(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        self.rest()
        keys = [xxhash.xxh3_128_digest(text or b"") for text in texts]
        new = {}
        for key, text in zip(keys, texts):
            if key not in self:
                if key in self.before:
                    self[key] = self.before[key]
                else:
                    new[key] = text
        near = self.index.nearest_of_all(self.vectors(list(new.values())), NEIGHBOURS, [-1] * len(new))
        for key, some in zip(new, near):
            score = _calibrated(self.index.share(some, NEIGHBOURS, self.prior), self.calibration)
            self[key] = score, [(self.index.names[place], cosine) for cosine, place in some[:3]]
        return [self[key] for key in keys]

    def vectors(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(own[0], self.terms.vector(*own)) for own in self.words.of(texts)]


def _calibrated(share: float, calibration: tuple[float, float]) -> float:
    slope, shift = calibration
    return float(1 / (1 + np.exp(-(slope * _logit(share) + shift))))


def _logit(share):
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _examples(documents: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """(doc_id, text as bytes, toxic) of at most ``examples`` labelled documents, as a written table."""
    chosen = (
        only(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    )
    texts = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")
    )
    return written(texts, "examples").select("doc_id", as_bytes("text").alias("text"), "toxic")


def _fitted(documents: DataFrame, texts: DataFrame):
    """(index, terms, prior, place of each example by doc_id), bounded by the examples' texts."""
    marked = _marked(texts)
    positive, negative, doc_ids, vectors, counts = [], [], [], [], []
    points: dict[bytes, int] = {}
    for batch in _example_counts(texts, marked).toArrow().to_batches():  # one row per example at most
        for doc_id, toxic, *own in zip(*(batch[n].to_pylist() for n in ("doc_id", "toxic")), batch["terms"], batch["often"]):
            own = [value.as_buffer() for value in own]  # not copied
            point = points.setdefault(b"".join(map(xxhash.xxh3_128_digest, own)), len(points))
            if point == len(vectors):
                for column, new in zip((positive, negative, doc_ids, vectors, counts), (0, 0, [], *own)):
                    column.append(new)
            positive[point] += toxic
            negative[point] += 1 - toxic
            doc_ids[point].append(doc_id)
    keys = np.empty(0, np.int64)
    for at in range(0, len(vectors), SOME_POINTS):
        some = [np.frombuffer(terms, np.int64) for terms in vectors[at : at + SOME_POINTS]]
        keys = np.union1d(keys, np.concatenate(some))
    terms = _frequencies(documents, keys, *marked)
    if not points:
        return None, terms, 0.0, {}
    prior = sum(positive) / (sum(positive) + sum(negative))
    weighted = []
    for own, often in zip(vectors, counts):
        number = np.searchsorted(keys, np.frombuffer(own, np.int64)).astype(np.int32)
        weights = terms.vector(number, np.frombuffer(often, np.int32), number[:0])
        weighted.append((number, weights.astype(np.float32)))
    # What the driver has at a time is bounded by the examples too, and is let go as soon as it is used.
    del batch, own, often, some, vectors, counts
    pa.default_memory_pool().release_unused()
    index = BlockMaxIndex(weighted, positive, negative, [min(ids) for ids in doc_ids])
    place = {name: at for at, name in enumerate(index.names)}
    return index, terms, prior, {doc_id: place[min(ids)] for ids in doc_ids for doc_id in ids}


def _shared(documents: DataFrame, labels: DataFrame, examples: int):
    """What a scorer needs, sent to the tasks, and the calibration; bounded by the examples' texts."""
    texts = _examples(documents, labels, examples)
    index, terms, prior, places = _fitted(documents, texts)
    shared, found = documents.sparkSession.sparkContext.broadcast((index, terms, prior)), index is not None
    del index, terms
    return shared, _calibration(texts, shared, places) if found else (1.0, 0.0)


def _marked(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and beginnings that toxic examples have clearly more often, emphasis beyond 1, their heads."""

    def count(batches):
        powers = Powers()
        for batch in batches:
            keys, heads, labels = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts = _counts(text, powers)
                keys += [counts.words, counts.beginnings]
                heads += [np.zeros(len(counts.words), np.int64), counts.heads]
                labels.append(np.full(len(counts.words) + len(counts.beginnings), toxic))
            names, at, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            toxic = np.bincount(which, np.concatenate(labels), len(names)).astype(np.int64)
            clean = np.bincount(which, minlength=len(names)) - toxic
            yield {"term": names, "head": np.concatenate(heads)[at], "toxic": toxic, "clean": clean}

    sizes = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    found = map_batches(texts.select("text", "toxic"), count, "term bigint, head bigint, toxic bigint, clean bigint")
    found = found.groupBy("term").agg(
        F.min("head").alias("head"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (yes + 1.0 - a + 0.5)) - F.log(b / (no + 1.0 - b + 0.5))
    beyond = (odds / F.sqrt(1 / a + 1 / b) - CLEARLY) * EMPHASIS
    strong = found.select("term", "head", beyond.alias("beyond")).filter("beyond > 0").toArrow().sort_by("term")
    heads = np.unique(strong["head"].to_numpy())
    return strong["term"].to_numpy(), strong["beyond"].to_numpy(), heads[heads != 0]


def _example_counts(texts: DataFrame, marked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, toxic, terms, often): each example's words and marked beginnings, as arrays of numbers."""
    strong, _, heads = marked

    def rows(batches):
        powers = Powers()
        for batch in batches:
            terms, often = [], []
            for text in batch["text"]:
                counts = _counts(text, powers, heads)
                known = _places(strong, counts.beginnings) >= 0
                own = np.concatenate([counts.words, counts.beginnings[known]])
                order = np.argsort(own)
                terms.append(own[order].tobytes())
                often.append(np.concatenate([counts.often, counts.begun[known]])[order].astype(np.int32).tobytes())
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "toxic": pa.array(batch["toxic"], pa.int32()),
                "terms": pa.array(terms, pa.binary()),
                "often": pa.array(often, pa.binary()),
            }

    return map_batches(texts, rows, "doc_id bigint, toxic int, terms binary, often binary")


def _frequencies(documents: DataFrame, keys: np.ndarray, marked: np.ndarray, beyond: np.ndarray, heads: np.ndarray) -> _Terms:
    """The terms with their emphasis and inverse document frequencies over all documents."""
    emphasis = 1.0 - (keys & 1)  # beginnings have the part above 1 alone
    at = np.searchsorted(keys, marked)  # a marked term stands in an example, so it is a key
    emphasis[at] += beyond
    plain = _Terms(keys, heads, emphasis, np.ones(0), 0.0)
    shared = documents.sparkSession.sparkContext.broadcast(plain)

    def count(batches):
        words = _Words(shared.value)
        seen, total = np.zeros(len(words.terms.keys), np.int64), 0
        for batch in batches:
            for at in range(0, len(batch["text"]), TOGETHER):
                for number, _, _ in words.of(batch["text"][at : at + TOGETHER]):
                    seen[number] += 1
            total += len(batch["text"])
        some = np.flatnonzero(seen)
        yield {"term": np.append(some, -1), "n": np.append(seen[some], total)}

    found = map_batches(documents.select(as_bytes("text").alias("text")), count, "term bigint, n bigint")
    found = found.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row per term at most
    shared.unpersist()
    number, n = found["term"].to_numpy(), found["n"].to_numpy()
    total, often = int(n[number < 0].sum()), np.zeros(len(keys))
    often[number[number >= 0]] = n[number >= 0]
    return plain._replace(idf=np.log((1 + total) / (1 + often)) + 1, unseen=float(np.log((1 + total) / 2) + 1))


def _calibration(texts: DataFrame, shared, places: dict[int, int]) -> tuple[float, float]:
    """Slope and shift of a logistic map from votes to probabilities, each example left out once."""

    def votes(batches):
        index, terms, prior = shared.value
        scorer = _Scorer(index, terms, prior, (1.0, 0.0))
        for batch in batches:
            shares = []
            for at in range(0, len(batch["text"]), TOGETHER):
                own = [places[doc_id] for doc_id in batch["doc_id"][at : at + TOGETHER]]
                near = index.nearest_of_all(scorer.vectors(batch["text"][at : at + TOGETHER]), NEIGHBOURS, own)
                for some, place, toxic in zip(near, own, batch["toxic"][at : at + TOGETHER]):
                    shares.append(index.share(some, NEIGHBOURS, prior, place, toxic))
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "share": pa.array(shares, pa.float64()),
                "label": pa.array(batch["toxic"], pa.int32()),
            }

    left_out = map_batches(texts, votes, "doc_id bigint, share double, label int").toArrow()
    left_out = left_out.sort_by("doc_id")  # one row per example at most
    x, y = _logit(left_out["share"].to_numpy()), left_out["label"].to_numpy().astype(float)
    design, fit = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ fit))
        # A weak pull towards the identity keeps separable examples finite.
        gradient = design.T @ (y - p) - 0.5 * (fit - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        fit = fit + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(fit[0]), float(fit[1])
