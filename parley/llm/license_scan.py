"""Licence scans by a positional index of rare words.

A licence is a set of phrases, some of them mandatory. The index knows each phrase's words by
offset. Document frequencies of the phrases' words are counted over all documents; the two
words of a phrase with the highest IDF are its anchors. In a file, an anchor's places give
possible starts of the phrase; starts that both anchors agree on are intersected, and the
phrase is verified word by word there. As every place of a phrase holds its anchors, none is
missed, however common the phrase is.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import as_bytes, map_batches


class Licence(NamedTuple):
    label: str
    mandatory: tuple[str, ...]
    others: tuple[str, ...] = ()
    base: bool = False


# The base phrases and their labels.
BASE = (
    Licence("mit", ("under the mit license",), base=True),
    Licence("apache-2", ("apache license version 2",), base=True),
    Licence("cc-by-nc", ("cc by nc",), base=True),
)

# Phrases of public licence notices, as words in lower case.
NOTICES = (
    Licence("agpl", ("gnu affero general public license",)),
    Licence(
        "apache-2-text",
        ("licensed under the apache license",),
        ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Licence(
        "bsd",
        ("redistribution and use in source and binary forms", "with or without modification"),
        ("redistributions of source code must retain the above copyright notice",),
    ),
    Licence("cc-by", ("creative commons attribution",), ("4 0 international",)),
    Licence("cc-by-sa", ("cc by sa",)),
    Licence("cc0", ("cc0 1 0",), ("public domain dedication",)),
    Licence("gpl", ("gnu general public license",), ("free software foundation", "without any warranty")),
    Licence("isc", ("permission to use copy modify and or distribute this software",), ("the software is provided as is",)),
    Licence("lgpl", ("gnu lesser general public license",)),
    Licence(
        "mit-text",
        ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind"),
        ("the above copyright notice and this permission notice shall be included",),
    ),
    Licence("mpl-2", ("mozilla public license",), ("v 2 0",)),
    Licence("public-domain", ("released into the public domain",)),
    Licence("unlicense", ("this is free and unencumbered software released into the public domain",)),
)

#: A-Z lower-cased; words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after that, other ASCII becomes blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def scanned(documents: DataFrame, licences: tuple[Licence, ...] = BASE + NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    One row per row of ``documents`` (doc_id, text), also where rows repeat; null texts are
    empty. ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are
    their smallest and largest start (null without one). A licence is found if all its
    mandatory phrases stand somewhere; ``score`` is the largest share of a found licence's
    phrases that do, 0 without one. ``spans`` are the places (phrase, start) of all phrases
    found. Overlapping places all count.
    """
    phrases = sorted({phrase for licence in licences for phrase in licence.mandatory + licence.others})
    index = _Index(phrases, _frequencies(documents, {w for p in phrases for w in words_of(p.encode())}))
    base = {phrase for licence in licences if licence.base for phrase in licence.mandatory}

    def scan(batches):
        for batch in batches:
            rows = [_judged(words_of(text), index, licences, base) for text in batch["text"]]
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            made = {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}
            yield {"doc_id": pa.array(batch["doc_id"], pa.int64())} | made

    return map_batches(
        documents.select("doc_id", as_bytes("text").alias("text")),
        scan,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<phrase:string,start:bigint>>",
    )


SPANS = pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int64())]))


class _Index:
    """Postings of the phrases' anchors: word -> (phrase, offset), and the partner to agree with."""

    def __init__(self, phrases: list[str], frequency: dict[bytes, int]) -> None:
        self.phrases = phrases
        self.words = [words_of(phrase.encode()) for phrase in phrases]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.partner: list[tuple[int, bytes]] = []
        for number, words in enumerate(self.words):
            # Fewer documents is a higher IDF; ties go to the earlier word.
            order = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))
            rare, second = order[0], order[min(1, len(order) - 1)]
            self.postings.setdefault(words[rare], []).append((number, rare))
            self.partner.append((second, words[second]))

    def places(self, words: list[bytes]) -> dict[int, list[int]]:
        """Starts of every phrase that stands in a file."""
        postings, found = self.postings, {}
        for place, word in [(i, word) for i, word in enumerate(words) if word in postings]:
            for number, offset in postings[word]:
                start, phrase = place - offset, self.words[number]
                second, partner = self.partner[number]
                if start < 0 or start + len(phrase) > len(words) or words[start + second] != partner:
                    continue
                if words[start : start + len(phrase)] == phrase:
                    found.setdefault(number, []).append(start)
        return found


def _judged(words: list[bytes], index: _Index, licences, base: set[str]) -> tuple:
    found = {index.phrases[number]: starts for number, starts in index.places(words).items()}
    starts = [start for phrase in base for start in found.get(phrase, ())]
    labels, own, score = set(), set(), 0.0
    for licence in licences:
        if all(phrase in found for phrase in licence.mandatory):
            labels.add(licence.label)
            if licence.base:
                own.add(licence.label)
            phrases = licence.mandatory + licence.others
            score = max(score, sum(phrase in found for phrase in phrases) / len(phrases))
    spans = [{"phrase": p, "start": s} for p, places in sorted(found.items()) for s in places]
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *ends, ",".join(sorted(own)), ",".join(sorted(labels)), score, spans


def _frequencies(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the phrases occurs, over all of them."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(vocabulary.intersection(words_of(text)))
        yield {"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())}

    found = map_batches(documents.select(as_bytes("text").alias("text")), count, "word binary, n bigint")
    return {bytes(row["word"]): row["n"] for row in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
