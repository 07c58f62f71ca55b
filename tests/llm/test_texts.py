import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import cutting_stock, license_scan, packing, piece_codec, quality_rules
from tests.llm.conftest import prose

TEXTS = [
    None, "", " ", "word", "The Cat, the cat. it's 12.5!", "Ünïcode ΣΑΣ é İ x.,, <|endoftext|>end é 漢字 ▁ ▁▁a\x00b",
    "  two  blanks\n\n\ttab ", "💀 emoji\r\n", "x" * 300, "Under the MIT license. UNDER THE MIT-LICENSE, cc by nc cc by nc by nc",
    "Apache License, Version 2.0; gnu general public license", "a b c " * 30 + "\nline\nline\n \nline", " ".join(prose(1, 6000)),
]
ROWS = list(enumerate(TEXTS)) + [(3, "word"), (None, "no id")]


def same(found, expected):
    order = lambda rows: sorted(rows, key=lambda row: tuple((v is None, v) for v in row))
    assert order(found) == order(expected)


def test_licences_equal_brute_force(docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

    def brute(doc_id, text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        return doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), labels

    found = license_scan.scanned(docs(ROWS))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    same([tuple(r) for r in found.select(names).collect()], [brute(*row) for row in ROWS])
    scores = {r.doc_id: (r.labels, r.score) for r in found.collect()}
    assert scores[9] == ("cc-by-nc,mit", 1.0) and scores[0] == ("", 0.0) and "gpl" in scores[10][0]
    assert license_scan.scanned(docs([])).count() == 0


def test_pieces_hold_every_id_once(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.packed(docs(ROWS), with_ids=True).toPandas()
    ids = {}
    for doc_id, text in ROWS:
        ids.setdefault(doc_id, tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END])
    for row in rows.itertuples():
        doc_id = None if np.isnan(row.doc_id) else int(row.doc_id)
        wanted = np.array(ids[doc_id][row.start : row.start + row.length], "<u4").tobytes()
        assert row.ids == wanted and row.ids_crc32 == zlib.crc32(wanted) and row.doc_tokens == len(ids[doc_id])
    assert rows.length.sum() == sum(len(ids[doc_id]) for doc_id, _ in ROWS)
    for _, some in rows.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert (some.offset == some.length.cumsum() - some.length).all() and some.length.sum() <= packing.LENGTH
    assert packing.packed(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_in_little_room(seed):
    draw = np.random.default_rng(seed)
    demand = draw.integers(0, [3, 50, 1000, 2][seed], len(packing.CLASSES))
    patterns = cutting_stock.plan(packing.CLASSES, demand, packing.LENGTH)
    assert (sum((held * count for held, count in patterns), np.zeros_like(demand)) == demand).all()
    assert all(held @ packing.CLASSES <= packing.LENGTH for held, _ in patterns)
    least = (demand * packing.CLASSES).sum() / packing.LENGTH
    assert sum(count for _, count in patterns) <= 1.01 * least + 3


@pytest.mark.parametrize("longest, seed", [(3, 1), (30, 2), (200, 3), (1, 4)])
def test_short_texts_fill_their_sequences(docs, longest, seed):
    draw = random.Random(seed)
    texts = [" ".join(prose(n, draw.randint(1, longest))) for n in range(1500)]
    rows = packing.packed(docs(list(enumerate(texts)))).toPandas()
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= packing.LENGTH and len(rows) == len(texts)
    assert len(used) <= 1.05 * used.sum() / packing.LENGTH + 1
    for _, some in rows.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert (some.offset == some.length.cumsum() - some.length).all()


@pytest.mark.parametrize("seed", range(5))
def test_bundles_hold_each_piece_once_in_little_room(seed):
    number = np.random.default_rng(seed).integers(0, [2, 40, 1000, 3, 7][seed], len(packing.SIZES))
    bundles, demand = packing._bundles(number)
    rests = number - bundles.held * bundles.full
    assert (rests >= 0).all() and (rests < np.maximum(bundles.held, 1)).all()
    room = packing.SIZES * bundles.held <= np.maximum(packing.BUNDLE, packing.SIZES)
    assert room.all() and demand.sum() == bundles.full.sum() + (rests > 0).sum()
    assert (packing.CLASSES[bundles.size] >= packing.SIZES * bundles.held)[bundles.full > 0].all()
    assert (packing.CLASSES[bundles.rest_size] >= packing.SIZES * rests)[rests > 0].all()
    taken = list(zip(bundles.size[bundles.full > 0], bundles.first[bundles.full > 0], bundles.full[bundles.full > 0]))
    taken += [(size, first, 1) for size, first in zip(bundles.rest_size[rests > 0], bundles.rest_first[rests > 0])]
    ranks = sorted((size, rank) for size, first, count in taken for rank in range(first, first + count))
    assert ranks == [(size, rank) for size in range(len(demand)) for rank in range(demand[size])]


def test_segmentations_vary_and_decode(docs, spark):
    encoded = piece_codec.segmented(docs(ROWS), with_ids=True)
    assert all(r.lossless for r in encoded.collect())
    back = {r.doc_id: r.text for r in piece_codec.decoded(encoded).collect()}
    assert all(back[doc_id] == (text or "") for doc_id, text in ROWS)
    text = " ".join(prose(2, 300))
    some = piece_codec.segmented(docs([(n, text) for n in range(20)])).collect()
    assert len({r.ids_crc32 for r in some}) == len({r.variant for r in some}) > 1
    assert some == piece_codec.segmented(docs([(n, text) for n in range(20)])).collect()


def test_without_dropout_the_model_segments():
    import sentencepiece

    path = piece_codec.model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = piece_codec.Segmenter(piece_codec.Pieces(path), 1, 0.0, 0)
    varied = piece_codec.Segmenter(piece_codec.Pieces(path), 1, 0.3, 0)
    draw = random.Random(1)
    for text in [t for t in TEXTS if t and "▁" not in t and "\x00" not in t]:
        assert np.frombuffer(plain.encoded(text), "<u4").tolist() == model.encode(text)
    for _ in range(200):
        word = ["▁"] + [draw.choice("abetionsr") for _ in range(draw.randrange(1, 40))]
        assert varied._merged(word[:], 5) == varied._merged_long(word[:], 5)


def test_every_occurrence_of_a_word_is_drawn_on_its_own(docs):
    pieces = piece_codec.Pieces(piece_codec.model_path())
    words = ["unbelievable"] * 300
    segmenter = piece_codec.Segmenter(pieces, 6, 0.1, 3)
    seen = set()
    for document in range(40):
        segmenter.document = document
        ids = segmenter.encoded(" ".join(words))
        drawn = segmenter._occurrences(len(words)).tolist()
        alone = [segmenter._ids(segmenter._merged_long(list("▁unbelievable"), word)) for word in drawn]
        assert ids == b"".join(alone)  # the remembered turns are those of merging
        seen.update(alone)
        if not document:
            assert len(seen) > 8  # inside one text
    assert len(seen) > 30
    plain = piece_codec.Segmenter(pieces, 6, 0.0).encoded("unbelievable")
    share = sum(a != plain for a in alone) / len(alone)
    assert 0.1 < share < 0.9
    found = piece_codec.segmented(docs([(n, " ".join(words)) for n in range(40)])).collect()
    assert len({r.ids_crc32 for r in found}) == 40 and all(r.lossless for r in found)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_words_of_many_texts_are_merged_together(rate, monkeypatch):
    pieces = piece_codec.Pieces(piece_codec.model_path())
    draw = random.Random(2)
    made = [" ".join("".join(draw.choices("abetionsré▁漢\U0010ffff", k=draw.randrange(1, 60))) for _ in range(30)) for _ in range(20)]
    texts = [text or "" for text in TEXTS] + made + [made[0] + "\n" + made[1], made[0]]
    documents = [*range(len(texts) - 1), 13]
    segmenter, steps = piece_codec.Segmenter(pieces, 6, rate), []
    wanted = []
    for text, segmenter.document in zip(texts, documents):
        words = piece_codec.WORD.findall(" " + text) if text else []
        symbols = [list(word.replace("▁", piece_codec.HIDDEN).replace(" ", "▁")) for word in words]
        drawn = segmenter._occurrences(len(words)).tolist()
        wanted.append(b"".join(segmenter._ids(segmenter._merged_long(own, word)) for own, word in zip(symbols, drawn)))
    for most, turns in ((piece_codec.MERGED, piece_codec.TURNS), (7, 100)):
        monkeypatch.setattr(piece_codec, "MERGED", most)
        monkeypatch.setattr(piece_codec, "TURNS", turns)
        segmenter = piece_codec.Segmenter(pieces, 6, rate)
        merged = segmenter._merged_together
        segmenter._merged_together = lambda *own, run=merged: (steps.append(len(own[0])), run(*own))[1]
        for _ in range(3):
            found = segmenter.encoded_all(texts, documents)
            assert [ids.tobytes() for ids in found] == wanted
            assert piece_codec._back(pieces, found) == [text.encode() for text in texts]
    assert max(steps) > 1000  # not word by word
    assert segmenter.encoded_all([], []) == [] and segmenter.encoded("") == b""


def test_measures_equal_brute_force(docs):
    blanks = re.compile(r"[^\x20\x09-\x0D]+")

    def brute(doc_id, text):
        text = text or ""
        words = blanks.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {i + k for i, gram in enumerate(grams) if grams.count(gram) > 1 for k in range(3)} if len(words) < 500 else set()
        lines = [line for line in text.split("\n") if blanks.search(line)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        failed = len(words) < 50 or 100 * len(twice) > 50 * len(words)
        return doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(twice), failed

    rows = ROWS + [(50, "a a a a a a"), (51, "# " * 80), (52, " ".join(prose(3))), (53, " ".join(prose(3)).upper())]
    found = [tuple(r) for r in quality_rules.judged(docs(rows)).collect()]
    same([row[:7] for row in found], [brute(*row) for row in rows])
    kept = {row[0]: row[7] for row in found}
    assert kept[52] and not kept[51] and not kept[0]
    assert quality_rules.judged(docs([])).count() == 0


def test_rules_are_ordered_by_rejection_for_cost(docs):
    rules = [quality_rules.Rule("none", F.lit(False)), quality_rules.Rule("all", F.lit(True))]
    ordered = quality_rules.estimates(docs([(n, "x") for n in range(200)]), rules)
    assert [e.rule.name for e in ordered] == ["all", "none"]
    first = quality_rules.cascade([e.rule for e in ordered])
    assert docs([(1, "x")]).select(first.alias("r")).first().r == "all"
