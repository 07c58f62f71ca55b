import random

import pytest

from parley.llm import token_counts
from tests.llm.conftest import prose

# Alphabet of what may go wrong at a cut: contractions, marks behind blanks, signs, digits, special strings.
PARTS = ["a", "Zz", "'s", "'", "1", "22", " ", "  ", "\n", "\t", "́", "é", "漢字", "Σ", "İ", "<|endoftext|>", "<s>", "▁", "\x00", "💀", ".,", "-", " ", "word"]


def texts():
    draw = random.Random(4)
    made = ["".join(draw.choices(PARTS, k=draw.randrange(1, 60))) for _ in range(300)]
    return [None, "", " ", "word", "x" * 5000, "7" * 3000, "漢" * 3000, " ".join(prose(1, 30000)), *made]


def library(name):
    path = token_counts.tokenizer_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: len(whole.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library_on_whole_texts(docs, name):
    count = library(name)
    rows = [*enumerate(texts()), (3, "word"), (None, "no id")]
    clashing = docs(rows).selectExpr("*", "1 AS n_tokens", "text AS n_bytes", "true AS over_limit", "'t' AS texts")
    found = token_counts.counted(clashing, token_counts.tokenizer_path(name)).collect()
    order = lambda some: sorted(some, key=lambda row: (row[0] is None, row))
    wanted = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for i, t in rows]
    assert order(map(tuple, found)) == order(wanted)
    assert any(r.over_limit for r in found)
    assert token_counts.counted(docs([])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_of_a_text_add_up_wherever_it_is_cut(name):
    count = library(name)
    lengths, cut = token_counts._library(token_counts.tokenizer_path(name))
    for most in (1, 3, 10):
        for text in texts()[:4] + texts()[8:]:
            pieces = [p.decode() for p in token_counts.pieces_of((text or "").encode(), cut, most)]
            assert sum(lengths(pieces)) == count(text or ""), (most, text, pieces)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts._library("words.txt")


def test_a_word_goes_to_the_library_once(monkeypatch):
    seen = []
    learn = token_counts.WordIds._learn
    monkeypatch.setattr(token_counts.WordIds, "_learn", lambda self, new: (seen.extend(new), learn(self, new))[1])
    lengths, _ = token_counts._library(token_counts.tokenizer_path())
    count = library(token_counts.TOKENIZER)
    for _ in range(3):
        assert lengths(["Spark word 12", "word  Spark!"]) == [count("Spark word 12"), count("word  Spark!")]
    assert sorted(seen) == [b"12", b"Spark", b"Spark!", b"word"]
