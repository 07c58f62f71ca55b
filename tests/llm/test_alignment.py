import hashlib
import random
from collections import Counter

import numpy as np

from parley.llm import alignment
from parley.llm.perfect_hash import PerfectHash
from tests.llm.conftest import prose

PARTS = ["a", "Zz", "'s", "it's", "1", "2024", " ", "  ", "\n", "\t", "́", "é", "漢字", "Σ", "<|endoftext|>", "<s>", "💀", ".,", "-", "word", "\x00", "ligne"]


def texts():
    draw = random.Random(11)
    made = ["".join(draw.choices(PARTS, k=draw.randrange(1, 50))) for _ in range(80)]
    return [None, "", " ", "word", "▁ is no blank", "a▁", "x" * 900, " " * 5000 + "x", " ".join(prose(1, 1200)), *made]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.tokenizer_path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.SECOND))


def brute(rows):
    first, model = libraries()
    letters = alignment._byte_letters()
    groups = []
    for _, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in a.ids]
        b = [(i, model.id_to_piece(i)) for i in model.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            groups.append([])
            continue
        ends = [np.cumsum([len(x) for _, x in some]).tolist() for some in (a, b)]
        shared, found = sorted(set(ends[0]) & set(ends[1])), []
        for low, high in zip([0, *shared], shared):
            found.append(tuple([i for (i, _), end in zip(some, at) if low < end <= high] for some, at in zip((a, b), ends)))
        groups.append(found)
    links = [Counter((x, y) for one, other in found for x in one for y in other) for found in groups]
    counts = Counter(pair for own in links for pair in own)
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, _), found, own in zip(rows, groups, links):
        shown = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in found)
        out.append((
            doc_id, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), sum(own.values()),
            sum(n for pair, n in own.items() if counts[pair] == highest[pair[0]]), sum(n * counts[pair] for pair, n in own.items()),
            hashlib.sha256(shown.encode()).hexdigest() if found else "",
        ))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda row: (row[0] is None, row))


def test_alignments_equal_brute_force(docs, monkeypatch):
    rows = [*enumerate(texts()), (3, "word"), (None, "no id"), (None, None)]
    wanted = order(brute(rows))
    clashing = docs(rows).selectExpr("*", "1 AS n_a", "'x' AS pairs", "2 AS part", "3 AS shard", "'y' AS groups_sha256")
    assert order(alignment.aligned(clashing.repartition(5)).collect()) == wanted
    # Deep trees, groups beyond what is expanded, runs that are handed on early, and the join.
    for name, value in (("FAN", 2), ("EXPANDED", 3), ("HELD", 100), ("BATCH", 500)):
        monkeypatch.setattr(alignment, name, value)
    assert order(alignment.aligned(docs(rows).repartition(5), most=-1).collect()) == wanted


def test_texts_are_encoded_once(docs):
    """What comes after the first pass, the result included, reads what it has written."""
    rows = [(n, f"word {n} of it") for n in range(4)] + [(9, "x" * 300 + " " + "ab" * 200)]
    for most in (alignment.MOST_BROADCAST, -1):
        found = alignment.aligned(docs(rows), most=most)
        assert found.inputFiles() and all("parley-aligned" in file or "parley-pair" in file for file in found.inputFiles())
        assert order(found.collect()) == order(brute(rows))


def test_no_tokens_give_zeros(docs):
    assert alignment.aligned(docs([])).count() == 0
    assert [tuple(r) for r in alignment.aligned(docs([(1, None), (2, "")])).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""),
        (2, 0, 0, 0, 0, 0, 0, ""),
    ]


def test_hashes_are_minimal_and_perfect():
    for size in (0, 1, 2, 63, 64, 65, 5000):
        numbers = np.unique(np.random.default_rng(size).integers(0, 1 << 60, size))
        found = PerfectHash.loaded(PerfectHash.of(numbers).dumped())
        assert sorted(found.index(numbers).tolist()) == list(range(len(numbers))) and found.size == len(numbers)
        found.index(np.arange(100))  # unknown numbers do no harm


def test_a_text_that_is_not_given_back_leaves_its_neighbours(monkeypatch):
    paths = alignment.tokenizer_path(alignment.FIRST), alignment.tokenizer_path(alignment.SECOND)
    tokenizers = alignment.Tokenizers(*paths)
    some = ["one word", "unbelievably odd", "it's 12.5 é漢", "x y"]
    alone = [tokenizers.of([text.encode()]) for text in some]
    model, size_b = tokenizers.model, len(tokenizers.bytes_b)

    class Wrong:
        def encode(self, text):
            return model.encode(text) if text != "bad" else model.encode("dab")

    tokenizers.model = Wrong()
    mixed = [b"bad", some[0].encode(), None, some[1].encode(), b"\xff", b"bad", some[2].encode(), b"", some[3].encode(), b"bad"]
    found = tokenizers.of(mixed)
    places = [1, 3, 6, 8]
    assert found.rows.tolist() == places and found.groups()[[0, 2, 4, 5, 7, 9]].sum() == 0
    assert found.groups()[places].tolist() == [own.groups()[0] for own in alone]
    names = alignment._written_ids(tokenizers)
    assert [found.written_groups(names)[place] for place in places] == [own.written_groups(names)[0] for own in alone]
    for most in (alignment.EXPANDED, 0):
        monkeypatch.setattr(alignment, "EXPANDED", most)
        text, pair, times = found.links(size_b)
        for place, own in zip(places, alone):
            assert pair[text == place].tolist() == own.links(size_b)[1].tolist()
            assert times[text == place].sum() == (own.held[0] * own.held[1]).sum()
        assert (np.diff(text) >= 0).all()
    nothing = tokenizers.of([b"bad", None])
    assert [len(column) for column in nothing.links(size_b)] == [0, 0, 0] and nothing.written_groups(names) == ["", ""]
