import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from parley.llm import near_dedup, substring_dedup
from parley.llm.common import Powers, word_hashes
from tests.llm.conftest import prose

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = BLANKS.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=85):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i), None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def changed(words, places):
    return " ".join("new%d" % p if p in places else w for p, w in enumerate(words))


ROWS = (
    [(n, changed(prose(1), {(7 * n + 13 * k) % 120 for k in range(n % 4)})) for n in range(40)]
    + [(100 + n, changed(prose(2), {n, n + 1})) for n in range(12)]
    + [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO"), (205, "É é"), (206, "é é")]
    + [(210, " ".join(prose(3, 5000))), (211, " ".join(prose(3, 5000)) + " more"), (212, "x " * 300), (213, "x " * 90)]
    + [(None, " ".join(prose(4))), (300, " ".join(prose(4))), (301, " ".join(prose(5))), (301, " ".join(prose(5)))]
    + [(302, " ".join(prose(5))), (None, " ".join(prose(6)))]
)


def key(row):
    return tuple((value is None, value) for value in row)


def test_links_equal_brute_force(docs):
    found = near_dedup.linked(docs(ROWS)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=key) == sorted(brute_components(ROWS), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_blocks_and_hot_buckets_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = [(n, changed(prose(1), {(7 * n + 31 * k) % 120 for k in range(n % 6)})) for n in range(90)]
    found = near_dedup.linked(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(rows))


def test_one_document_of_a_group_stays(docs):
    frame = docs(ROWS)
    kept = near_dedup.deduplicated(frame)
    assert kept.columns == frame.columns
    expected = {d for d, _, c in brute_components(ROWS) if d is None or d == c}
    assert {r.doc_id for r in kept.collect()} == expected


def test_the_stage_links_pairs_from_80_percent_on(spark, docs):
    # Of 196 shingles four changed words replace 20, so 176 of 216 are common; five leave 171 of 221.
    rows = [(10 * n + k, changed(prose(60 + n, 200), set(range(20, 20 + 30 * k, 30)))) for n in range(12) for k in (0, 4)]
    similar = [len(a & b) / len(a | b) for a, b in ((shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, 24, 2))]
    assert all(0.80 <= s < 0.85 for s in similar)
    rows += [(500, changed(prose(90, 200), set())), (501, changed(prose(90, 200), set(range(20, 170, 30))))]  # 0.77
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs(rows), "").collect()) == [
        *range(0, 120, 10), 500, 501
    ]
    assert near_dedup.deduplicated(docs(rows)).count() == len(rows)
    assert (1 - 0.8**near_dedup.STAGE_ROWS) ** near_dedup.STAGE_BANDS < 1e-6


def test_repeated_rows_are_kept_once_through_the_next_stage(docs):
    one, other, third, near = (" ".join(prose(seed, 60)) for seed in (70, 71, 72, 73))
    rows = [(1, one), (1, one), (1, one), (None, other), (None, other), (None, third), (9, third), (8, third), (8, third)]
    rows += [(20, near), (20, near + " more"), (None, near), (30, None), (30, None), (None, ""), (None, "")]
    kept = near_dedup.deduplicated(docs(rows))
    expected = [(1, one), (None, other), (8, third), (30, None), (30, None), (None, ""), (None, "")]
    left = [(r.doc_id, r.text) for r in substring_dedup.without_repeats(kept).collect()]
    rest = [row for row in left if row[0] != 20]
    assert sorted(rest, key=lambda r: key((r[0], r[1]))) == sorted(expected, key=lambda r: key((r[0], r[1])))
    assert [text in (near, near + " more") for doc_id, text in left if doc_id == 20] == [True]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a")]])
def test_tiny_tables(docs, rows):
    assert near_dedup.linked(docs(rows)).count() == len(rows)
    assert near_dedup.deduplicated(docs(rows)).count() == len(rows)
    assert substring_dedup.repeated_words_removed(docs(rows)).count() == len(rows)
    assert substring_dedup.without_repeats(docs(rows)).count() == len(rows)


def brute_removed(rows, size=35):
    words = [BLANKS.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


PASSAGE = prose(9, 60)
REPEATS = (
    [(n, " ".join(prose(50 + n, 30 + n) + PASSAGE[n % 5 : 60 - n % 7] + prose(80 + n, 20))) for n in range(15)]
    + [(20, "a " * 50), (21, "a b " * 40), (22, " ".join(PASSAGE[:34])), (23, " ".join(PASSAGE[:35])), (24, "b " * 36)]
    + [(25, " ".join(["x"] * 40 + ["y"] * 40 + ["z"] * 40)), (26, None), (27, ""), (28, "\n\t "), (None, " ".join(PASSAGE))]
    + [(29, " ".join(prose(30, 4000))), (30, " ".join(prose(31, 50) + prose(30, 4000)[1000:1100])), (31, " ".join(prose(40)))]
    + [(31, " ".join(prose(40))), (32, " ".join(prose(41)) + " é\u00a0é"), (33, " ".join(prose(41, 80) + ["other"] + prose(42)))]
)


def test_removed_words_equal_brute_force(docs):
    found = substring_dedup.repeated_words_removed(docs(REPEATS)).collect()
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert sorted(rows, key=key) == sorted(brute_removed(REPEATS), key=key)


def test_marks_of_repeated_rows_do_not_multiply(docs):
    text = " ".join(prose(1, 80))
    repeated = [(None, text)] * 200 + [(7, text)] * 20
    for row in substring_dedup._marks(substring_dedup._keyed(docs(repeated))).collect():
        assert len(row.starts) == len(set(row.starts)) <= 46
    found = substring_dedup.repeated_words_removed(docs(repeated)).collect()
    assert len(found) == 220 and all(r.n_words == r.n_removed == 80 for r in found)


def test_periodic_texts_have_a_row_for_each_distinct_path(docs):
    """A path that a text repeats is one row with all its places, and all of them are marked."""
    line = prose(60, 50)
    rows = [(n, "x " * (300 + n)) for n in range(30)] + [(50, " ".join(prose(61, 40)) + " x" * 90)]
    rows += [(51, "x " * 60 + " ".join(prose(62, 40)) + " x" * 60), (52, "a b c " * 200), (53, "q " * 35), (54, "q " * 34 + "z")]
    rows += [(55, " ".join(w for n in range(20) for w in [*line, *prose(100 + n, 3 + n)]))]
    keyed = substring_dedup._keyed(docs(rows))
    assert substring_dedup._paths(keyed).filter("key < 30").count() == 30
    assert substring_dedup._marks(keyed).filter("key < 30").selectExpr("max(size(starts)) AS n").first().n == 1
    found = substring_dedup.repeated_words_removed(docs(rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]) == sorted(brute_removed(rows))
    cut = substring_dedup.without_repeats(docs(rows)).collect()
    assert {r.doc_id: len(r.text.split()) for r in cut} == {r.doc_id: r.n_words - r.n_removed for r in found}


def test_the_stage_cuts_texts_and_keeps_columns(docs):
    frame = docs(REPEATS)
    cut = substring_dedup.without_repeats(frame)
    assert cut.columns == frame.columns
    expected = {d: (n, gone, sha) for d, n, gone, sha in brute_removed(REPEATS)}
    for row in cut.filter("doc_id is not null").collect():
        _, gone, sha = expected[row.doc_id]
        if gone:
            assert hashlib.sha256(row.text.encode()).hexdigest() == sha and row.n_chars == len(row.text)
        else:
            assert (row.doc_id, row.text) in REPEATS


def test_word_hashes_tell_words_apart():
    powers = Powers()
    for text in ["", " ", "a", "ab ba  ab\tc\n", "é\u00a0é é", "x" * 100 + " " + "x" * 99 + "y", "\x1c a\x1cb"]:
        words = BLANKS.findall(text)
        hashes = word_hashes(text.encode(), powers).tolist()
        assert len(hashes) == len(words)
        assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
