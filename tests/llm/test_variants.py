import random
import re
import zlib
from collections import Counter

from parley.llm import spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    words = {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}
    out = {}
    for word, n in words.items():
        others = [o for o in words if near(word, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best and words[best] >= 10 * n else None
        out[word] = (form, n, len(others), words[form] if form else None)

    def root(word):
        return root(out[word][0]) if out[word][0] else word

    return sorted((w, form, root(w), n, k, m) for w, (form, n, k, m) in out.items())


def found(documents):
    rows = spelling_variants.grouped(documents).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows))


def texts():
    draw = random.Random(12)
    words = ["".join(draw.choices("abé", k=draw.randrange(6, 9))) for _ in range(250)]
    words += ["a" * k for k in range(6, 14)] + ["ÿ" * 7, "À" * 7, "ÿ" * 6 + "À", "b" * 3000, "b" * 2999, "b" * 1500 + "c" + "b" * 1499]
    rows = [(n, draw.choice([" ", "-", "1", "\n", "Ā"]).join(draw.choices(words, k=60))) for n in range(40)]
    rows += [(100 + n, f"{'Geheime ' * 10}{'geheimt ' * 2}{'gEheimtt '}" * 2 + "geheimes " * 300 + "geheimess " * 4000) for n in range(2)]
    return rows + [(None, "Geheimt geheimt"), (None, None), (7, ""), (7, "12 ..")] + rows[:2]


def test_variants_equal_brute_force(docs, monkeypatch):
    rows = texts()
    wanted = brute(rows)
    clashing = docs(rows).selectExpr("*", "'x' AS word", "2 AS n", "'x' AS target", "0 AS position", "'x' AS letter")
    assert found(clashing) == wanted
    forms = {row[0]: row[1:3] for row in wanted}
    assert any(form and root not in (word, form) for word, (form, root) in forms.items())
    monkeypatch.setattr(spelling_variants, "HELD", 5)
    assert found(docs(rows)) == wanted


def test_no_words_give_no_rows(docs):
    assert found(docs([])) == found(docs([(1, None), (2, "too few letters")])) == []


def test_edits_are_searched_along_paths_of_any_length(spark):
    words = ["a" * 40, "a" * 41, "a" * 39 + "b", "b" + "a" * 39, "xyzxyzxyz", "xyzxyzxy", "yzxyzxyz", "xyxyzxyz", "zzzzzzzz"]
    table = spark.createDataFrame([(n, word, 2) for n, word in enumerate(words)], "id bigint, word string, n bigint")
    pairs = {frozenset(r) for r in spelling_variants._near(table).collect()}
    assert pairs == {frozenset((a, b)) for a in words for b in words if near(a, b)}
