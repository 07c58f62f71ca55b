import numpy as np
import pytest

from parley.llm import collision_search, quality, toxicity, url_filter
from parley.llm.block_max import BlockMaxIndex
from tests.llm.conftest import prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus():
    rows, labels = [], []
    for n in range(240):
        words = prose(n, 60)
        toxic, bad = n % 6 == 0, n % 5 == 0
        if toxic:
            words[10:50:8] = ["scoundrel"] * 5
        text = " ".join(words)
        rows.append((n, " ".join(w + "###" for w in words) if bad else text))
        labels.append((n, int(not bad), int(toxic)))
    return rows, labels


def test_toxic_words_are_learned(spark, docs):
    rows, labels = corpus()
    frame = docs([*rows, (1000, None), (1001, ""), (None, "scoundrel " * 5 + " ".join(prose(9))), (0, rows[0][1])])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (7, 1, 5)], LABELS)
    found = toxicity.scored(frame, marks).collect()
    assert len(found) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert sum(by_id[n].predicted == t for n, _, t in labels) >= 236
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and by_id[None].predicted == 1 and not by_id[None].held_out
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    kept = toxicity.accepted(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in found)


def test_every_toxic_text_finds_its_copies(spark, docs):
    """Words that one example alone has are terms too, and names of columns do not matter."""
    rows = [(n, " ".join(prose(n, 60))) for n in range(300)]
    rows += [(n, " ".join(f"own{n}x{i}" for i in range(20))) for n in range(300, 306)]
    rows += [(n + 1000, text) for n, text in rows[300:]] + [(5000, "of no example at all, it ever")]
    frame = docs(rows).selectExpr("*", "0 AS toxic", "0.5D AS score", "'x' AS label", "1 AS evidence", "'y' AS term")
    marks = spark.createDataFrame([(n, 1, int(n >= 300)) for n, _ in rows[:306]], LABELS)
    found = {r.doc_id: r for r in toxicity.scored(frame, marks).collect()}
    learned = [n for n in range(300, 306) if not found[n].held_out]
    assert len(learned) >= 4
    for n in learned:
        for copy in (n, n + 1000):
            assert found[copy].predicted == 1 and found[copy].evidence[0].doc_id == n
            assert abs(found[copy].evidence[0].cosine - 1) < 1e-5
    assert not any(found[n].predicted for n in [*range(300), 5000])
    kept = toxicity.accepted(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in found.values())


def test_scores_equal_brute_force(spark, docs):
    """Neighbours and votes of every text by dense vectors over all words, without the index."""
    rows, labels = corpus()
    rows = rows + [(900, None), (901, "x " * 30_000 + "scoundrel"), (902, rows[1][1])]
    frame, marks = docs(rows), spark.createDataFrame(labels, LABELS)
    index, terms, prior, _ = toxicity._fitted(frame, toxicity._examples(frame, marks, toxicity.EXAMPLES))
    dense = np.zeros((index.size, len(terms.keys)))
    for place in range(index.size):
        ids, weights = index.point(place)
        dense[place, ids] = weights
    shares = {}
    for doc_id, text in rows:
        own = np.zeros(len(terms.keys))
        number, often, others = terms.among(toxicity._counts(text and text.encode(), toxicity.Powers()))
        own[number] = terms.vector(number, often, others)
        cosine, left, yes, all_, weight = dense @ own, toxicity.NEIGHBOURS, 0.0, 0.0, 1.0
        near = [p for p in np.lexsort((np.arange(index.size), -cosine)) if cosine[p] > 0]
        for p in near:
            if left > 0:
                used, weight = min(left, index.total[p]), 1 / (0.002 + max(0.0, 1 - cosine[p]))
                yes, all_, left = yes + weight * used * index.positive[p] / index.total[p], all_ + weight * used, left - used
        weight = min(weight, 1.0) if left > 0 else weight
        shares[doc_id] = (yes + weight * prior) / (all_ + weight), [cosine[p] for p in near[:3]]
    found = {r.doc_id: r for r in toxicity.scored(frame, marks).collect()}
    order = sorted(shares, key=lambda n: shares[n][0])
    scores = [found[n].score for n in order]
    assert np.all(np.diff(scores) > -1e-3)  # calibration keeps the order of the votes
    for doc_id, (_, cosines) in shares.items():
        assert np.allclose([e.cosine for e in found[doc_id].evidence], cosines, atol=1e-5)
    once = {w for w in " ".join(t or "" for _, t in rows).lower().split()}
    numbers = {}
    for word in sorted(w for w in once if w.isalnum()):
        number = terms.among(toxicity._counts(word.encode(), toxicity.Powers()))[0]
        numbers |= {word: n for n in number.tolist() if terms.keys[n] % 2 == 0}
    assert len(numbers) > 50
    texts = [set((t or "").lower().replace("###", "").split()) for _, t in rows]
    for word, number in list(numbers.items())[:50]:
        assert np.isclose(terms.idf[number], np.log((1 + len(rows)) / (1 + sum(word in t for t in texts))) + 1)


def test_thousands_of_examples_are_all_indexed(spark, docs):
    rows = [(n, f"w{n % 50} " + "scoundrel " * (n % 7 == 0)) for n in range(9000)]
    frame, marks = docs(rows), spark.createDataFrame([(n, 1, int(n % 7 == 0)) for n, _ in rows], LABELS)
    index, _, _, places = toxicity._fitted(frame, toxicity._examples(frame, marks, toxicity.EXAMPLES))
    learnable = marks.filter(~toxicity.held_out()).count()
    assert learnable > 7000 and index.total.sum() == learnable == len(places)


def test_bad_shapes_are_learned(spark, docs):
    rows, labels = corpus()
    frame = docs([*rows, (1000, None), (1001, ""), (None, "a")])
    marks = spark.createDataFrame(labels, LABELS)
    found = {r.doc_id: r for r in quality.scored(frame, marks).collect()}
    assert sum(found[n].kept == bool(q) for n, q, _ in labels) == 240
    kept = quality.accepted(frame, marks)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {n for n, r in found.items() if r.kept}


@pytest.mark.parametrize("rows", [[], [(1, "a b")]])
def test_without_labels(spark, docs, rows):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.scored(docs(rows), none).collect()] == [0.0] * len(rows)
    assert toxicity.accepted(docs(rows), none).count() == len(rows)
    assert all(r.kept for r in quality.scored(docs(rows), none).collect())
    assert quality.accepted(docs(rows), none).count() == len(rows)


def test_sparse_paths_shrink_to_their_host(spark):
    rows = [("a", "x", 0.9)] * 400 + [("a", "y", 0.1)] + [("b", "x", 0.2)] * 400 + [(None, None, 0.5)] * 3
    evidence = spark.createDataFrame([(0.0, h, p, g) for h, p, g in rows], "evidence double, host string, path string, good double")
    rates = {(r.group_host, r.group_path): r for r in quality._rates(evidence).collect()}
    assert len(rates) == 4 and rates["a", "x"].path_rate > 0.85 and rates["b", "x"].path_rate < 0.25
    assert rates["a", "y"].path_rate > 0.6  # one document says little against its host


def test_block_maxima_give_exact_neighbours():
    draw = np.random.default_rng(1)
    points = []
    for _ in range(1500):
        ids = np.append(0, np.sort(draw.choice(np.arange(1, 60), draw.integers(0, 6), replace=False)))
        weights = draw.random(len(ids)) + 0.1
        points.append((ids, weights / np.sqrt(weights @ weights)))
    index = BlockMaxIndex(points, [1] * 1500, [0] * 1500, list(range(1500)))
    dense = np.zeros((1500, 60))
    for place, row in enumerate(dense):
        ids, weights = index.point(place)
        row[ids] = weights
    for ids, weights in map(index.point, range(0, 1500, 150)):
        cosine = dense[:, ids] @ weights
        order = np.lexsort((np.arange(1500), -np.round(cosine, 12)))[:25]
        assert np.allclose(sorted(cosine[order]), sorted(c for c, _ in index.nearest(ids, weights, 25)))


def test_building_the_index_takes_few_bytes_a_posting():
    import tracemalloc

    draw = np.random.default_rng(4)
    points = [(np.sort(draw.choice(40_000, 300, replace=False)).astype(np.int32), np.ones(300, np.float32)) for _ in range(2000)]
    tracemalloc.start()
    index = BlockMaxIndex(points, [1] * 2000, [0] * 2000, list(range(2000)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.listed) == 600_000 and most < 32 * 600_000


def test_searching_together_finds_what_each_text_finds_alone():
    draw = np.random.default_rng(3)

    def vector(size):
        ids = np.sort(draw.choice(90, size, replace=False))
        weights = draw.random(size) + 0.1
        return ids, weights / np.sqrt(weights @ weights)

    points = [vector(draw.integers(1, 9)) for _ in range(900)]
    positive, negative = draw.integers(0, 3, 900), draw.integers(1, 3, 900)
    index = BlockMaxIndex(points, positive, negative, list(range(900)))
    dense = np.zeros((900, 90))
    for place in range(900):
        ids, weights = index.point(place)
        dense[place, ids] = weights
    queries = [vector(draw.integers(1, 30)) for _ in range(60)] + [points[5]] * 2 + [(np.empty(0, np.int64), np.empty(0))]
    skips = [-1] * 60 + [index.names.index(5), -1, -1]
    together = index.nearest_of_all(queries, 12, skips)
    assert together[-1] == []
    for (ids, weights), skip, near in zip(queries, skips, together):
        assert near == index.nearest(ids, weights, 12, skip)
        cosine = dense[:, ids] @ weights
        order = [i for i in np.lexsort((np.arange(900), -cosine)) if cosine[i] > 0]
        held = np.cumsum(index.total[order] - (np.array(order) == skip)) if order else []
        wanted = order[: int(np.searchsorted(held, 12)) + 1]
        assert np.allclose([c for c, _ in near], cosine[wanted], atol=1e-9)
        assert {place for _, place in near} == set(wanted)


def test_light_features_stand_with_their_points():
    """Searches add up few postings, and still find what a scan over all features finds."""
    draw = np.random.default_rng(6)

    def vector(weights):
        ids = np.concatenate([draw.choice(40, draw.integers(0, 4), replace=False), 40 + draw.choice(400, 60, replace=False)])
        weights = np.where(ids < 40, 30.0, draw.random(len(ids)) + 0.1) * weights
        return ids, weights / np.sqrt(weights @ weights)

    points = [vector(1.0) for _ in range(700)]
    positive = draw.integers(0, 3, 700)
    index = BlockMaxIndex(points, positive, [1] * 700, list(range(700)))
    assert len(index.listed) - len(index.places) == len(index.features) > 0.4 * len(index.listed)
    dense = np.zeros((700, 440))
    for name, (ids, weights) in enumerate(points):
        place = index.names.index(name)
        found, own = index.point(place)
        assert sorted(found) == sorted(ids)
        dense[place, found] = own
    queries = [vector(1.0) for _ in range(40)] + [(np.arange(40, 60), np.full(20, 0.2)), points[3], (np.arange(5, 9), np.full(4, 0.5))]
    for (ids, weights), near in zip(queries, index.nearest_of_all(queries, 7, [-1] * len(queries))):
        cosine = dense[:, ids] @ weights
        order = [i for i in np.lexsort((np.arange(700), -cosine)) if cosine[i] > 0]
        wanted = order[: int(np.searchsorted(np.cumsum(index.total[order]), 7)) + 1]
        assert np.allclose([c for c, _ in near], cosine[wanted], atol=1e-9) and {place for _, place in near} == set(wanted)


def test_an_index_of_few_points():
    points = [(np.array([0, n + 1]), np.array([0.6, 0.8])) for n in range(100)]
    index = BlockMaxIndex(points, [1] * 100, [0] * 100, list(range(100)))
    assert [(round(c, 5), index.names[place]) for c, place in index.nearest(*points[70], 1)] == [(1.0, 70)]


def test_words_of_many_texts_are_those_of_each(monkeypatch):
    texts = [" ".join(prose(n, 30)).encode() for n in range(40)] + [None, b"", b" ,", "Übel ünd Scoundrels, scoundrel".encode(), b"x" * 300 + b" of"]
    counts = [toxicity._counts(text, toxicity.Powers()) for text in texts]
    words = np.unique(np.concatenate([own.words for own in counts[::2]]))
    begun = np.unique(np.concatenate([own.beginnings for own in counts[::3]]))[::2]
    keys = np.sort(np.concatenate([words, begun]))
    heads = np.unique(np.concatenate([own.heads[np.isin(own.beginnings, begun)] for own in counts]))
    for some in (toxicity._Terms(keys, heads, np.ones(len(keys)), np.ones(len(keys)), 1.0), toxicity._Terms(keys[:0], heads[:0], np.ones(0), np.ones(0), 1.0)):
        for letters in (1, 500, 1 << 16):
            monkeypatch.setattr(toxicity, "SOME_LETTERS", letters)
            found = toxicity._Words(some).of(texts)
            assert len(found) == len(texts)
            for own, (number, often, others) in zip(counts, found):
                wanted = some.among(own)
                assert np.array_equal(number, wanted[0]) and np.array_equal(often, wanted[1])
                assert sorted(others) == sorted(wanted[2])


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_neighbours_recall_and_edges(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "ROW_BLOCK", 300)
    draw = np.random.default_rng(2)
    rows = [(n, draw.standard_normal(16).astype(np.float32).tolist(), 0) for n in range(1, 700)]
    rows += [(700, rows[4][1], 0), (800, [0.0] * 16, 0), (900, None, 0), (901, [float("nan")] * 16, 0), (902, [None] * 16, 0)]
    rows += [(903, [], 0), (None, [1.0] * 16, 0), (1000, [1.0, 2.0], 0), (1001, [1.0, 3.0], 0), (8, rows[7][1], 0)]
    found = {}
    for r in collision_search.neighbours(spark.createDataFrame(rows, VECTORS)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {100, 200, 300, 400, 500, 600, 700, 1000}
    assert sorted(found[1000]) == [(1, 1001, 1.0)]
    usable = [(i, np.array(v, float)) for i, v, _ in rows[:700]]
    hits = 0
    for query, vector in [u for u in usable if u[0] % 100 == 0]:
        exact = sorted((float(np.sqrt(((v - vector) ** 2).sum())), i) for i, v in usable if i != query)
        got = sorted(found[query])
        assert [rank for rank, _, _ in got] == list(range(1, 11)) and len({i for _, i, _ in got}) == 10
        assert all(np.isclose(score, dict((i, d) for d, i in exact)[i]) for _, i, score in got)
        hits += len({i for _, i in exact[:10]} & {i for _, i, _ in got})
    assert hits >= 0.9 * 70
    assert sorted(found[700])[0][1:] == (5, 0.0)
    assert collision_search.neighbours(spark.createDataFrame([], VECTORS)).count() == 0


PAGES = [
    (1, "http://a.example.net/en/1"), (2, "http://a.example.net/de/1"), (3, "https://B.Example.COM/de/x?q#f"), (4, "http://x.org/fr/"),
    (5, None), (6, "no host"), (7, "http://bad.example.org"), (8, "http://bad.example.org?x://y/fr/"), (9, "ftp://net/"), (9, "ftp://net/"),
    (None, "http://fine.example.org/a#b"), (11, "http://notnet/"), (12, "x\n://bad.example.org/p\nq"),
]


@pytest.mark.parametrize("largest", [url_filter.LARGEST, 0])
def test_urls(spark, monkeypatch, largest):
    monkeypatch.setattr(url_filter, "LARGEST", largest)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string")
    listed = spark.createDataFrame([("bad.example.org",), ("not.there",), (None,)], "key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, listed).collect()}
    assert found == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.example.net", "/de/1", "net/", "block"),
        3: ("b.example.com", "/de/x", "example.com/de/", "block"), 4: ("x.org", "/fr/", "org/fr/", "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.example.org", "", None, "block"),
        8: ("bad.example.org", "", None, "block"), 9: ("net", "/", "net/", "block"), None: ("fine.example.org", "/a", None, "allow"),
        11: ("notnet", "/", None, "allow"), 12: ("bad.example.org", "/p\nq", None, "block"),
    }
    assert url_filter.judged(pages, listed).count() == len(PAGES)
    assert url_filter.judged(pages.limit(0), listed).count() == 0


def test_the_cascade_is_exact(spark):
    keys = spark.range(30_000).selectExpr("concat('host', id) AS key")
    listed = keys.filter("xxhash64(key) % 3 = 0")
    cascade = url_filter.levels(keys, listed)
    assert len(cascade) > 1
    wrong = url_filter.members(keys, "key", cascade).filter("member <> (xxhash64(key) % 3 = 0)")
    assert wrong.count() == 0
