import random

import numpy as np

import corpus_pipeline
from textquarry.llm import neardups


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_components(rows):
    """The smallest id reachable, by comparing every pair."""
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(r) for r in root]


def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    out = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([12, 60, 200]))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + out[20:24]


def test_equals_brute_force(spark, monkeypatch):
    rows = [(None if i % 13 == 5 else 1000 - i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, n int")
    want = sorted(zip((str(d) for d, _ in rows), map(str, slow_components(rows))))
    for sizes in ({}, {"block": 3, "left": 2, "right": 3}):
        assert sorted((str(r.doc_id), str(r.component_id)) for r in neardups.near_duplicates(docs, **sizes).collect()) == want
    monkeypatch.setattr(neardups, "MOST_BROADCAST", 0)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in neardups.near_duplicates(docs).collect()) == want
    assert neardups.near_duplicates(docs.limit(0)).count() == 0


def varied(similarity, n, rng):
    """Two texts of about n shingles whose sets have about this similarity, by words that one of them has on top."""
    words = ["v%d" % rng.randrange(10**9) for _ in range(n)]
    extra = ["u%d" % rng.randrange(10**9) for _ in range(round(n / similarity) - n)]
    return " ".join(words), " ".join(words + extra)


def test_pairs_at_the_threshold_are_found(spark):
    rng, rows = random.Random(8), []
    for k in range(300):
        n = rng.choice([6, 12, 40, 300])
        for j, t in enumerate(varied(rng.choice([0.78, 0.8, 0.82, 0.9]), n, rng)):
            rows.append((2 * k + j, t))
    got = {r.doc_id: r.component_id for r in neardups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: sets_of(t) for d, t in rows}
    alike = [k for k in range(300) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    assert 100 < len(alike) < 300
    assert [k for k in range(300) if got[2 * k + 1] == 2 * k] == alike


def test_a_component_is_compared_again_where_its_edges_fail():
    # The nearest candidate pair of two parts need not be the one that links.
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, (1, neardups.SCREEN), np.int64).view(np.uint64).repeat(4, axis=0)
    words[1:, 0] ^= np.uint64(0b111)
    words[3, 1] ^= np.uint64((1 << 40) - 1)
    fp, n, home = np.array([5, 6, 7, 8]), np.full(4, 50), np.ones(4, bool)
    a, b = neardups.candidates_of(fp, n, words, home)
    assert set(zip(a.tolist(), b.tolist())) >= {(5, 6), (5, 7)} and 8 in {*a.tolist(), *b.tolist()}
    n[3] = 63
    assert 8 not in np.concatenate(neardups.candidates_of(fp, n, words, home))


def test_open_parts(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")
    roots = spark.createDataFrame([(2, 1), (1, 1), (9, 8), (8, 8)], "node long, root long")
    found = neardups.apart(edges, roots)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1, False), (1, 2, 1, False), (1, 3, 3, True)]
    assert neardups.apart(edges.where("a = 9"), roots) is None


def test_pipeline_drops_copies_that_differ_in_many_bits(spark):
    words = ["w%d" % i for i in range(100)]
    copy = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    far = [w if i % 9 else "z" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(3, " ".join(words)), (7, " ".join(copy)), (9, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [3, 9]


def test_linked():
    a = [np.arange(10, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    b = [np.arange(1, 10, dtype=np.uint64), np.arange(53, 63, dtype=np.uint64)]
    assert [x.tolist() for x in neardups.linked(a, b)] == [[0], [0]]
