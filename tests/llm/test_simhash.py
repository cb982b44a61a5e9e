import random

import numpy as np
import pytest
import xxhash

from textquarry.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """By brute force: (id, fingerprint) -> {id: component}."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


TEXTS = ["", None, " \t\n", "one", "One TWO", "É é a b c d", "a b c", "x " * 70_000, "a b c d e f g h i j k l m n o p"]


def test_fingerprint_of_odd_texts():
    for t in TEXTS:
        assert simhash.fingerprint(t.encode() if t is not None else None) == slow_fingerprint(t)


@pytest.mark.parametrize("joined", [False, True])
def test_every_link_meets_at_an_anchor(joined):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    y = x.copy()
    for k in range(len(x)):
        for bit in rng.choice(64, k % 5, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    rows, key, home = simhash.anchors(x, joined)
    rows2, key2, _ = simhash.anchors(y, joined)
    for k in range(len(x)):
        assert set(key[(rows == k) & home].tolist()) & set(key2[rows2 == k].tolist())


def planted(n=60):
    rng, out = random.Random(3), []
    vocabulary = ["w%d" % i for i in range(400)]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 40, 200]))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(words)
            near[rng.randrange(len(near))] = "edited"
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("joined,block", [(False, 4096), (True, 4096), (False, 3)])
def test_components_equal_brute_force(spark, joined, block):
    texts = planted() + TEXTS[:4] + ["same text of six whole words"] * 30
    rows = [(None if i % 17 == 5 else i * 3, t, "x", i) for i, t in enumerate(texts)] + [(3, texts[1], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int")
    got = simhash.near_duplicates(docs, joined, block).collect()
    pairs = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(pairs, slow_components(pairs)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_real_rows_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    pairs = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = sorted(zip([p[0] for p in pairs], [f"{p[1]:016x}" for p in pairs], slow_components(pairs)))
    assert sorted(map(tuple, simhash.op1(spark, "/root/testdata/sf0.001").collect())) == want


def test_forest_joins_what_links():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = simhash.forest(x, x)
    assert len(a) < len(x)
    got = slow_components([(int(v), int(v)) for v in x])
    root = {int(v): int(v) for v in x} | {int(p): int(q) for p, q in zip(a, b)}
    assert [root[int(v)] for v in x] == got


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u v"), (None, "p q r s t u v"), (9, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in simhash.first_of_each(docs).collect()))) == ["1", "9", "None"]
    assert simhash.first_of_each(docs.limit(0)).count() == 0
