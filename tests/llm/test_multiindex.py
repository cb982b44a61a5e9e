import random

import numpy as np
import pytest

from textquarry.llm import multiindex


def brute(rows, nearest=20):
    """(query, vec, score) lists by all pairs, in double precision."""
    ok = []
    for v, e in rows:
        if v is not None and e is not None and len(e) == 4 and all(c is not None and np.isfinite(c) for c in e) and any(e) and (v, tuple(e)) not in ok:
            ok.append((v, tuple(e)))
    best = {}
    for v, e in ok:
        if v % 20 == 0:
            for w, x in ok:
                if w != v:
                    best[v, w] = max(best.get((v, w), -np.inf), float((np.array(e) * np.array(x)).sum()))
    out = []
    for v in {v for v, _ in best}:
        near = sorted((-s, w) for (q, w), s in best.items() if q == v)
        out += [(v, n + 1, w, -s) for n, (s, w) in enumerate(near[:nearest])]
    return sorted(out)


def rows():
    rng = random.Random(8)
    same = [0.5, 0.25, -0.5, 1.0]
    out = [(i, same if i % 3 == 0 else [rng.choice([-1.0, 0.5, 0.25, 2.0, 0.0]) for _ in range(4)]) for i in range(300)]
    out += [(40, out[40][1]), (None, same), (1001, None), (1020, [0.0] * 4), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [None, 1.0, 1.0, 1.0]), (1080, [float("inf"), 1.0, 1.0, 1.0]), (1100, [1.0, 2.0]), (1120, []), (-20, [1.0, -1.0, 0.5, 0.5])]
    return out


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("centroids,blocks", [(4, 10_000), (64, 10_000), (3, 7)])
def test_visiting_all_equals_brute_force(spark, centroids, blocks):
    data = rows()
    vectors = spark.createDataFrame([(v, e, 1, "c") for v, e in data], "vec_id long, embedding array<float>, rank int, g string")
    out = multiindex.search(vectors, vectors.where("vec_id % 20 = 0"), centroids=centroids, visit=1.0, vector_block=blocks, query_block=blocks)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert got(out) == brute(data)
    # Ids with several vectors, among them many of one query id.
    more = data + [(60, [2.0, 2.0, 2.0, 2.0]), (61, [2.0, 2.0, 2.0, -2.0]), (0, [0.5, 0.5, 0.5, -1.0])] + [(80, [2.0, 2.0, 2.0, 1 + k / 64]) for k in range(30)]
    again = spark.createDataFrame(more, "vec_id long, embedding array<float>")
    assert got(multiindex.search(again, again.where("vec_id % 20 = 0"), centroids=centroids, visit=1.0, vector_block=blocks, query_block=blocks)) == brute(more)
    assert multiindex.search(vectors.limit(0), vectors).count() == 0
    assert multiindex.search(vectors, vectors.limit(0)).count() == 0


def test_few_candidates(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert got(multiindex.search(vectors, vectors.where("vec_id % 20 = 0"))) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_heap_walks_in_order():
    rng = np.random.default_rng(3)
    index = multiindex.Index(rng.normal(size=(500, 6)), 9)
    index.counts[:] = 1
    for _ in range(20):
        q = rng.normal(size=6)
        walked = list(index.walk(q, 81))
        sums = [index.first[i] @ q[:3] + index.second[j] @ q[3:] for i, j in walked]
        assert len(set(walked)) == 81 and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))


@pytest.mark.parametrize("clusters,most", [(0, 0.75), (200, 0.15)])
def test_the_share_visited_follows_the_vectors(clusters, most):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(clusters, size=len(x))] + 0.15 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multiindex.Index(x[:8000], multiindex.centroids_of(len(x)))
    i, j = index.cells(x)
    np.add.at(index.counts, (i, j), 1)
    share = multiindex.needed_share(index, x, 20)
    assert 0 < share < most
    hits, asked = 0, range(7, 20_000, 400)
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        cells = set(index.walk(x[q], int(share * len(x))))
        hits += sum((i[v], j[v]) in cells for v in np.argsort(-score)[:20])
    assert hits >= 0.93 * 20 * len(asked)


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(data.embedding.tolist(), np.float64), data.vec_id.to_numpy()
    out = multiindex.op4(spark, sf).toPandas()
    hits = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        near = np.lexsort((ids, -(x @ x[q])))
        want = [ids[j] for j in near if j != q][:20]
        mine = out[out.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and ids[q] not in mine.vec_id.tolist()
        assert np.allclose(mine.score, [x[q] @ x[np.nonzero(ids == v)[0][0]] for v in mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(want) & set(mine.vec_id))
    assert hits / (20 * len(np.nonzero(ids % 20 == 0)[0])) >= 0.9
