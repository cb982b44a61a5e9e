import zlib

import numpy as np
import pytest

from textquarry.llm import quality as Q


def crc(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


def slow(docs, labels):
    """The whole operator on rows (doc_id, text, source, lang) in plain Python; the curve as the operator fits it."""
    known = {}
    for d, y in labels:
        if d is not None and y is not None and crc(d):
            known[d] = min(known.get(d, 1), int(y == 1))
    x = [Q.features(t.encode() if t is not None else None) for _, t, _, _ in docs]
    learned = [(x[i], known[d], s or "", p or "") for i, (d, _, s, p) in enumerate(docs) if d in known]
    w, mean, scale = Q.logistic(np.array([r[0] for r in learned]).reshape(-1, len(Q.FEATURES)), np.array([r[1] for r in learned], float))
    overall = (sum(r[1] for r in learned) + 0.5) / (len(learned) + 1)

    def rates(key, prior):
        groups = {}
        for r in learned:
            groups.setdefault(key(r), []).append(r[1])
        s = sum(len(g) * (np.mean(g) - prior(k)) ** 2 for k, g in groups.items())
        chance = sum(prior(k) * (1 - prior(k)) for k in groups)
        most = sum(len(g) * prior(k) * (1 - prior(k)) for k, g in groups.items())
        a = min(max((most - chance) / (s - chance) - 1, 1), 1000) if s > chance else 1000
        return {k: (sum(g) + a * prior(k)) / (len(g) + a) for k, g in groups.items()}

    hosts = rates(lambda r: r[2], lambda k: overall)
    paths = rates(lambda r: r[2:], lambda k: hosts[k[0]])
    out = []
    n = len(Q.FEATURES)
    for (d, _, s, p), f in zip(docs, x):
        z = np.clip((np.array(f) - mean[1 : n + 1]) / scale[1 : n + 1], -6, 6)
        e = float(np.clip(w[0] + z @ w[1 : n + 1] + z**2 @ w[n + 1 :], -30, 30))
        h = hosts.get(s or "", overall)
        r = paths.get((s or "", p or ""), h)
        score = 1 / (1 + np.exp(-(e + np.log(r / (1 - r)) - np.log(overall / (1 - overall)))))
        out.append((str(d), crc(d) == 0, round(e, 5), round(h, 7), round(r, 7), round(score, 5)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.held_out, round(r.evidence, 5), round(r.host_rate, 7), round(r.path_rate, 7), round(r.score, 5)) for r in df.collect())


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:], rtol=0, atol=3e-5), (g, w)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(400):
        bad = bool(i % 5 == 0)
        text = " ".join("%s%s" % (w, "###" if bad else "") for w in rng.choice(["alpha", "beta", "Gamma", "delta", "\n", "é", "12"], rng.integers(3, 90)))
        docs.append((i, text, None if i % 13 == 0 else "s%d" % (i % 4 + 2 * bad), None if i % 17 == 0 else "l%d" % (i % 2)))
        labels.append((i, int(not bad)) if i % 3 else (i, None))
    docs += [(None, "x", "s1", "l1"), (7, "x y z", "s1", "l0"), (900, None, None, None), (901, "", "new", "l0"), (902, " \n", "s1", "new"), (903, "long " * 40_000, "s1", "l1")]
    labels += [(None, 1), (7, 0), (8, 0), (5555, 1)]
    frame = spark.createDataFrame([(*d, 0.1, [1.0]) for d in docs], "doc_id long, text string, source string, lang string, score double, x array<double>")
    known = spark.createDataFrame([(*y, 9) for y in labels], "doc_id long, quality int, y int")
    near(rows(Q.classified(frame, known)), slow(docs, labels))
    assert Q.classified(frame.limit(0), known).count() == 0
    assert {(r.host_rate, r.path_rate, r.score) for r in Q.classified(frame, known.limit(0)).collect()} == {(0.5, 0.5, 0.5)}


def test_real_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = Q.op6(spark, sf)
    near(rows(out), slow(docs, labels))
    truth = dict(labels)
    held = [(r.keep, truth[r.doc_id] == 1) for r in out.collect() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


@pytest.mark.parametrize("text", [None, b"", b" ", b"!", "é".encode(), b"A1 b\nA1 b\n" * 3])
def test_features_are_finite(text):
    assert np.isfinite(Q.features(text)).all()
