import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import toxicity

RUDE = ["blarg", "snork", "grumf"]


def rows(n=900):
    rng = random.Random(11)
    plain = ["w%s%s" % (a, b) for a in "abcdefghij" for b in "klmnopqrst"]
    out = []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([5, 30, 120]))
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE).upper())
        out.append((i, " ".join(words), int(toxic)))
    return out


def crc(d):
    return zlib.crc32((b"" if d is None else str(d).encode())) % 5


@pytest.fixture(scope="module")
def tables(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in data] + [(None, "a", "x", 1), (5000, None, "x", 1), (5001, "", "x", 1), (3, "blarg snork grumf", "x", 1)], "doc_id long, text string, fold string, toxic int")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in data if d % 10 != 7] + [(None, 1, 1), (12, 1, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    return data, docs, labels


def slow_words(text):
    """The words by their spelling, with an empty one in front."""
    kept = (text or "").encode().translate(toxicity._KEEP).split()
    return [b"", *kept]


def slow_features(training, docs, least=5):
    """The three features of ``docs`` from (text, toxic) rows, by plain dictionaries."""
    pairs, before = [Counter(), Counter()], [defaultdict(set), defaultdict(set), defaultdict(set)]
    for text, y in training:
        words = slow_words(text)
        for v, w in set(zip(words, words[1:])):
            pairs[y][v, w] += 1
            before[y][w].add(v)
            before[2][w].add(v)
    t = [{w: len(vs) for w, vs in each.items()} for each in before]

    def discount(counts):
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5

    d, whole = [discount(t[k]) for k in (0, 1)], [discount(pairs[k]) for k in (0, 1)]
    n, shared, words = [max(1, sum(t[k].values())) for k in (0, 1)], sum(t[2].values()), len(t[2])
    off = lambda k, w: max(t[k].get(w, 0) - d[k], 0) if t[2].get(w, 0) >= least else 0
    low = [1 - sum(off(k, w) for w in t[k]) / n[k] for k in (0, 1)]
    single = lambda k, w: off(k, w) / n[k] + low[k] * (t[2].get(w, 0) + 1) / (shared + words + 1)
    kept = {p for p in {*pairs[0], *pairs[1]} if pairs[0][p] + pairs[1][p] >= least}
    total, mass = [Counter(), Counter()], [Counter(), Counter()]
    for k in (0, 1):
        for p, c in pairs[k].items():
            total[k][p[0]] += c
            mass[k][p[0]] += c - whole[k] if p in kept else 0

    def full(k, v, w):
        if not total[k][v]:
            return single(k, w)
        own = (pairs[k][v, w] - whole[k]) / total[k][v] if (v, w) in kept and pairs[k][v, w] else 0
        return own + (1 - mass[k][v] / total[k][v]) * single(k, w)

    out = []
    for text in docs:
        ws = slow_words(text)
        x = [math.log(single(1, w) / single(0, w)) for w in ws[1:]]
        y = [math.log(full(1, v, w) / full(0, v, w)) for v, w in zip(ws, ws[1:])]
        peaks = [sum(x[i : i + toxicity.PEAK]) / toxicity.PEAK for i in range(len(x) - toxicity.PEAK + 1)]
        top = sorted(x)[-toxicity.TOP :]
        out.append([sum(y) / len(y), sum(top) / len(top), max(peaks) if len(x) > toxicity.PEAK else sum(x) / len(x)] if x else [0, 0, 0])
    return np.array(out, float)


def slow_scores(docs, labels):
    """The score of each (doc_id, text), as the docstrings say."""
    toxic = defaultdict(int)
    for d, y in labels:
        if d is not None and y is not None and crc(d) != 0:
            toxic[d] = max(toxic.get(d, 0), int(y == 1))
    known = [(d, t, toxic[d]) for d, t in docs if d in toxic]
    features = slow_features([(t, y) for d, t, y in known if crc(d) != 1], [t for _, t in docs])
    at = [(i, toxic[d]) for i, (d, _) in enumerate(docs) if d in toxic and crc(d) == 1]
    return toxicity.Curve(features[[i for i, _ in at]], np.array([y for _, y in at], float))(features)


def test_scores_equal_brute_force(spark, tables):
    data, docs, labels = tables
    got = toxicity.scored(docs, labels).collect()
    want = slow_scores([(r.doc_id, r.text) for r in got], [(r.doc_id, r.toxic) for r in labels.collect()])
    assert np.abs(np.array([r["__tq_score"] for r in got]) - want).max() < 1e-4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_real_scores_equal_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs.select("doc_id", "text"), labels).collect()
    want = slow_scores([(r.doc_id, r.text) for r in got], [(r.doc_id, r.toxic) for r in labels.collect()])
    assert np.abs(np.array([r["__tq_score"] for r in got]) - want).max() < 1e-4


def test_the_context_counts():
    key = lambda t: toxicity.word_keys(t)
    v, w = key(b"a b").tolist()
    pair = toxicity.pair_keys(np.array([v], np.uint64), np.array([w], np.uint64))
    known = toxicity.Ratios(np.array([0, 1, 2]), np.array([w, v, pair[0]], np.uint64).view(np.int64), np.array([1.0, 0.25, 5.0]), -2.0)
    single, full = known(key(b"a b b c"), np.concatenate([[np.uint64(0)], key(b"a b b")]))
    assert single.tolist() == [-2, 1, 1, -2] and full.tolist() == [-2, 5, 1, -2]


def test_held_out_rows_are_told_apart(spark, tables):
    data, docs, labels = tables
    score = {(r.doc_id, r.text): r["__tq_score"] for r in toxicity.scored(docs, labels).collect()}
    held = [(score[d, t], y) for d, t, y in data if crc(d) == 0 or d % 10 == 7]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in score.values())
    assert score[5000, None] == score[5001, ""] < 0.5
    assert len(score) == docs.count()


def test_labels_of_the_held_out_fold_change_nothing(spark, tables):
    _, docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.scored(docs, x).select("__tq_score", "text").collect(), key=str) for x in (labels, flipped))
    assert a == b


def test_odd_tables(spark, tables, monkeypatch):
    _, docs, labels = tables
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r[0] for r in toxicity.scored(docs, labels.limit(0)).select("__tq_score").collect()} == {0.5}
    want = sorted(map(str, toxicity.scored(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    assert sorted(map(str, toxicity.scored(docs, labels).collect())) == want


def test_contract(spark):
    out = toxicity.op10(spark, "/root/testdata/sf0.01")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in out.collect():
        assert r.held_out == (crc(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5)


def test_words():
    key = lambda w: xxhash.xxh32_intdigest(w) << 32 | zlib.crc32(w)
    assert toxicity.word_keys("Ab,c é1 99".encode()).tolist() == [key(w.encode()) for w in ("ab", "c", "é0", "00")]
    none = toxicity.Ratios(*(np.zeros(0, np.int64),) * 3, 1.0)
    x = toxicity._features(none, pa.array(["a b", "", None, "w " * 50, "w " * 300_000]))
    assert x.tolist() == [[1, 1, 1], [0, 0, 0], [0, 0, 0], [1, 1, 1], [1, 1, 1]]


def test_the_curve_takes_a_share_of_its_fold(spark, tables, monkeypatch):
    data, docs, labels = tables
    monkeypatch.setattr(toxicity, "MOST_CURVE", 40)
    rows = toxicity._labelled(docs, labels).collect()
    known = {d for d, _, _ in data if d % 10 != 7 and crc(d) != 0}
    assert len(rows) == len(known) + (1 if 3 in known else 0)
    assert 15 < sum(r.curve for r in rows) < 80


def test_joined_ratios_give_the_same(spark, tables, monkeypatch):
    _, docs, labels = tables
    want = sorted(map(str, toxicity.scored(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "MOST_ROWS", 0)
    assert sorted(map(str, toxicity.scored(docs, labels).collect())) == want


def sent(spark):
    """Bytes that all stages so far have shuffled and written."""
    store = spark.sparkContext._jsc.sc().statusStore()
    context = spark.sparkContext._jvm
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(context.double, 0), context.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in stages}


def test_joined_ratios_stay_within_the_disk(spark, tmp_path, monkeypatch):
    """Joined, the keys of the documents once took thirty times the input."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "MOST_ROWS", 0)
    before = sent(spark)
    assert toxicity.scored(docs.select("doc_id", "text"), labels).agg(F.sum("__tq_score")).first()[0] > 0
    took = sum(n for k, n in sent(spark).items() if k not in before)
    assert 0 < took < 6 * 1_428_373


def test_groups_and_messages(spark, monkeypatch):
    """Any rows come back from groups; keys come back from messages; texts without a key of the table ask nothing and have a score."""
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.unique(rng.integers(0, 1 << 64, 1000, np.uint64)), np.array([0, 1, 2**64 - 1], np.uint64)):
        assert toxicity._keys(toxicity._message(keys)).tolist() == keys.tolist()
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 300)
    batch = pa.RecordBatch.from_pydict({"text": ["a b"] * 9 + [None, "", "c" * 1000], "n": list(range(12))})
    packed = list(toxicity._packed([batch, batch.slice(0, 0), batch]))
    back = [r for p in packed for b in toxicity._group(p["rows"][0].as_py()) for r in b.to_pylist()]
    assert len(packed) > 4 and back == 2 * batch.to_pylist()
    docs = spark.createDataFrame([(1, "zzz"), (2, None), (3, "blarg zzz"), (None, "")], "doc_id long, text string")
    ratios = spark.createDataFrame([(toxicity.WORD, int(toxicity.word_keys(b"blarg").view(np.int64)[0]), 2.0)], "kind int, key long, ratio float")
    finish = lambda b, x: pa.RecordBatch.from_arrays([*b.columns, pa.array(x[:, 0])], [*b.schema.names, "x"])
    got = [toxicity._applied(docs, ratios, -1.0, finish, "doc_id long, text string, x double").collect() for most in (1, 0) if monkeypatch.setattr(toxicity, "MOST_ROWS", most) is None]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and {(r.doc_id, r.x) for r in got[1]} == {(1, -1.0), (2, 0.0), (3, 0.5), (None, 0.0)}
