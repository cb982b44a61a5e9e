import math
import random
import re

import pytest

from textquarry.llm import licenses


def words_of(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def slow_blocks(words, threshold=licenses.THRESHOLD):
    """(label, word) for what is covered by blocks that meet a template of the label: of the blocks that end at a
    word and are at most SPREAD times as long as the template, the shortest with the most template words."""
    out = set()
    for label, text in licenses.TEMPLATES:
        own = words_of(text)
        width, own = len(own) * licenses.SPREAD, set(own)
        needed = math.ceil(threshold * len(own) - 1e-9)
        for end in range(len(words)):
            if words[end] in own:
                seen, best = set(), (0, end)
                for start in range(end, max(-1, end - width), -1):
                    if words[start] in own:
                        seen.add(words[start])
                    if len(seen) > best[0]:
                        best = len(seen), start
                if best[0] >= needed:
                    out |= {(label, i) for i in range(best[1], end + 1)}
    return out


def slow_phrases(words):
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def want(rows):
    out = []
    for d, t in rows:
        w = words_of(t)
        phrases, blocks = slow_phrases(w), slow_blocks(w)
        starts = [s for s, _ in phrases]
        base = {x for _, x in phrases}
        out.append((str(d), len(w), len(phrases), str(min(starts, default=None)), str(max(starts, default=None)), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in blocks}))))
    return sorted(out)


def texts():
    rng = random.Random(4)
    out = [None, "", "CC-BY", "cc by by cc  BY", "all rights\nreserved ALL RIGHTS RESERVED", "général public license general public license.", "x" * 100_000, "cc by " * 3000, *STREWN]
    filler = "the a of under word license version this é 2 0".split()
    for _ in range(80):
        own = words_of(rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.choice([0, 1, 2, 4])):
            own[rng.randrange(len(own))] = "other"
        if rng.random() < 0.3:
            rng.shuffle(own)
        own = [w for x in own for w in ([x, rng.choice(filler)] if rng.random() < 0.2 else [x])]
        out.append(" ".join(rng.choices(filler, k=rng.choice([0, 5, 40])) + own + rng.choices(filler, k=rng.choice([0, 5]))))
    return out


MIT = licenses.TEMPLATES[3][1].split()
STREWN = [
    " ".join(w for i, word in enumerate(MIT) for w in ([word, "filler"] if i % 2 == 0 and i < 16 else [word])),
    "licensed under the terms of the apache software license version 2 0",
    "released under the terms of the MIT license",
]


def test_words_strewn_in_hide_nothing():
    every = licenses.Templates(licenses.TEMPLATES, {}, licenses.THRESHOLD)
    for text, label in zip(STREWN, ("mit", "apache-2.0", "mit")):
        found = {x: c for x, _, _, c in every.met([w.encode() for w in words_of(text)])}
        assert found[label] >= licenses.THRESHOLD
    assert {x: c for x, _, _, c in every.met([w.encode() for w in words_of(STREWN[0])])}["mit"] == 1.0


def results(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = [(None if i % 11 == 3 else i // 2, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, 1, 1.0) for d, t in rows], "doc_id long, text string, n_words int, score double")
    monkeypatch.setattr(licenses, "table", lambda *_: docs)
    assert results(licenses.op8(spark, "")) == want(rows)
    for r in licenses.scan(docs).collect():
        covered = {(b.label, i) for b in r["__tq_scan"].blocks for i in range(b.first, b.last + 1)}
        assert covered == slow_blocks(words_of(r.text))
        assert 0 <= r["__tq_scan"].score <= 1
    docs = docs.limit(0)
    assert licenses.op8(spark, "").count() == 0


def test_real_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert results(licenses.op8(spark, sf)) == want(rows)


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_thresholds(threshold):
    every = licenses.Templates(licenses.TEMPLATES, {b"license": 9, b"the": 99}, threshold)
    for t in texts()[8:]:
        w = words_of(t)
        covered = {(x, i) for x, a, b, _ in every.met([v.encode() for v in w]) for i in range(a, b + 1)}
        assert covered == slow_blocks(w, threshold)
