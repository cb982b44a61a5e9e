import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same
from textquarry.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def slow(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


A, B, C = "A line of well over twenty points", "É déjà vu: ÄÖÜ und noch mehr Text", "short"
ROWS = [
    (1, f"{A}\n{B}\n{C}"), (2, f"  {A.lower()}\t\n{C}\n"), (3, f"{A}\n{A}\n{B}"), (4, f"\n{B}\x0b\n{B}"), (5, None), (6, ""), (7, "\n\n"),
    (None, f"{A}\n{B}"), (8, "x" * 100_000 + "\n" + B.replace("É", "é")), (8, A), (8, A), (-5, A), (10**15, C), (9, f"{B}\r\n" * 5),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_equals_brute_force(spark, batches, fanout):
    docs = spark.createDataFrame([(d, t, "p", 1, True) for d, t in ROWS], "doc_id long, text string, h1 string, keep int, gone boolean")
    out = linededup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert out.columns[:5] == docs.columns
    got = out.select("doc_id", "__tq_n_lines", "__tq_n_dropped", F.sha2("text", 256)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow(ROWS)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_many_lines_go(spark, monkeypatch):
    rng = random.Random(6)
    lines = [f"this is the repeated line number {i}" for i in range(40)]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.choice([3, 60])) + [f"own line of document {d}"])) for d in (5, 5, 9, 11, 30, 31, 32)] + [(None, lines[0]), (40, None)]
    rows.append(rows[1])
    docs = spark.createDataFrame([(d, t, "p", 1, True) for d, t in rows], "doc_id long, text string, h1 string, pos int, line boolean")
    for most in (0, 5, 64):
        monkeypatch.setattr(linededup, "MOST_LOOKED_UP", most)
        got = linededup.dedup_lines(docs).select("doc_id", "__tq_n_lines", "__tq_n_dropped", F.sha2("text", 256)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == slow(rows)


def test_work_grows_with_the_lines(spark):
    text = "\n".join(f"a line that three documents hold {i}" for i in range(100_000))
    docs = spark.createDataFrame([(d, text) for d in (1, 2, 3)], "doc_id long, text string")
    got = {r.doc_id: (r[1], r[2]) for r in linededup.dedup_lines(docs).select("doc_id", "__tq_n_lines", "__tq_n_dropped").collect()}
    assert got == {1: (100_000, 100_000), 2: (100_000, 100_000), 3: (100_000, 0)}


def test_the_anti_join_decides(spark):
    docs = spark.createDataFrame([(d, A) for d in (1, 2, 3, 4)], "doc_id long, text string")
    store = linededup.LineRuns(spark, fanout=3)
    for d in (4, 3, 2, 1):
        store.add(linededup.line_hashes(docs.where(docs.doc_id == d)))
    runs = sorted((r.keep, r.fresh) for r in store.rows([p for level in store.levels for p in level]).collect())
    assert runs == [(1, False), (4, True)]
    assert [(r.n, r.keep, r.fresh) for r in store.merged().collect()] == [(4, 4, True)]


def test_equals_sql(spark):
    same(spark, linededup.op5, linededup.SQL, "/root/testdata/sf0.001")


def test_batches_drop_what_earlier_ones_held(spark):
    store = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(k * 10, f"{A}\nline number {k} that is long"), (k * 10 + 1, f"{A}\nline number {k} that is long")], "doc_id long, text string")
        texts = {r.doc_id: r.text for r in store.dedup(batch).collect()}
        assert texts[k * 10] == ""
        assert texts[k * 10 + 1] == (f"{A}\n" if not k else "") + f"line number {k} that is long"
    assert sum(map(len, store.levels)) < 5 and len(store.levels) > 1
    assert store.merged().where("n >= 3").count() == 1
