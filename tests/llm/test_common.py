import random

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm import common, neardups, registry, sentencepieces, toxicity
from textquarry.llm.common import lean


def slow_roots(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(None, 2), (3, None)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(60)], [(i + 1, i) for i in range(0, 30, 2)] * 3,
    [tuple(random.Random(5 * k).choices(range(-50, 50), k=2)) for k in range(70)],
])
def test_components_equal_union_find(spark, edges):
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == slow_roots(edges) and len(out) == len(slow_roots(edges))


def test_slices_keep_all_rows():
    texts = ["a" * n for n in (0, 5, 100, 3, 0, 900, 1)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], ["i", "text"])
    parts = list(common.slices([batch, batch.slice(0, 0)], most=150))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and 3 < len(parts) < 9


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024


def test_a_worker_keeps_no_memory_for_later_stages():
    """What a task freed once stayed with the worker, and so did the encoder and its words while toxicity ran."""
    with open(sentencepieces.MODEL, "rb") as f:
        data = f.read()
    mine, _ = sentencepieces.encoder(data)
    mine.encode(["hello world"])

    held = []

    def work(batches):
        # The C library keeps what lies below a block in use.
        blocks = [np.ones(500, np.uint64) for _ in range(40_000)]
        held.append(blocks[-1])
        yield from batches

    batch = pa.RecordBatch.from_pydict({"text": ["a b", None], "toxic": pa.array([0, 1], pa.int32())})
    before = anonymous_mb()
    assert list(lean(work, own="encoder")(iter([batch]))) == [batch]
    assert anonymous_mb() < before + 60 and sentencepieces.encoder(data)[0] is mine
    assert sum(b.num_rows for b in lean(toxicity._counted)(iter([batch]))) == 2
    assert sentencepieces.encoder(data)[0] is not mine


def test_the_stages_of_the_pipeline_are_lean(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for module, run in ((toxicity, lambda: toxicity.scored(docs, labels)), (neardups, lambda: neardups.near_duplicates(docs)), (sentencepieces, lambda: sentencepieces.encoded(docs))):
        seen = []
        monkeypatch.setattr(module, "lean", lambda work, own=None, seen=seen: seen.append(work) or lean(work, own))
        assert run().count() == 2 and seen
