import sentencepiece

import corpus_pipeline
from tests.llm import test_decontam, test_linededup, test_neardups
from textquarry.llm import sentencepieces, toxicity

SF = "/root/testdata/sf0.001"


def lines_dropped(rows):
    holders = {}
    for d, t in rows:
        for line in t.split("\n"):
            holders.setdefault(test_linededup.key(line), set()).add(d)
    keep = lambda d, k: len(k) < 20 or len(holders[k]) < 3 or max(holders[k]) == d
    return [(d, "\n".join(x for x in t.split("\n") if keep(d, test_linededup.key(x)))) for d, t in rows]


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in toxicity.scored(docs, labels).where("__tq_score < 0.5").collect()]
    assert 0.8 * docs.count() < len(rows)
    rows = lines_dropped(rows)
    rows = [r for r, c in zip(rows, test_neardups.slow_components(rows)) if r[0] == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {x[0] for x in test_decontam.slow(rows, items)}
    rows = [r for r in rows if str(r[0]) not in leaks]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((d, model.encode(t)) for d, t in rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert all(len(r.text) == r.n_chars for r in out.collect()), name
