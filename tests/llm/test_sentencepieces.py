import struct
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from textquarry.llm import sentencepieces as S


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def toy(kind, squeeze=0, prefix=1):
    """A model file by hand: control and byte pieces, some words with made-up scores."""
    words = [S.MARK, *"abcdehlorwtn", S.MARK + "a", "he", "ll", "hell", "hello", S.MARK + "wor", "ld", "world", S.MARK + "b", "an", "na", "ban", "ana", S.MARK + "ban", "tt", "ttt"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(w, -float(i + 1) if kind == 2 or len(w) > 1 else -9.0 - i / 7, 1) for i, w in enumerate(sorted(words, key=lambda w: -len(w)))]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    return out + field(2, field(3, kind) + field(35, 1)) + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, 1))


TEXTS = ["hello world", "", " ", "  banana bananana ", "tttttt hellhello", "é hello\nworld\t!", "x" * 40, "a b  c   d", S.MARK + "ban", "ll ll lll llll"]


@pytest.mark.parametrize("kind", [S.UNIGRAM, S.BPE])
@pytest.mark.parametrize("squeeze,prefix", [(0, 1), (0, 0), (1, 1)])
def test_models_by_hand(kind, squeeze, prefix):
    data = toy(kind, squeeze, prefix)
    theirs, mine = sentencepiece.SentencePieceProcessor(model_proto=data), S.built(S.Spec(data))
    for t in TEXTS:
        ids = mine.encode(t, add_special_tokens=False).ids
        assert ids == theirs.encode(t), t
        assert mine.decode(ids, skip_special_tokens=False) == theirs.decode(ids)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = S.encoded(docs, parity_share=1)
    assert out.columns == [*docs.columns, "__tq_ids", "__tq_round_trip", "__tq_parity"]
    rows = out.collect()
    theirs = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert all(r["__tq_round_trip"] and r["__tq_parity"] and r["__tq_ids"] == theirs.encode(r.text) for r in rows)
    assert len(rows) == docs.count()
    assert all(r["__tq_text"] == r.text for r in S.decoded(out).collect())


def test_odd_rows(spark):
    texts = [None, "", " ", "\n", "a\x00b", "\U0001d518" * 50, "word " * 60_000, "x" * 20_000, S.MARK, "<s>", "a", "a"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in S.encoded(docs, parity_share=1).collect()}
    assert rows[0]["__tq_ids"] is None and rows[0]["__tq_parity"] is None and rows[1]["__tq_ids"] == []
    assert all(r["__tq_parity"] for i, r in rows.items() if i)
    # The marker itself decodes to a blank, as in the library.
    assert [i for i, r in rows.items() if i and not r["__tq_round_trip"]] == [8]
    assert S.encoded(docs.limit(0)).count() == 0
    back = S.decoded(S.encoded(docs)).collect()
    assert [r["__tq_text"] for r in sorted(back, key=lambda r: r.doc_id)] == [t if t != S.MARK else " " for t in texts]
    with pytest.raises(Exception, match="outside of the model"):
        S.decoded(spark.createDataFrame([([1, 99999],)], "x array<int>"), "x").collect()


def test_every_document_is_compared(spark):
    rows = S.op7(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.parity for r in rows)


def test_not_supported():
    with pytest.raises(ValueError, match="neither"):
        S.Spec(toy(3))
    with pytest.raises(ValueError, match="wire type"):
        S.message(b"\x0b")


@pytest.mark.parametrize("kind", [S.UNIGRAM, S.BPE])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("kept", [0, 3, 1000])
def test_words_are_put_together(kind, prefix, kept, monkeypatch):
    """As the library has them, whichever words are kept: new, seen before, long, with runs of blanks and markers; also where the marker has no piece."""
    monkeypatch.setattr(S, "WORDS_KEPT", kept)
    texts = [*TEXTS, "ban hello", " ban", "ban ", "hello  world", "a" + S.MARK + "b hello", "hello " + "ban" * 40 + " hello", "a\nb c", "\nban", "a \nban\n\n ban \n hello\n", "b\n" + S.MARK + "\nban", "hello  \n ban\n", "\n", "é\né", "hello ban hello", " "]
    for data in (toy(kind, 0, prefix), toy(kind, 0, prefix).replace(S.MARK.encode(), "\u2582".encode())):
        theirs, mine = sentencepiece.SentencePieceProcessor(model_proto=data), S.Encoder(S.Spec(data))
        assert mine.words is not None
        for _ in range(2):
            got = mine.encode(texts)
            assert [i.tolist() for i in got] == theirs.encode(texts)
            assert mine.decode(got) == theirs.decode([i.tolist() for i in got])
        assert len(mine.kept) <= kept and all(len(w) <= S.LONGEST_KEPT for w in mine.kept)


def test_words_cost_less_than_texts():
    """CPU time of an encoder against that of the same model on whole texts; word by word once took as long."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:4000]
    with open(S.MODEL, "rb") as f:
        mine = S.Encoder(S.Spec(f.read()))
    took, got = [], []
    for encode in (mine.encode, lambda x: [e.ids for e in mine.tokenizer.encode_batch_fast(x, add_special_tokens=False)]):
        start = time.process_time()
        got.append([list(ids) for at in range(0, len(texts), 100) for ids in encode(texts[at : at + 100])])
        took.append(time.process_time() - start)
    assert got[0] == got[1] and took[0] < 0.85 * took[1], took


def test_frequent_words_cost_one_lookup_a_batch():
    """A word was once looked up wherever it stood, and new ones went through the model's own cache and pre-tokenizer."""
    with open(S.MODEL, "rb") as f:
        mine = S.Encoder(S.Spec(f.read()))
    asked = []

    class Kept(dict):
        def get(self, word):
            asked.append(word)
            return super().get(word)

    mine.kept = Kept()
    texts = ["ban the hello ban " * 50 + "ban", "the\nhello ban", " ban  the", "", "ban "]
    assert [i.tolist() for i in mine.encode(texts)] == [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) < 10


def test_a_wrong_id_is_found_in_any_text(spark, monkeypatch):
    """Parity holds the ids of every text against the library's, and decodes what was encoded, not what the library gave."""
    data = S.read_model(spark, S.MODEL)
    mine, theirs = S.Encoder(S.Spec(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    mine.kept["hello"] = mine.encode(["world"])[0].tobytes()
    monkeypatch.setattr(S, "encoder", lambda _: (mine, theirs))
    taken = []
    docs = spark.createDataFrame([(1, "hello you")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: taken.append(work) or self)
    S.encoded(docs)
    batch = pa.RecordBatch.from_pydict({"text": ["a hello", "a world", None, "", "a hello"]})
    out = next(taken[0](iter([batch])))
    assert out["__tq_parity"].to_pylist() == [False, True, None, True, False]
    assert out["__tq_round_trip"].to_pylist() == [False, True, None, True, False]
