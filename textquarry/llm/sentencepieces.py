"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protobuf) is parsed here; from it the normaliser, the
metaspace marker, the pieces with their scores and the byte fallback are built
anew: a unigram model becomes a lattice over the piece scores, a BPE model the
merges that its scores imply. Batches are encoded with several threads. Where
no piece holds the marker after another character, a text is split before each
run of markers first, which changes no result; each word is then encoded once and kept for the texts that follow.

Parity is verified, not assumed: the whole of ``PROBES`` when an encoder is
built, and in each batch of documents the text that the rebuilt decoder makes of the ids against the given one
and the ids of every document against the sentencepiece library (equal texts of a batch once).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import KEPT, lean, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are encoded at once; an encoding takes some fifty times its text.
ENCODED_AT_ONCE = 256 << 10
#: Words that a worker keeps with their ids, and the longest of these.
WORDS_KEPT, LONGEST_KEPT = 400_000, 64
#: New words that are encoded as one text.
JOINED = 32
MARK = "\N{LOWER ONE EIGHTH BLOCK}"
WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
#: Kinds of pieces in the file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ["", " ", "a", "Hello world", "  two  spaces ", "tab\tnew\nline\r\n", "café नमस्ते мир", "▁ marks▁▁", "<s> </s> <unk> <0x0A>", "\U0001d518①ﬁ\x00", " " * 37 + "x" + " " * 16, "aaaaaaaaaaaa", "1234567890.5%", "é　 x"]


def _number(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, i


def message(data: bytes) -> dict[int, list]:
    """The fields of a protobuf message: number -> values in order (numbers, or bytes)."""
    out, i = defaultdict(list), 0
    while i < len(data):
        key, i = _number(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _number(data, i)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        elif kind == 2:
            size, i = _number(data, i)
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        out[key >> 3].append(value)
    return out


class Spec:
    """What a model file says: pieces (text, score, kind), model type and normaliser."""

    def __init__(self, data: bytes):
        top = message(data)
        last = lambda m, k, default: m[k][-1] if k in m else default
        self.pieces = []
        for piece in map(message, top[1]):
            self.pieces.append((last(piece, 1, b"").decode(), struct.unpack("<f", last(piece, 2, b"\0\0\0\0"))[0], last(piece, 3, NORMAL)))
        trainer, norm = message(last(top, 2, b"")), message(last(top, 3, b""))
        self.kind, self.byte_fallback = last(trainer, 3, UNIGRAM), bool(last(trainer, 35, 0))
        self.charsmap = last(norm, 2, b"")
        self.prefix, self.squeeze, self.escape = (bool(last(norm, k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        if any(p[2] == USER for p in self.pieces) or not self.escape:
            raise ValueError("user-defined pieces and unescaped spaces are not supported")

    def splits(self) -> bool:
        """Whether no piece reaches over the start of a run of markers."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)


def merges(spec: Spec) -> list[tuple[str, str]]:
    """All ways to put a piece together from two, best score first; of equal scores the longer piece, as the leftmost pair goes first there."""
    known = {p for p, _, kind in spec.pieces if kind == NORMAL}
    order = sorted((p for p in spec.pieces if p[2] == NORMAL and len(p[0]) > 1), key=lambda p: (-p[1], -len(p[0])))
    return [(p[:i], p[i:]) for p, _, _ in order for i in range(1, len(p)) if p[:i] in known and p[i:] in known]


def built(spec: Spec, **options):
    """The tokenizers.Tokenizer of a model; ``options`` of its BPE, which change no ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocabulary = [p for p, _, _ in spec.pieces]
    if spec.kind == UNIGRAM:
        low = min(s for _, s, kind in spec.pieces if kind == NORMAL) - 10
        model = models.Unigram([(p if kind in (NORMAL, BYTE) else f"\x00{i}", s if kind == NORMAL else low) for i, (p, s, kind) in enumerate(spec.pieces)], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    else:
        model = models.BPE({p: i for i, p in enumerate(vocabulary)}, merges(spec), unk_token=vocabulary[spec.unknown], fuse_unk=True, byte_fallback=spec.byte_fallback, **options)
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    steps += [normalizers.Replace(" ", MARK)] + ([normalizers.Prepend(MARK)] if spec.prefix else [])
    out.normalizer = normalizers.Sequence(steps)
    if spec.splits():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    out.decoder = decoders.Sequence([decoders.Metaspace(MARK, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1 << 20 if spec.squeeze else 1, 0)] if spec.prefix or spec.squeeze else [])])
    return out


class Encoder:
    """A rebuilt tokenizer; ``encode`` takes texts to ids (int32), word by word where the model allows that, ``decode`` takes ids back."""

    def __init__(self, spec: Spec):
        from tokenizers import Tokenizer, pre_tokenizers

        by_words = spec.splits() and not spec.charsmap and not spec.squeeze
        # Words are kept here; the model's own cache would fill with such as are asked once.
        options = {"cache_capacity": 0} if by_words and spec.kind == BPE else {}
        self.tokenizer, self.words, self.kept = built(spec, **options), None, {}
        if by_words:
            self.front = MARK if spec.prefix else ""
            # The same model on words that the normaliser has made already: on each as it is, and on many, which merges
            # do not reach over; a unigram model's sums of scores are kept apart too.
            self.words, self.many = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            if spec.kind == UNIGRAM:
                self.many.pre_tokenizer = pre_tokenizers.Metaspace(MARK, prepend_scheme="never", split=True)
            self.opens = np.array([kind == NORMAL and MARK in p for p, _, kind in spec.pieces])
            self.find, self.plain = re.compile(WORD).findall, re.compile(f"{MARK}[^{MARK}]+").fullmatch

    def _split(self, text: str) -> list[str]:
        """The words of a text; where a marker is put before the text, words with one marker in front go without it."""
        if not self.front:
            return self.find(text.replace(" ", MARK))
        return [w[1:] if self.plain(w) else w for w in self.find(MARK + text.replace(" ", MARK))] if text else []

    def _words(self, texts: list[str]) -> tuple[pa.Array, list[tuple[int, int]]]:
        """The words of all texts, and where those of each text are. Texts whose words lie between single blanks are split at once."""
        odd = {i: self._split(t) for i, t in enumerate(texts) if not t or not self.front or MARK in t or "  " in t or t[0] == " "}
        lists = pc.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string()), " ")
        flat, ends = lists.flatten(), lists.offsets.to_pylist()
        places, n = list(zip(ends, ends[1:])), len(flat)
        for i, words in odd.items():
            places[i] = n, n + len(words)
            n += len(words)
        return pa.concat_arrays([flat, pa.array(list(chain.from_iterable(odd.values())), pa.string())]), places

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """Of different words. Those with one marker in front are encoded many at once, as each of them parts again before its marker: the piece that holds it is the word's first."""
        plain = [w for w in words if w and MARK not in w] if self.front else list(filter(self.plain, words))
        joined = [self.front + self.front.join(plain[at : at + JOINED]) for at in range(0, len(plain), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.many.encode_batch_fast(joined, add_special_tokens=False)), np.int32)
        starts, out = (np.nonzero(self.opens[ids])[0] * 4).tolist(), {}
        if len(starts) == len(plain):  # else the marker has no piece
            out.update(zip(plain, map(ids.tobytes().__getitem__, map(slice, starts, [*starts[1:], ids.nbytes]))))
        lone = [w for w in words if w not in out]
        whole = [w if MARK in w else self.front + w for w in lone]
        out.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(lone, self.words.encode_batch_fast(whole, add_special_tokens=False)))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words is None:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, places = self._words(texts)
        coded = flat.dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.kept.get, words))
        made = self._ids([w for w, ids in zip(words, found) if ids is None])
        found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.frombuffer(b"".join(found), np.int32)[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        out = [ids[ends[a] : ends[b]] for a, b in places]
        # What came first stays, frequent words among it; long words go again.
        room = WORDS_KEPT - len(self.kept)
        self.kept.update((w, ids) for w, ids in islice(made.items(), max(0, room)) if len(w) <= LONGEST_KEPT)
        return out

    def decode(self, ids: list[np.ndarray] | list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch([i if isinstance(i, list) else i.tolist() for i in ids], skip_special_tokens=False)


@lru_cache(maxsize=4)
def _encoder(digest: int, data: bytes):
    """(encoder, sentencepiece processor), once for each worker and model; raises where they disagree."""
    import sentencepiece

    mine, theirs = Encoder(Spec(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text, ids in zip(PROBES, mine.encode(PROBES)):
        if ids.tolist() != theirs.encode(text):
            raise ValueError(f"no parity with the model for {text!r}: {ids} and {theirs.encode(text)}")
        if mine.decode([ids]) != [theirs.decode(ids.tolist())]:
            raise ValueError(f"no parity with the model in decoding {text!r}")
    return mine, theirs


KEPT["encoder"] = _encoder.cache_clear


def encoder(data: bytes):
    return _encoder(zlib.crc32(data), data)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The file's bytes; a local path is read on the driver, any other through Spark."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encoded(docs: DataFrame, model: str = MODEL, threads: int = 2, parity_share: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` (text, ...) with __tq_ids (array of int), __tq_round_trip and __tq_parity.

    ``__tq_round_trip``: the rebuilt decoder makes the text of the ids again. ``__tq_parity``: the ids are
    those of the sentencepiece library, and so is what they decode to; on the texts whose crc32 is
    divisible by ``parity_share`` (1, the default: all texts), else null. A null text has null
    ids, an empty one none. Order and repeated rows stay; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    def encode(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        mine, theirs = encoder(shared.value)
        for batch in slices(batches, most=ENCODED_AT_ONCE):
            texts = batch.column("text").to_pylist()
            once = {t: i for i, t in enumerate(dict.fromkeys(t for t in texts if t is not None))}
            own = mine.encode(list(once))
            chosen = [t for t in once if parity_share == 1 or zlib.crc32(t.encode()) % parity_share == 0]
            wanted = dict(zip(chosen, theirs.encode(chosen, num_threads=1) if chosen else ()))
            equal = {t: len(w) == len(own[once[t]]) and bool((np.fromiter(w, np.int32, len(w)) == own[once[t]]).all()) for t, w in wanted.items()}
            back = mine.decode([wanted[t] if equal.get(t) else i for t, i in zip(once, own)])
            # Where the decoder gives the text back, the library would have to as well; only others are decoded by both.
            same = {t: equal[t] and (back[once[t]] == t or back[once[t]] == theirs.decode(w)) for t, w in wanted.items()}
            ids = [None if t is None else own[once[t]] for t in texts]
            trip = [None if t is None else back[once[t]] == t for t in texts]
            parity = [same.get(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids), pa.array(trip, pa.bool_()), pa.array(parity, pa.bool_())], [*batch.schema.names, "__tq_ids", "__tq_round_trip", "__tq_parity"])

    typed = docs.withColumn("text", F.col("text").cast("string"))
    extra = {"__tq_ids": F.lit(None).cast("array<int>"), "__tq_round_trip": F.lit(None).cast("boolean"), "__tq_parity": F.lit(None).cast("boolean")}
    return typed.mapInArrow(lean(encode, own="encoder"), typed.withColumns(extra).schema)


def _lists(ids: list) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))


def decoded(rows: DataFrame, ids: str = "__tq_ids", model: str = MODEL) -> DataFrame:
    """All rows and columns with __tq_text, the text of ``ids``. Null ids give a null text; an id outside of the model fails."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    def decode(batches):
        mine, _ = encoder(shared.value)
        size = mine.tokenizer.get_vocab_size()
        for batch in batches:
            each = batch.column(ids).to_pylist()
            if any(i is None or not 0 <= i < size for x in each if x for i in x):
                raise ValueError("an id outside of the model")
            found = iter(mine.decode([np.array(x, np.int32) for x in each if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(found) for x in each], pa.string())], [*batch.schema.names, "__tq_text"])

    return rows.mapInArrow(lean(decode, own="encoder"), rows.withColumn("__tq_text", F.lit(None).cast("string")).schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip and parity of every document."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__tq_ids").alias("ids"), F.when(F.col("__tq_ids").isNotNull(), F.size("__tq_ids")).cast("long").alias("n_tokens"), F.col("__tq_round_trip").alias("round_trip"), F.col("__tq_parity").alias("parity"))


QUERIES = {"op7_sentencepiece": op7}
ORACLES: dict[str, str] = {}
