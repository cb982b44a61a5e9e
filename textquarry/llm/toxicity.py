r"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary documents, are compared by their
log-likelihoods per word:

    p(w | v) = max(n(v, w) - D, 0) / n(v) + l(v) p(w),  p(w) = max(t(w) - d, 0) / t + l u(w)

n(v, w) counts documents with the pair and t(w) the different words before w, both in the class; u comes
from the continuation counts that the classes share, so what was seen rarely is smoothed towards the same value in
both. D and d are estimated for each class from how many counts are one and two. Words with under ``LEAST``
different words before them, and pairs in under ``LEAST`` documents, back off wholly (count cutoffs): so only expressions
attested in different places tell the classes apart, and no group of copies makes one.

The score is a logistic curve over the difference of the mean log-likelihoods, that of the TOP words that
speak most for toxicity, and its largest mean over PEAK words; the latter two take p(w) alone, as a rare pair says too much in so few words.

Counts come from every labelled training document and stay in Spark, one row for each
word, context and pair (64-bit keys), however many there are. Of these only words and pairs beyond the cutoffs and contexts of such pairs
have a value of their own in the table of ratios. It is broadcast up to ``MOST_ROWS``
rows; beyond, groups of documents ask its parts for their different words and pairs by shuffle.
Labelled rows are dealt by crc32(doc_id as text) mod 5: 0 is held out, of 1 at most ``MOST_CURVE`` rows (a uniform
choice by hash) fit the curve, all others are counted. Settings were chosen on fold 1.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import lean, slices, table, written

#: Rows of the table of ratios up to which it is broadcast.
MOST_ROWS = 1 << 21
#: Beyond: bytes of text of a group of documents, and rows of the table and groups for each part of the table.
GROUP_BYTES, PART_ROWS, PART_GROUPS = 4 << 20, 1 << 15, 8
#: Binary logarithm of the bits of a map of its keys, at most (32 MB).
MOST_BITS = 28
#: Contexts of a word, documents of a pair from which on they count.
LEAST = 5
TOP, PEAK = 3, 8
MOST_CURVE = 20_000
#: Labels up to which they are broadcast to the documents.
MOST_BROADCAST = 1_000_000
FOLDS, HELD_OUT, CURVE = 5, 0, 1
WORD, CONTEXT, PAIR, TOTALS = 0, 1, 2, 3
_KEEP = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 for c in range(256))


def word_keys(text: bytes | None) -> np.ndarray:
    """64 bits (xxh32, then crc32) for each word: a run of letters, digits (all alike) and non-ASCII characters, A-Z lower-cased."""
    words = text.translate(_KEEP).split() if text else ()
    high = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))
    return high << np.uint64(32) | np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words ^ (before << np.uint64(31) | before >> np.uint64(33))


def _pair_key(v, w):
    return w.bitwiseXOR(F.shiftleft(v, 31).bitwiseOR(F.shiftrightunsigned(v, 33)))


def _batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the word before each or 0, number of words by text) of a batch."""
    each = [word_keys(t) for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    words = np.concatenate(each) if each else np.zeros(0, np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 0
    return words, before, sizes


def _counted(batches):
    """(v, w, n0, n1): in how many ordinary and toxic documents of a batch w comes after v."""
    for batch in slices(batches, most=4 << 20):
        words, before, sizes = _batch_words(batch.column("text"))
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(pair_keys(before, words), kind="stable")
        words, before, doc = words[order], before[order], doc[order]
        new = np.r_[True, (words[1:] != words[:-1]) | (before[1:] != before[:-1])]
        once = new | np.r_[True, doc[1:] != doc[:-1]]
        toxic = batch.column("toxic").to_numpy()[doc] == 1
        starts = np.nonzero(new)[0]
        n = [np.add.reduceat((once & side).astype(np.int32), starts) for side in (~toxic, toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(before[starts].view(np.int64)), pa.array(words[starts].view(np.int64)), *(pa.array(x, pa.int32()) for x in n)], ["v", "w", "n0", "n1"])


def counted(training: DataFrame, least: int = LEAST) -> DataFrame:
    """(kind, v, w, x0, x1, x, y0, y1) from ``training`` (text, toxic), in one pass:

    PAIR: n(v, w) of either class (x0, x1) where both together are at least ``least``. WORD: for each word w its
    continuation counts in either class and in both (x0, x1, x), and n(w) as a context (y0, y1). TOTALS: one row with
    the number of pairs that a class has once (x0, x1) and twice (y0, y1).
    """
    pairs = training.select("text", "toxic").mapInArrow(lean(_counted), "v long, w long, n0 int, n1 int").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    zero, flag = F.lit(0).cast("long"), lambda c: c.cast("int").cast("long")
    has = [F.col(n) > 0 for n in ("n0", "n1")]
    kept = pairs.where(F.col("n0") + F.col("n1") >= least).select(F.lit(PAIR).alias("kind"), "v", "w", F.col("n0").alias("x0"), F.col("n1").alias("x1"), zero.alias("x"), zero.alias("y0"), zero.alias("y1"))
    after = F.struct(F.col("w").alias("w"), flag(has[0]).alias("x0"), flag(has[1]).alias("x1"), F.lit(1).cast("long").alias("x"), zero.alias("y0"), zero.alias("y1"))
    ahead = F.struct(F.col("v").alias("w"), zero.alias("x0"), zero.alias("x1"), zero.alias("x"), F.col("n0").alias("y0"), F.col("n1").alias("y1"))
    names = ("x0", "x1", "x", "y0", "y1")
    words = pairs.select(F.explode(F.array(after, ahead)).alias("e")).groupBy(F.col("e.w").alias("w")).agg(*(F.sum(F.col("e")[c]).alias(c) for c in names))
    totals = pairs.agg(*(F.count_if(F.col(n) == k).alias(c) for c, n, k in (("x0", "n0", 1), ("x1", "n1", 1), ("y0", "n0", 2), ("y1", "n1", 2))))
    words = words.select(F.lit(WORD).alias("kind"), zero.alias("v"), "w", *names)
    totals = totals.select(F.lit(TOTALS).alias("kind"), zero.alias("v"), zero.alias("w"), "x0", "x1", zero.alias("x"), "y0", "y1")
    return kept.unionByName(words).unionByName(totals)


def discount(ones: int, twos: int) -> float:
    """The Kneser-Ney estimate, kept off 0 and 1; a half without any."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def log_ratios(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, float]:
    """(kind, key, ratio), and the ratio of all other words; ``counts`` as ``counted`` gives them.

    WORD: log p(w | toxic) - log p(w | ordinary). CONTEXT: the same of what v leaves to the words after it. PAIR: that of p(w | v).
    """
    counts = written(counts, "counts")
    words, pairs = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == PAIR)
    ones = counts.where(F.col("kind") == TOTALS).first()
    whole = [discount(ones.x0, ones.y0), discount(ones.x1, ones.y1)] if ones else [0.5, 0.5]
    few = words.agg(*(F.count_if(F.col(c) == k) for c in ("x0", "x1") for k in (1, 2))).first()
    small = [discount(few[0], few[1]), discount(few[2], few[3])]
    beyond = F.col("x") >= least
    off = [F.when(beyond & (F.col(c) > 0), F.col(c) - small[k]).otherwise(0.0) for k, c in enumerate(("x0", "x1"))]
    sums = words.agg(F.count_if(F.col("x") > 0), *(F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ("x", "x0", "x1")), *(F.coalesce(F.sum(c.cast("decimal(28,6)")), F.lit(0)).cast("double") for c in off)).first()
    n_words, shared, n0, n1, k0, k1 = sums
    n = [max(n0, 1.0), max(n1, 1.0)]
    low = [1 - k0 / n[0], 1 - k1 / n[1]]
    base = (F.col("x") + 1) / F.lit(shared + n_words + 1)
    p = [off[k] / F.lit(n[k]) + F.lit(low[k]) * base for k in (0, 1)]
    each = words.select("w", "y0", "y1", beyond.alias("own"), p[0].alias("p0"), p[1].alias("p1"))

    contexts = pairs.groupBy("v").agg(*(F.sum(c).alias(c) for c in ("x0", "x1")), *(F.count_if(F.col(c) > 0).alias(f"m{k}") for k, c in enumerate(("x0", "x1"))))
    left = [F.when(F.col(f"y{k}") > 0, 1 - (F.col(f"x{k}") - whole[k] * F.col(f"m{k}")) / F.col(f"y{k}")).otherwise(1.0) for k in (0, 1)]
    contexts = written(contexts.join(words.select(F.col("w").alias("v"), "y0", "y1"), "v").select("v", "y0", "y1", left[0].alias("l0"), left[1].alias("l1")), "contexts")
    seen = [F.when(F.col(f"x{k}") > 0, (F.col(f"x{k}") - whole[k]) / F.col(f"y{k}")).otherwise(0.0) + F.col(f"l{k}") * F.col(f"p{k}") for k in (0, 1)]
    full = pairs.select("v", "w", "x0", "x1").join(contexts, "v").join(each.select("w", "p0", "p1"), "w").select(F.lit(PAIR).alias("kind"), _pair_key(F.col("v"), F.col("w")).alias("key"), F.log(seen[1] / seen[0]).alias("ratio"))
    single = each.where("own").select(F.lit(WORD).alias("kind"), F.col("w").alias("key"), F.log(F.col("p1") / F.col("p0")).alias("ratio"))
    gaps = contexts.select(F.lit(CONTEXT).alias("kind"), F.col("v").alias("key"), F.log(F.col("l1") / F.col("l0")).alias("ratio"))
    every = single.unionByName(gaps).unionByName(full).withColumn("ratio", F.col("ratio").cast("float"))
    return written(every, "ratios"), float(np.log(low[1] / low[0]))


class Ratios:
    """Ratios by kind and key, and that of all other words."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, ratio: np.ndarray, other: float):
        self.tables, self.other = [], np.float32(other)
        for k in (WORD, CONTEXT, PAIR):
            keys, at = np.unique(key[kind == k].view(np.uint64), return_index=True)
            self.tables.append((keys, ratio[kind == k][at].astype(np.float32)))

    def _of(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, ratio)."""
        known, ratios = self.tables[kind]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, ratios[at]

    def __call__(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ratio of p(w), ratio of p(w | v)) of each word."""
        known, single = self._of(WORD, words)
        single = np.where(known, single, self.other).astype(np.float64)
        known, gap = self._of(CONTEXT, before)
        backed_off = single + np.where(known, gap, 0)
        known, full = self._of(PAIR, pair_keys(before, words))
        return single, np.where(known, full, backed_off)


def _features(ratios: Ratios, texts: pa.Array) -> np.ndarray:
    """(mean ratio, mean of the TOP largest, largest mean over PEAK words) of each text; zeros for one without words."""
    words, before, sizes = _batch_words(texts)
    out = np.zeros((len(sizes), 3))
    single, full = ratios(words, before)
    ends = np.cumsum(sizes)
    for i in np.nonzero(sizes)[0]:
        x = single[ends[i] - sizes[i] : ends[i]]
        at = np.concatenate([[0.0], np.cumsum(x)])
        top = x if len(x) <= TOP else np.partition(x, len(x) - TOP)[-TOP:]
        out[i] = full[ends[i] - sizes[i] : ends[i]].mean(), top.mean(), (at[PEAK:] - at[:-PEAK]).max() / PEAK if len(x) > PEAK else at[-1] / len(x)
    return out


def _packed(batches):
    """(g, rows): groups of up to GROUP_BYTES of text, each of them one compressed value under a random number."""

    def pack(group):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, group[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
            for part in group:
                out.write_batch(part)
        g = int.from_bytes(os.urandom(8), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "rows"])

    group, size = [], 0
    for batch in slices(batches, most=GROUP_BYTES):
        more = (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0) + 64 * batch.num_rows
        if group and size + more > GROUP_BYTES:
            yield pack(group)
            group, size = [], 0
        group, size = [*group, batch], size + more
    if group:
        yield pack(group)


def _group(rows: bytes) -> list[pa.RecordBatch]:
    return list(slices(pa.ipc.open_stream(rows)))


class Likely:
    """One bit for each range of keys, set where the table has one: keys without are surely not in it, others are looked up.

    Some 16 bits for each row of the table, up to 1 << MOST_BITS; a fuller map lets more keys through and changes no result.
    """

    def __init__(self, ratios: DataFrame, n_ratios: int):
        self.bits = min(MOST_BITS, max(6, (16 * n_ratios).bit_length()))
        at = f"shiftrightunsigned(key, {64 - self.bits})"
        each = ratios.select(F.expr(f"cast(shiftrightunsigned({at}, 6) as int)").alias("at"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("bit"))
        found = each.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.map = np.zeros(1 << self.bits - 6, np.uint64)
        self.map[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Those of ``keys`` that the table may have."""
        at = keys >> np.uint64(64 - self.bits)
        return keys[(self.map[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]


def _asked(group: list[pa.RecordBatch], likely) -> tuple[np.ndarray, np.ndarray]:
    """The different ``likely`` (words and contexts, pairs) of a group's texts, sorted."""
    words, pairs = [likely(np.zeros(1, np.uint64))], [np.zeros(0, np.uint64)]
    for batch in group:
        own, before, _ = _batch_words(batch.column("text"))
        words.append(likely(np.unique(own)))
        pairs.append(likely(np.unique(pair_keys(before, own))))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))


def _message(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, all first bytes before all second ones and so on: shuffles compress the high ones away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(message: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(message, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data`` cut at ``ends`` (bytes, the first of them 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(rows: DataFrame, ratios: DataFrame, n_ratios: int, other: float, finish, schema) -> DataFrame:
    """``_applied`` for a table of any size, which is dealt by ranges of keys.

    Documents are put into groups. Each asks every part of the table for its different words and pairs that the table may have, as
    steps between sorted 64-bit keys, and gets one number back for each of them in that order (two for a word, which may be a context as well; NaN
    where the table has none). So neither documents nor keys are repeated for each document, and no answer carries keys.
    """
    groups = written(rows.mapInArrow(lean(_packed), "g long, rows binary"), "groups")
    likely = rows.sparkSession.sparkContext.broadcast(Likely(ratios, n_ratios))
    parts = max(1, -(-n_ratios // PART_ROWS), -(-groups.count() // PART_GROUPS))

    def ask(batches):
        for batch in batches:
            for g, rows in zip(batch.column("g").to_pylist(), batch.column("rows")):
                asked = _asked(_group(rows.as_py()), likely.value)
                ends = [np.searchsorted((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)) for k in asked]
                some = np.nonzero(sum(map(np.diff, ends)))[0]
                messages = [pa.array([_message(k[e[i] : e[i + 1]]) for i in some], pa.binary()) for k, e in zip(asked, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), g, np.int64)), *messages], ["part", "g", "words", "pairs"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        known = Ratios(*(own[c].to_numpy() for c in ("kind", "key", "ratio")), other)
        out = {}
        for column, kinds in (("words", {"single": WORD, "gap": CONTEXT}), ("pairs", {"full": PAIR})):
            each = list(map(_keys, asked[column].to_pylist()))
            keys, ends = np.concatenate([np.zeros(0, np.uint64), *each]), np.cumsum([0, *map(len, each)]) * 4
            for name, kind in kinds.items():
                has, ratio = known._of(kind, keys)
                out[name] = _binaries(np.where(has, ratio, np.float32(np.nan)).astype(np.float32), ends)
        return pa.table({"g": asked["g"], "part": asked["part"], **out})

    def apply(packed: pa.Table, answers: pa.Table) -> pa.Table:
        group = _group(packed["rows"][0].as_py())
        words, pairs = _asked(group, likely.value)
        answers = answers.sort_by("part")
        found = [(kind, keys, np.frombuffer(b"".join(answers[c].to_pylist()), np.float32)) for kind, keys, c in ((WORD, words, "single"), (CONTEXT, words, "gap"), (PAIR, pairs, "full"))]
        has = [~np.isnan(x) for _, _, x in found]
        known = Ratios(np.concatenate([np.full(h.sum(), k) for h, (k, _, _) in zip(has, found)]), np.concatenate([keys[h] for h, (_, keys, _) in zip(has, found)]), np.concatenate([x[h] for h, (_, _, x) in zip(has, found)]), other)
        return pa.Table.from_batches([finish(batch, _features(known, batch.column("text"))) for batch in group])

    part = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(parts).cast("long"), 32).cast("int")
    dealt = ratios.select(part.alias("part"), "kind", "key", "ratio")
    asked = groups.mapInArrow(lean(ask), "part int, g long, words binary, pairs binary")
    answers = asked.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(answer, "g long, part int, single binary, gap binary, full binary")
    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(apply, schema)


def _applied(rows: DataFrame, ratios: DataFrame, other: float, finish, schema) -> DataFrame:
    """``finish(batch, features)`` of all batches of ``rows`` (text, ...), with the table of ratios broadcast or, where it is large, joined."""
    n_ratios = ratios.count()
    if n_ratios > MOST_ROWS:
        return _joined(rows, ratios, n_ratios, other, finish, schema)
    found = ratios.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(Ratios(*(found[c].to_numpy() for c in ("kind", "key", "ratio")), other))

    def apply(batches):
        for batch in slices(batches):
            yield finish(batch, _features(shared.value, batch.column("text")))

    return rows.mapInArrow(lean(apply), schema)


class Curve:
    """Logistic regression on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(3), np.ones(3))
        z = self._at(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            penalty = np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-9:
                break

    def _at(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.ones(len(s)), s]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._at(x) @ self.w, -30, 30)))


def fold(doc_id):
    """crc32 of the id as text, mod FOLDS; a null id counts as an empty text and so is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, curve, order) of the documents with a label outside the held-out fold. Of contradicting labels the toxic one holds."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("__tq_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where(fold(F.col("__tq_id")) != HELD_OUT).groupBy("__tq_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("__tq_id"), F.col("text").cast("string").alias("text"))
    # The curve takes a share of its fold; what it leaves is counted.
    order = F.xxhash64("__tq_id")
    share = F.lit(MOST_CURVE) / F.lit(max(1, known.where(fold(F.col("__tq_id")) == CURVE).count()))
    curve = (fold(F.col("__tq_id")) == CURVE) & (F.pmod(order, F.lit(1 << 20)) < share * (1 << 20))
    return rows.join(known, "__tq_id").select("text", "toxic", curve.alias("curve"), order.alias("order"))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, Curve]:
    rows = _labelled(docs, labels)
    ratios, other = log_ratios(counted(rows.where(~F.col("curve"))))

    def measured(batch, x):
        return pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column("toxic"), batch.column("order")], ["a", "b", "c", "toxic", "order"])

    curve = _applied(rows.where("curve"), ratios, other, measured, "a double, b double, c double, toxic int, order long")
    found = curve.orderBy("order", "a", "toxic").limit(MOST_CURVE).toArrow()
    x = np.stack([found[c].to_numpy() for c in "abc"], axis=1).reshape(-1, 3)
    return ratios, other, Curve(x, found["toxic"].to_numpy().astype(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) with __tq_score: how likely the toxic label is, from 0 to 1.

    A text without words (null or empty) has a ratio of zero, and so its score
    follows from the curve alone. Null and repeated doc_ids stay as they are.
    Without any labelled row every score is 0.5; an empty table gives an empty one.
    """
    ratios, other, curve = fitted(docs, labels)

    def judged(batch, x):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve(x))], [*batch.schema.names, "__tq_score"])

    schema = docs.withColumn("__tq_score", F.lit(0.0)).schema
    return _applied(docs.withColumn("text", F.col("text").cast("string")), ratios, other, judged, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("__tq_score").alias("score"), (F.col("__tq_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10}
ORACLES: dict[str, str] = {}
