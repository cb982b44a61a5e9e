"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into three pieces of 21, 21 and 22 bits. The
anchors of a piece are the 4,096 words of the binary Golay code of length 23
(a piece is padded with zero bits): a perfect code, so every piece has exactly
one anchor within the covering radius 3, its home. Two fingerprints that
differ in at most 4 bits differ in at most 1 bit of some piece, so the home of
one lies within 3 + 1 bits of the other. Each fingerprint is therefore
replicated to every anchor within radius plus threshold, 6.3 of 4,096 on
average, and compared there with those that have their home there. For very
many fingerprints anchors of two pieces are joined (16.8 million anchors; two
of three pieces differ in at most 2 bits together), which finds the same links.

Equal fingerprints are compared once. An anchor with many fingerprints is cut
into a grid of blocks, each of bounded size. A block returns the edges of a
spanning forest of its links, never all its pairs; components follow from these.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import connected_components, slices, table, written

SEED, SHINGLE, MOST_BITS = 42, 4, 4
RADIUS, SHIFTS, WIDTHS = 3, (0, 21, 42), (21, 21, 22)
#: Generator polynomial of the Golay code (fixed value).
GOLAY = 0b110001110101
#: Fingerprints of a block, on either side.
BLOCK = 4096
#: Above so many distinct fingerprints, anchors of two pieces are used.
ONE_PIECE_UP_TO = 20_000_000
#: Rows of the table of crowded anchors up to which it is broadcast.
MOST_BROADCAST = 100_000
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text; no words (or null): zero."""
    words = text.lower().split() if text else ()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths)
    starts, ends = (ends - lengths)[: n - SHINGLE + 1].tolist(), (ends - 1)[SHINGLE - 1 :].tolist()
    del words
    counts, total = np.zeros((8, 256), np.int64), n - SHINGLE + 1
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        shingles = [joined[i:j] for i, j in zip(starts[at:to], ends[at:to])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, to - at)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    set_in = (counts @ _BITS).ravel()
    return int(np.packbits(2 * set_in > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary())
        out = np.fromiter(map(fingerprint, texts.to_pylist()), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials divided by GOLAY."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << bit - 11), words)
    return words


@lru_cache(maxsize=4)
def _near(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (starts, patterns): the patterns of RADIUS + ``excess`` bits, or up to RADIUS at excess 0."""
    weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
    words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(23), w)], np.int64)
    syndromes = _remainders(words)
    order = np.argsort(syndromes, kind="stable")
    return np.searchsorted(syndromes[order], np.arange((1 << 11) + 1)), words[order]


def _spread(starts: np.ndarray, patterns: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all ``pieces``."""
    syndromes = _remainders(pieces)
    sizes = starts[syndromes + 1] - starts[syndromes]
    rows = np.repeat(np.arange(len(pieces)), sizes)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, (pieces[rows] ^ patterns[starts[syndromes][rows] + within]) >> 11


def anchors(fps: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, whether it is a home) of all fingerprints (uint64)."""
    pieces = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    by = [_near(e) for e in range(3 if joined else 2)]
    out = []
    if not joined:
        for k, piece in enumerate(pieces):
            for excess in (0, 1):
                rows, anchor = _spread(*by[excess], piece)
                out.append((rows, anchor | k << 12, np.full(len(rows), not excess)))
    else:
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            for e1 in range(3):
                rows, first = _spread(*by[e1], pieces[i])
                for e2 in range(3 - e1):
                    again, second = _spread(*by[e2], pieces[j][rows])
                    out.append((rows[again], first[again] << 12 | second | k << 24, np.full(len(again), not e1 + e2)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _replicated(joined: bool):
    def replicate(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, key, home = anchors(part.view(np.uint64), joined)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows]), pa.array(home)], ["key", "fp", "home"])

    return replicate


def forest(homes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between ``homes`` and ``others`` (uint64)."""
    nodes = np.unique(np.concatenate([homes, others]))
    label = np.arange(len(nodes))
    left, right = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    found = []
    step = max(1, (1 << 21) // max(1, len(others)))
    for at in range(0, len(homes), step):
        i, j = np.nonzero(np.bitwise_count(homes[at : at + step, None] ^ others[None, :]) <= MOST_BITS)
        i, j = left[i + at], right[j]
        keep = i != j
        if keep.any():
            found.append(np.unique(np.minimum(i, j)[keep] * len(nodes) + np.maximum(i, j)[keep]))
    if not found:
        return nodes[:0], nodes[:0]
    i, j = np.divmod(np.unique(np.concatenate(found)), len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[at], nodes[label[at]]


def blocks(batches, columns):
    """The values of ``columns`` (arrays) of each block: rows come sorted by (key, h, p), and a block's rows may run over several batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "h", "p")])
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if last is not None and tuple(key[:, i]) != last:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            last = tuple(key[:, i])
            held.append([a[i:j] for a in arrays])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _compared(batches):
    for fps, home in blocks(batches, ("fp", "home")):
        fps = fps.view(np.uint64)
        a, b = forest(fps[home], fps)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def gridded(spread: DataFrame, block: int) -> DataFrame:
    """``spread`` (key, fp, home, ...) with (h, p) in place of a key alone, dealt and sorted by (key, h, p).

    A key's homes are dealt over its h and all its rows over its p, so that no block has more than about ``block``
    rows on either side and every home meets every row once.
    """
    own = [c for c in spread.columns if c not in ("key", "home")]
    sizes = spread.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where((F.col("n") > block) & (F.col("homes") > 0))
    crowded = written(sizes.select("key", F.ceil(F.col("homes") / block).cast("int").alias("hs"), F.ceil(F.col("n") / block).cast("int").alias("ps")), "crowded")
    if crowded.count() <= MOST_BROADCAST:
        crowded = F.broadcast(crowded)
    spread = spread.join(crowded, "key", "left").withColumns({"hs": F.coalesce("hs", F.lit(1)), "ps": F.coalesce("ps", F.lit(1))})
    own_h, own_p = F.pmod(F.xxhash64("fp"), F.col("hs")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("ps")).cast("int")
    one = spread.where("hs = 1 and ps = 1").select("key", F.lit(0).alias("h"), F.lit(0).alias("p"), *own, "home")
    many = spread.where("hs > 1 or ps > 1")
    # A home goes to its row of the grid as a home; every fingerprint goes to its column as an other.
    rows = many.where("home").select("key", own_h.alias("h"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), *own, "home")
    columns = many.select("key", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("h"), own_p.alias("p"), *own, F.lit(False).alias("home"))
    return one.unionByName(rows).unionByName(columns).repartition("key", "h", "p").sortWithinPartitions("key", "h", "p")


def links(fps: DataFrame, joined: bool, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fps`` (fp); they join all that link."""
    spread = fps.mapInArrow(_replicated(joined), "key long, fp long, home boolean")
    return gridded(spread, block).mapInArrow(_compared, "a long, b long")


def near_duplicates(docs: DataFrame, joined: bool | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links of at most 4
    bits, itself included. Null or empty texts have fingerprint zero and link
    like any other. Rows with a null doc_id take part; they never name a
    component, and one made of such rows only has a null name. Repeated rows
    stay repeated. Other columns are ignored; an empty table gives none.
    """
    each = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    total = distinct.count()
    if joined is None:
        joined = total > ONE_PIECE_UP_TO
    roots = connected_components(links(distinct.select("fp"), joined, block), total).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(linked, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return each.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, labelled=near_duplicates) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, as ``labelled`` finds them: its smallest doc_id.

    Of rows that repeat a doc_id and of a group without any doc_id, one row
    stays (the smallest text). Columns stay as they are.
    """
    kept = written(labelled(docs), "components", docs.count())
    chosen = kept.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__tq_id")).agg(F.count("*").alias("__tq_n"))
    nameless = kept.where("component_id is null").select("fingerprint").distinct()
    once = docs.join(chosen.hint("shuffle_hash"), docs["doc_id"].cast("long") == chosen["__tq_id"], "left_semi")
    if not chosen.where("__tq_n > 1").isEmpty():
        once = _least_row(once, "doc_id")
    if nameless.isEmpty():
        return once
    # A group without names is one in which no row has a doc_id: rare, and never joined with the rest.
    texts = docs.where(F.col("doc_id").isNull())
    own = labelled(texts.select(F.xxhash64("text").alias("doc_id"), "text"))
    own = own.where("doc_id = component_id").join(nameless, "fingerprint", "left_semi").select(F.col("doc_id").alias("__tq_id")).distinct()
    return once.unionByName(_least_row(texts.join(own, F.xxhash64(texts["text"]) == own["__tq_id"], "left_semi"), "text"))


def _least_row(docs: DataFrame, key: str) -> DataFrame:
    """Of the rows that share ``key`` the smallest, by text and then the other columns."""
    order = ["text", *(c for c in docs.columns if c != "text")]
    return docs.groupBy(F.col(key).alias("__tq_key")).agg(F.min(F.struct(*order)).alias("__tq_row")).select(*(F.col("__tq_row")[c].alias(c) for c in docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_dedup": op1}
ORACLES: dict[str, str] = {}
