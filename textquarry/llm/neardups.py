"""Near-duplicate documents by wide SimHash fingerprints, anchor-point covering and an exact check.

The rule: two texts are near duplicates if the Jaccard similarity of their sets
of 5-word shingles is 0.8 or more. Fingerprints of 64 bits are too short for it (such texts differ in
some 10 of 64 bits, as do many that have nothing in common), so a set's fingerprint
has ``WORDS`` * 64 bits here. It is cut into ``PIECES`` pieces of 23 bits, each with the 4,096
words of the binary Golay code as anchors (covering radius 3). A fingerprint is replicated
to all anchors within the radius plus ``EXCESS`` and compared there, in its first ``SCREEN`` * 64 bits, with
those that have their home there. Texts at a similarity of just 0.8 meet in some piece with
probability 0.9996, at 0.85 with 0.99997.

Screened pairs are candidates, not answers. A block returns a spanning forest of its candidates, never all
its pairs, and each edge is checked exactly with the sets of both texts. Where a
candidate fails, other pairs of the same candidate component may still link: those
components alone are compared again by their sets, each text outside of the component's largest confirmed
part with every other, in blocks of bounded size. So within a candidate component no link is lost, whichever edges the forest had.

Texts with equal sets are one class and compared once.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import connected_components, lean, slices, written
from textquarry.llm.simhash import BLOCK, _near, _spread, blocks, gridded

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
#: 64-bit words of a fingerprint, pieces of 23 bits, bits beyond the covering radius, words that are compared.
WORDS, PIECES, EXCESS, SCREEN = 6, 16, 1, 3
#: Bits of SCREEN words in which candidates differ at most: three deviations above what similarity 0.8 gives; sets of under SHORT shingles vary more.
MOST_BITS, MOST_BITS_SHORT, SHORT = 46, 56, 10
#: Sets of a block that is compared exactly, on either side; shingles compared at once.
LEFT, RIGHT, COLUMNS = 256, 1024, 4096
#: Rows up to which chosen texts and edges are broadcast.
MOST_BROADCAST = 500_000
_SPLIT = np.array([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(WORDS)], np.uint64)[:, None]
_OFFSETS = (np.arange(WORDS * 8) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_WORDS = [f"f{k}" for k in range(WORDS)]


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; one of all its words where there are fewer than SHINGLE."""
    words = text.lower().split() if text else ()
    n = len(words)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths)
    starts, ends = (ends - lengths)[: n - SHINGLE + 1].tolist(), (ends - 1)[SHINGLE - 1 :].tolist()
    del words
    parts = map(joined.__getitem__, map(slice, starts, ends))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(starts)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words; a bit is 1 if set in over half of the mixed ``hashes``."""
    counts = np.zeros(WORDS * 8 * 256, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        # Independent bits from one hash: add a constant for each word, then mix (splitmix64).
        x = hashes[None, at : at + (1 << 14)] + _SPLIT
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).T.copy()
        counts += np.bincount((x.view(np.uint8).reshape(len(x), -1) + _OFFSETS).ravel(), minlength=len(counts))
    bits = (counts.reshape(-1, 256).astype(np.float64) @ _BITS).ravel()
    return np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(batches):
    for batch in slices(batches):
        fp, n, words = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            own = shingles(text)
            fp.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            n.append(len(own))
            words.append(wide_fingerprint(own))
        words = np.array(words, np.uint64).reshape(len(fp), WORDS).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *(pa.array(words[:, k]) for k in range(WORDS))], ["doc_id", "tid", "fp", "n", *_WORDS])


def pieces(words: np.ndarray) -> list[np.ndarray]:
    """PIECES arrays of 23 bits each of fingerprints (rows of WORDS words)."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    weights = (1 << np.arange(23)).astype(np.float64)
    return [(bits[:, 23 * k : 23 * (k + 1)] @ weights).astype(np.int64) for k in range(PIECES)]


def _replicated(batches):
    for batch in batches:
        every = np.stack([batch.column(c).to_numpy() for c in _WORDS], axis=1)
        fp, n = batch.column("fp").to_numpy(), batch.column("n").to_numpy()
        for at in range(0, len(fp), 1024):
            part = slice(at, at + 1024)
            rows, keys, home = [], [], []
            for k, piece in enumerate(pieces(np.ascontiguousarray(every[part]).view(np.uint64))):
                for excess in range(EXCESS + 1):
                    row, anchor = _spread(*_near(excess), piece)
                    rows.append(row)
                    keys.append((anchor | k << 12).astype(np.int32))
                    home.append(np.full(len(row), not excess))
            rows = np.concatenate(rows) + at
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[rows]), pa.array(n[rows]), *(pa.array(every[rows, k]) for k in range(SCREEN)), pa.array(np.concatenate(home))], ["key", "fp", "n", *_WORDS[:SCREEN], "home"])


def candidates_of(fp: np.ndarray, n: np.ndarray, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the ``fp`` of a block that join all its candidates.

    Each home names the smallest fp among those that are surely alike, else
    the nearest one; then the nearest pairs between what is still apart.
    """
    nodes, place = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    at_home = np.nonzero(home)[0]
    out = []

    def union(i, j):
        nonlocal label
        out.append(np.stack([i, j]))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                return
            label = new

    step = max(1, (1 << 20) // max(1, len(fp)))
    for start in range(0, len(at_home), step):
        mine = at_home[start : start + step]
        bits = sum(np.bitwise_count(words[mine, k, None] ^ words[None, :, k]).astype(np.int16) for k in range(words.shape[1]))
        small, large = np.minimum(n[mine, None], n[None, :]), np.maximum(n[mine, None], n[None, :])
        near = (bits <= np.where(small < SHORT, MOST_BITS_SHORT, MOST_BITS)) & (small >= SIMILARITY * large - 1e-9) & (place[mine, None] != place[None, :])
        if not near.any():
            continue
        sure = near & (bits <= MOST_BITS // 2)
        rank = np.where(sure, place[None, :], np.where(near, bits.astype(np.int64) + len(nodes), np.iinfo(np.int64).max))
        first = rank.argmin(axis=1)
        some = near[np.arange(len(mine)), first]
        union(place[mine[some]], place[first[some]])
        i, j = np.nonzero(near)
        d, i, j = bits[i, j], place[mine[i]], place[j]
        while True:
            apart = label[i] != label[j]
            i, j, d = i[apart], j[apart], d[apart]
            if not len(i):
                break
            # The nearest pair of each part that is still apart from others.
            low, high = np.minimum(i, j), np.maximum(i, j)
            chosen = []
            for side in (i, j):
                order = np.lexsort((high, low, d, label[side]))
                chosen.append(order[np.r_[True, np.diff(label[side][order]) != 0]])
            chosen = np.unique(np.concatenate(chosen))
            union(i[chosen], j[chosen])
    if not out:
        return nodes[:0], nodes[:0]
    i, j = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
    return nodes[i], nodes[j]


def _met(batches):
    for fp, n, home, *words in blocks(batches, ("fp", "n", "home", *_WORDS[:SCREEN])):
        if len(fp) < 2:
            continue
        a, b = candidates_of(fp, n, np.stack(words, axis=1).view(np.uint64), home)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _lists(each: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*each, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _sets(batches):
    for batch in slices(batches):
        each = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), _lists(each)], ["fp", "hashes"])


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many each of ``left`` shares with each of ``right`` (sorted sets)."""
    flat = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    places = []
    for x, sets in zip(flat, (left, right)):
        at = np.searchsorted(both, x)
        known = both[np.minimum(at, len(both) - 1)] == x if len(both) else np.zeros(len(x), bool)
        rows, at = np.repeat(np.arange(len(sets)), list(map(len, sets)))[known], at[known]
        order = np.argsort(at, kind="stable")
        places.append((rows[order], at[order]))
    for low in range(0, len(both), COLUMNS):
        sides = []
        for (rows, at), sets in zip(places, (left, right)):
            i, j = np.searchsorted(at, (low, low + COLUMNS))
            side = np.zeros((len(sets), min(COLUMNS, len(both) - low)), np.float32)
            side[rows[i:j], at[i:j] - low] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return shared


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places (in left, in right) of all pairs that link."""
    shared = shared_shingles(left, right)
    total = np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :] - shared
    return np.nonzero(shared >= SIMILARITY * total - 1e-6)


def _compared(batches):
    """Edges between parts (``root``) of a candidate component; a block's rows may run over several batches."""

    def block(rows):
        left, right = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not left or not right:
            return
        top: dict[int, int] = {}

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in linked([r[2] for r in left], [r[2] for r in right]))):
            a, b = root(left[i][1]), root(right[j][1])
            if a != b:
                top[b] = a
                out.append((left[i][0], right[j][0]))
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held, last = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "h", "p", "fp", "root", "home")]
        hashes = batch.column("hashes")
        for i, (key, h, p, fp, root, home) in enumerate(zip(*columns)):
            if (key, h, p) != last and held:
                yield from block(held)
                held = []
            last = key, h, p
            held.append((fp, root, hashes[i].values.to_numpy().view(np.uint64).copy(), home))
    if held:
        yield from block(held)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose sets (fp, hashes) are similar enough."""
    first = edges.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("right")), "b")
    both = first.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("left")), "a")
    both = both.select("a", "b", F.size("left").alias("n"), F.size("right").alias("m"), F.size(F.array_intersect("left", "right")).alias("s"))
    return both.where(F.col("s") >= SIMILARITY * (F.col("n") + F.col("m") - F.col("s")) - 1e-6).select("a", "b")


def apart(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, root, home) of the parts that rejected ``edges`` (a, b) lie between: ``key`` names a candidate
    component, ``root`` a confirmed part of it; home: outside of the component's largest part."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
    between = written(between, "between")
    if between.isEmpty():
        return None
    keys = written(connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("key")), "keys")
    inner = roots.select(F.col("node").alias("fp"), "root").unionByName(keys.select(F.col("root").alias("fp"), "root")).distinct()
    members = written(inner.join(keys, "root"), "members")
    largest = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"))
    largest = written(largest.select("key", F.col("most.root").alias("main")), "largest")
    return members.join(largest, "key").select("key", "fp", "root", (F.col("root") != F.col("main")).alias("home"))


def grid_of_sets(members: DataFrame, left: int, right: int) -> DataFrame:
    """Blocks in which every home of a component meets every other member: (key, h, p, fp, root, home)."""
    sizes = written(members.groupBy("key").agg(F.ceil(F.count_if("home") / left).cast("int").alias("hs"), F.ceil(F.count("*") / right).cast("int").alias("ps")), "sizes")
    placed = members.join(sizes, "key")
    own_h, own_p = F.pmod(F.xxhash64("fp"), F.col("hs")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("ps")).cast("int")
    homes = placed.where("home").select("key", own_h.alias("h"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), "fp", "root", "home")
    others = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("h"), own_p.alias("p"), "fp", "root", F.lit(False).alias("home"))
    return homes.unionByName(others)


def near_duplicates(docs: DataFrame, block: int = BLOCK, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links, itself included;
    ``fingerprint`` hashes the set of shingles. Null texts count as empty, and texts without words
    link to each other. Rows with a null doc_id take part; they never name a
    component, and one made of such rows only has a null name. Repeated rows
    stay repeated. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    words = ", ".join(f"{w} long" for w in _WORDS)
    each = written(rows.mapInArrow(lean(_fingerprints), f"doc_id long, tid long, fp long, n int, {words}"), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tid")).alias("text"), *(F.first(c).alias(c) for c in ("n", *_WORDS)))
    distinct = written(distinct, "distinct")
    total = distinct.count()
    screened = ", ".join(f"{w} long" for w in _WORDS[:SCREEN])
    spread = distinct.select("fp", "n", *_WORDS).mapInArrow(lean(_replicated), f"key int, fp long, n int, {screened}, home boolean")
    edges = written(gridded(spread, block).mapInArrow(lean(_met), "a long, b long").distinct(), "candidates")

    # One row of each text that some candidate edge names.
    named = edges.select(F.col("a").alias("fp")).union(edges.select("b")).distinct().join(distinct.select("fp", "text.*"), "fp")
    chosen = _small(written(named.select("fp", F.col("doc_id").alias("__id"), "tid"), "chosen"))
    texts = rows.join(chosen, (rows["tid"] == chosen["tid"]) & rows["doc_id"].eqNullSafe(chosen["__id"])).select("fp", "text")
    sets = written(texts.mapInArrow(lean(_sets), "fp long, hashes array<long>").dropDuplicates(["fp"]), "sets")
    sure = written(confirmed(edges, sets), "confirmed")
    roots = written(connected_components(sure), "roots")
    open_parts = apart(edges, roots)
    if open_parts is not None:
        grid = grid_of_sets(open_parts, left, right).join(sets, "fp").repartition("key", "h", "p").sortWithinPartitions("key", "h", "p")
        more = written(grid.select("key", "h", "p", "fp", "root", "home", "hashes").mapInArrow(lean(_compared), "a long, b long"), "more")
        if not more.isEmpty():
            roots = written(connected_components(sure.unionByName(more)), "roots")

    roots = roots.withColumnRenamed("node", "fp")
    least = distinct.select("fp", "least")
    whole = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = whole.join(first, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return each.select("doc_id", "fp").join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
