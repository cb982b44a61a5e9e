"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are cut into two halves and each half is quantised by itself, so K
centroids a half make K * K cells. For a query both halves are compared with
their centroids; a heap then walks the pairs of centroids in order of their
summed nearness until the cells visited hold a certain share of all vectors. Their entries
are reranked with the exact inner product in double precision.

The share is measured, not set: for ``PROBES`` vectors of the sample that fits the codebooks, the walk
tells how much has to be visited until the cells of their true nearest vectors of the sample have come; the
share is what suffices for a recall of ``RECALL`` there. Clustered vectors do with little; random ones, without
clusters, leave no choice but about half of all entries. visit=1 searches exactly.

Equal vectors form one class that is indexed and compared once; a class
knows its smallest ids, as many as an answer can hold. The cells of some
neighbouring first-half centroids make a group; a group is cut into blocks of bounded size, and so are the
queries, whatever one cell holds. A query visits a group once, with a bit for each of its cells.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import table, written

NEAREST = 20
#: Recall that the share visited is chosen for, on so many vectors of the sample.
RECALL, PROBES = 0.97, 200
#: Centroids of a half: four times the fourth root of the number of vectors, so that cells grow with its square root, within bounds.
FEWEST, MOST = 8, 1024
#: Vectors on which the codebooks are fitted, at most; every vector is indexed.
SAMPLE, ROUNDS = 20_000, 12
#: First-half centroids of a group; vectors and queries of a block.
WIDE, VECTORS, QUERIES_AT_ONCE = 4, 32_768, 8_192
KEY = ["h1", "h2"]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2), once each: neither null nor zero, all components finite, and as long as most are (of equally many the longer)."""
    e = F.col("embedding")
    whole = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("embedding") == (lengths.n if lengths else 0))
    return rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(h1, h2, embedding, members): the ``most`` smallest ids of each class, in order. No class is gathered whole."""
    first = Window.partitionBy(*KEY).orderBy("vec_id")
    distinct = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= most)
    return distinct.groupBy(*KEY).agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_set("vec_id")).alias("members"))


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means centroids (fewer if there are fewer different rows), from the first different rows on."""
    _, at = np.unique(x, axis=0, return_index=True)
    centroids = x[np.sort(at)[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centroids)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


class Index:
    """Codebooks and the number of entries of each cell."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)
        self.counts = np.zeros((len(self.first), len(self.second)), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.half], self.first), _nearest(x[:, self.half :], self.second)

    def walk(self, query: np.ndarray, wanted: int):
        """Pairs of centroids by falling sum of inner products, until their cells hold ``wanted`` entries."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        i_order, j_order = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[i_order].tolist(), b[j_order].tolist()
        heap, seen, held = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            held += int(self.counts[i_order[i], j_order[j]])
            yield i_order[i], j_order[j]
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(a[i] + b[j]), i, j))


def centroids_of(n: int) -> int:
    return int(min(MOST, max(FEWEST, round(4 * n**0.25))))


def needed_share(index: Index, sample: np.ndarray, nearest: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """The share of all entries to visit for ``recall`` of the ``nearest`` in the sample, asked by rows spread over it."""
    asking = np.unique(np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype(np.int64))
    i, j = index.cells(sample)
    needed, total = [], max(1, int(index.counts.sum()))
    for row in asking:
        score = sample @ sample[row]
        score[row] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(nearest, len(sample) - 1)]
        reached, held = np.full(index.counts.shape, total), 0
        for a, b in index.walk(sample[row], total):
            held += int(index.counts[a, b])
            reached[a, b] = held
        needed.append(reached[i[best], j[best]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    return float(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))] / total) if len(needed) else 1.0


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, centroids: int | None = None, visit: float | None = None, sample: int = SAMPLE, vector_block: int = VECTORS, query_block: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, embedding) the nearest rows of
    ``vectors`` but for those of its own vec_id, largest inner product first, ties to the smaller vec_id.

    ``centroids`` of a half and the share of entries to ``visit`` follow from the vectors unless given.
    Vectors null, zero, of another length than most or with null or non-finite
    components take no part on either side, nor do null ids. Repeated rows
    count once; ids with several vectors take part with each: as a query such an id has one answer, in which each
    other id stands once, with the largest product of any of their vectors. Fewer than ``nearest`` rows come where there are fewer
    candidates. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(valid(vectors), "valid")
    asking = written(valid(queries), "asking")
    # Entries of an answer before the query's own id is taken out, however many vectors that has.
    own = rows.join(asking.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", *KEY).distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    several = own > 1 or asking.select("vec_id", *KEY).distinct().groupBy("vec_id").count().where("count > 1").count() > 0
    most = nearest + own
    every = written(classes(rows, most), "classes")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = every.orderBy(F.xxhash64(*KEY, F.lit(7)), *KEY).limit(sample).select("embedding").toArrow()
    x = _matrix(fit["embedding"])
    if not len(x):
        return empty
    index = Index(x, centroids or centroids_of(every.count()))
    shared = spark.sparkContext.broadcast(index)
    k2 = len(index.second)

    def assigned(batches):
        for batch in batches:
            i, j = shared.value.cells(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((i // WIDE).astype(np.int32)), pa.array((i % WIDE * k2 + j).astype(np.int32)), pa.array((i * k2 + j).astype(np.int32))], [*batch.schema.names, "g", "cell", "whole"])

    placed = written(every.mapInArrow(assigned, f"h1 long, h2 long, embedding {dict(every.dtypes)['embedding']}, members array<long>, g int, cell int, whole int"), "placed")
    for r in placed.groupBy("whole").count().collect():  # at most centroids ** 2 rows
        index.counts[divmod(r["whole"], k2)] = r["count"]
    total = int(index.counts.sum())
    groups = math.ceil(len(index.first) / WIDE)
    held = [int(index.counts[g * WIDE : (g + 1) * WIDE].sum()) for g in range(groups)]
    blocks = [max(1, math.ceil(n / vector_block)) for n in held]
    asked = asking.select(*KEY).distinct().join(every.select(*KEY, "embedding"), KEY)
    foreign = asking.join(every.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.first("embedding").alias("embedding"))
    asked = written(asked.unionByName(foreign), "asked")
    query_blocks = max(1, math.ceil(asked.count() / query_block))
    share = needed_share(index, x, nearest) if visit is None else visit
    shared_index = spark.sparkContext.broadcast((index, blocks, min(total, max(math.ceil(share * total), most))))

    def visiting(batches):
        index, blocks, wanted = shared_index.value
        for batch in batches:
            x, out = _matrix(batch.column("embedding")), []
            for row, q in enumerate(x):
                bits = np.zeros((len(blocks), WIDE * k2), bool)
                for i, j in index.walk(q, wanted):
                    bits[i // WIDE, i % WIDE * k2 + j] = True
                for g in np.nonzero(bits.any(axis=1))[0].tolist():
                    packed = np.packbits(bits[g]).tobytes()
                    out += [(row, g, b, packed) for b in range(blocks[g])]
            at = pa.array([o[0] for o in out], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*KEY, "embedding")), *(pa.array([o[n] for o in out], kind) for n, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary())))], [*KEY, "embedding", "g", "b", "cells"])

    kind = dict(asked.dtypes)["embedding"]
    asks = asked.mapInArrow(visiting, f"h1 long, h2 long, embedding {kind}, g int, b int, cells binary").withColumn("p", F.pmod(F.xxhash64(*KEY, F.lit(3)), F.lit(query_blocks)).cast("int"))
    per_group = F.element_at(F.array(*map(F.lit, blocks)), F.col("g") + 1)
    entries = placed.withColumn("b", F.pmod(F.xxhash64(*KEY, F.lit(5)), per_group).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).drop("whole")

    def reranked(_, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        q, x = _matrix(ours["embedding"]), _matrix(theirs["embedding"])
        shape = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("members", pa.list_(pa.int64()))])
        if not len(q) or not len(x):
            return shape.empty_table()
        cell = theirs["cell"].to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(ours["cells"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1).astype(bool)
        rows, cols = [], []
        step = max(1, (1 << 21) // len(x))
        for at in range(0, len(q), step):
            near = np.where(bits[at : at + step][:, cell], q[at : at + step] @ x.T, -np.inf)
            if len(x) > most:
                # Rounding of the product may not part equal scores: all that come near the last place are looked at again.
                last = np.partition(near, len(x) - most, axis=1)[:, len(x) - most]
                near[near < (last - 1e-9 * np.abs(last))[:, None]] = -np.inf
            i, j = np.nonzero(near > -np.inf)
            rows.append(i + at)
            cols.append(j)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        exact = np.concatenate([(q[rows[a : a + 65536]] * x[cols[a : a + 65536]]).sum(axis=1) for a in range(0, max(1, len(rows)), 65536)])
        least = np.array([m[0] for m in theirs["members"].to_pylist()], np.int64)
        order = np.lexsort((least[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < most
        rows, cols, exact = pa.array(rows[keep]), pa.array(cols[keep]), exact[keep]
        return pa.table([ours["h1"].combine_chunks().take(rows), ours["h2"].combine_chunks().take(rows), pa.array(exact), theirs["members"].combine_chunks().take(cols)], schema=shape)

    on = ["g", "b", "p"]
    found = asks.groupBy(*on).cogroup(entries.groupBy(*on)).applyInArrow(reranked, "h1 long, h2 long, score double, members array<long>")
    best = Window.partitionBy(*KEY).orderBy(F.desc("score"), F.col("members")[0])
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    answers = found.groupBy(*KEY).agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("v")))))), 1, most).alias("answers"))
    out = asking.select(*KEY, F.col("vec_id").alias("query_id")).distinct().join(answers, KEY)
    if several:
        # Ids with several vectors: one answer for each id, each other id once.
        each = out.select("query_id", F.explode("answers").alias("a")).where(F.col("a.v") != F.col("query_id")).groupBy("query_id", F.col("a.v").alias("vec_id")).agg(F.min("a.s").alias("s"))
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "vec_id"))).where(F.col("rank") <= nearest)
        return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("s")).alias("score"))
    others = F.slice(F.filter("answers", lambda a: a["v"] != F.col("query_id")), 1, nearest)
    return out.select("query_id", F.posexplode(others).alias("at", "a")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("a.v").alias("vec_id"), (-F.col("a.s")).alias("score"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op4_multi_index": op4}
ORACLES: dict[str, str] = {}
