"""What several operators need: tables, shared storage, components of a graph."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the white space of the contracts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the master is local (tests on one machine) a temporary
    folder is made and set as the checkpoint folder of the context; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        found = context.getCheckpointDir()
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = found.rsplit("/", 1)[0] if found else "file://" + tempfile.mkdtemp(prefix="textquarry-")
        if not found:
            context.setCheckpointDir(base)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base}/textquarry-{uuid.uuid4().hex}"


#: Rows of a written file, where their number is known before.
ROWS_OF_A_FILE = 1_000_000


def written(df: DataFrame, name: str = "part", rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and what
    follows neither repeats it nor depends on the executors that made it.

    ``rows``, at most so many, keeps small tables out of many files; it is
    given where the last step is light, since that step then runs in as many tasks as there are files.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    out = df if rows is None else df.coalesce(-(-max(rows, 1) // ROWS_OF_A_FILE))
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of at most ``most`` bytes of ``column`` (or one row), so
    that a worker's memory follows the longest text and not how many rows Spark sends at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes + 64, dtype=np.int64) - sizes - 64) // most
        starts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a < b or not batch.num_rows:
                yield batch.slice(a, b - a)


#: What an operator keeps in a worker from task to task: name -> how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Memory that is free in this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _lean(work, own: str | None, batches):
    others = [drop for name, drop in KEPT.items() if name != own]
    for drop in others:
        drop()
    if others:
        _give_back()
    try:
        yield from work(batches)
    finally:
        _give_back()


def lean(work, own: str | None = None):
    """``work`` (batches to batches) for workers that serve other stages before and after: it starts without what other
    operators KEPT (``own`` stays), and what it freed does not stay with the worker. An executor's workers and heap share its memory."""
    return lambda batches: _lean(work, own, batches)


def ascii_lower(column):
    """A-Z only: `lower` where a text is ASCII, else letter by letter."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def connected_components(edges: DataFrame, nodes: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer
    change; each round is written to the shared folder, so the lineage stays
    short. Null ends and loops are dropped. Aggregates have two phases, and what they give is
    written before it is joined, so that joins stand on plain shuffles, which AQE splits: a hub's edges need not meet in one task.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges", nodes)
    before = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", mark[0])
        large = written(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), "large", mark[0])
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", mark[0])
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least).distinct(), "edges", mark[0])
    raise RuntimeError(f"no components after {most_rounds} rounds")
