"""An extension: splits and exact deduplication over streams. A split hangs on content alone, so it is the same in batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.functions import text
from textquarry.operators.splits import with_split


def read_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def split_stream(docs: DataFrame, **options) -> DataFrame:
    """Stateless: ``docs`` (doc_id, text, ...) with split."""
    return with_split(docs, **options)


def first_seen(docs: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first document of each canonical text within the watermark; state is dropped behind it."""
    return docs.withWatermark(time, late).withColumn("canonical_sha256", F.sha2(text.canonical(F.col("text")), 256)).dropDuplicatesWithinWatermark(["canonical_sha256"])


def write_splits(split: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A folder for each split, written exactly once; ``once`` takes what is there and ends."""
    writer = split.writeStream.format("parquet").partitionBy("split").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
