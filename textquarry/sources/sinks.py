"""Writers. Large results go out through Spark's commit protocol; small ones as one file, put in place when whole."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import fixed
from textquarry.operators.subwords import Vocabulary


def write_whole(path: str, data: str | bytes) -> None:
    """A driver-side file, seen by others only when it is complete."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".partial", "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".partial", path)


def write_json(path: str, value: dict) -> None:
    write_whole(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def write_corpus(records: DataFrame, path: str, single: bool = False) -> None:
    """Records as text in doc_id order, an empty line after each; part files in order, or one file."""
    ordered = records.orderBy("doc_id").select("text")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path, lineSep="\n\n")


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON lines of category, question and answer only."""
    examples.select("category", "question", "answer").write.mode("overwrite").json(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """(split, doc_id, start, tokens) as Parquet, a folder for each split."""
    tokens.write.mode("overwrite").partitionBy("split").parquet(path)


def write_token_file(tokens: DataFrame, path: str, dtype: str = "uint16") -> int:
    """One split's tokens in doc_id order as one flat file; partitions pass the driver one by one. Returns the number of tokens."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    written = 0
    with open(path + ".partial", "wb") as f:
        for row in tokens.orderBy("doc_id").select("tokens").toLocalIterator():
            f.write(np.asarray(row.tokens, np.dtype(dtype).newbyteorder("<")).tobytes())
            written += len(row.tokens)
    os.replace(path + ".partial", path)
    return written


def write_vocabulary(vocabulary: Vocabulary, path: str) -> None:
    write_whole(path, vocabulary.to_json())


def write_families(marked: DataFrame, source: str, path: str) -> None:
    """The family manifest of ``marked`` (doc_id, family_id), as one JSON row written by Spark."""
    from textquarry.operators.audit import family_members

    families = family_members(marked)
    each = marked.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "family_id"))), lambda x: x["family_id"]).alias("document_families"), F.count("*").alias("document_count"), F.count_distinct("family_id").alias("family_count"))
    listed = families.agg(F.array_sort(F.collect_list(F.struct("family_id", "document_indices", "document_count"))).alias("families"))
    out = each.crossJoin(listed).select(F.lit(fixed.FAMILIES_FORMAT).alias("format"), F.lit(source).alias("source_path"), "document_count", "family_count", "document_families", "families")
    out.coalesce(1).write.mode("overwrite").json(path)


def _lines(report: dict, topics: list, families: list, sentences: list) -> Iterator[str]:
    yield "# Corpus quality report\n"
    yield "| Figure | Value |\n|---|---:|"
    for key, value in report.items():
        yield f"| {key.replace('_', ' ')} | {value:,} |"
    for title, head, rows in (("Topics", "Topic", topics), ("Largest template families", "Family", families), ("Repeated sentences", "Sentence", sentences)):
        yield f"\n## {title}\n\n| {head} | Records |\n|---|---:|"
        for name, n in rows:
            yield f"| {str(name).replace('|', chr(92) + '|')} | {n:,} |"


def write_report(report: dict, topics: list, families: list, sentences: list, path: str) -> None:
    """A Markdown report of aggregated rows."""
    write_whole(path, "\n".join(_lines(report, topics, families, sentences)) + "\n")
