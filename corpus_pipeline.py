"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:

1. toxicity: documents judged toxic go;
2. lines: long lines that at least three documents hold stay in the largest doc_id only (``n_chars`` follows the text);
3. copies: of each group of near duplicates (5-word shingles, Jaccard similarity 0.8 or more) the smallest doc_id stays;
4. benchmark: documents that hold a benchmark item go;
5. tokens: SentencePiece ids, checked against the text.

All but the last return the columns of ``documents``. A stage's result is
written as Parquet and read again, so an executor that is lost later costs the
stage it worked on and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, linededup, neardups, sentencepieces, simhash, toxicity
from textquarry.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("__tq_score < 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs)
    changed = F.col("__tq_n_dropped") > 0
    return out.select(*(F.when(changed, F.char_length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, neardups.near_duplicates)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepieces.encoded(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__tq_ids").alias("ids"), F.coalesce(F.size("__tq_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("__tq_round_trip").alias("round_trip"), F.col("__tq_parity").alias("parity"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", to_tokens),
]

#: Model fitting and component search have no form in SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
