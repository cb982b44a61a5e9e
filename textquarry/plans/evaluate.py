"""Behavioural evaluation: a benchmark's items joined with answers, scored, and written down as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import fixed, text
from textquarry.operators import scoring
from textquarry.sources import files, sinks

#: What a reviewer looks for on each dimension, on a scale from 0 to 4.
GUIDANCE = {
    "relevance": "whether the answer is about the question",
    "factual_correctness": "whether what it claims is right within the scope of the question",
    "completeness": "whether the expected key facts are there",
    "hallucination": "how much of it has no support",
    "question_following": "whether it is the kind of answer that was asked for",
}
FOUND = ("matched_facts", "topic_terms_found", "requirements_found", "forbidden_claims_found", "unsupported_sentences")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The items of a benchmark file of the current format; raises with all that is wrong with them."""
    head = files.read_json(spark, path)
    if head.get("format") != fixed.BEHAVIORAL_FORMAT:
        raise ValueError(f"unsupported benchmark format {head.get('format')!r}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"questions array<struct<{_fields(scoring.ITEM)}>>").alias("x"))
    items = whole.select(F.explode("x.questions").alias("i")).select("i.*")
    wrong = scoring.violations(items).orderBy("id", "violation").limit(1000).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.id or 'benchmark'}: {r.violation}" for r in wrong))
    return items


def _fields(schema: str) -> str:
    """A table's columns as the fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(" ", 1) for c in _columns(schema)))


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def evaluated(items: DataFrame, answers: DataFrame) -> DataFrame:
    """``items`` with the answer of each (``answers``: id, answer), scored; an item without one has an empty answer."""
    once = answers.groupBy("id").agg(F.min(text.stripped(F.col("answer"))).alias("answer"))
    return scoring.scored(items.join(once, "id", "left").withColumn("answer", F.coalesce("answer", F.lit(""))))


def report(results: DataFrame) -> dict:
    """The report of ``evaluated``: one entry for each item of the benchmark (its size does not grow with a corpus), and the mean of each dimension."""
    each = []
    for r in results.orderBy("id").collect():
        row = r.asDict(recursive=True)
        automatic = {d: row[d] for d in fixed.DIMENSIONS} | {k: row[k] for k in FOUND}
        review = {"required": True, "dimensions": {d: {"scale": "0-4", "guidance": g} for d, g in GUIDANCE.items()}, "scores": None, "notes": ""}
        each.append({k: row[k] for k in ("id", "category", "question", "answer", "expected_key_facts")} | {"automatic": automatic, "manual_review": review})
    means = {r.dimension: {"mean": r["mean"], "count": r["count"]} for r in scoring.summary(results).collect()}
    return {"benchmark_format": fixed.BEHAVIORAL_FORMAT, "question_count": len(each), "results": each, "summary_by_dimension": means}


def evaluate(spark: SparkSession, benchmark: str, answers: str, out: str) -> dict:
    """From a benchmark file and answers (JSON lines of id and answer) to a report at ``out``."""
    given = spark.read.schema("id string, answer string").json(answers)
    found = {"behavioral": report(evaluated(read_benchmark(spark, benchmark), given))}
    sinks.write_json(out, found)
    return found
