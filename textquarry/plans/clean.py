"""Audit a corpus, report on it, and write it without template-equivalent records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.functions import fixed
from textquarry.operators import audit
from textquarry.sources import files, sinks


def clean_corpus(spark: SparkSession, source: str, out: str, topics=fixed.TOPIC_ALIASES, patterns=fixed.BOILERPLATE) -> dict:
    """From a text corpus to ``out``/report.json, report.md, cleaned and families, in this order; the source stays as it is."""
    records = files.numbered(files.read_records(spark, source)).persist()
    if records.isEmpty():
        raise ValueError(f"no records in {source!r}")
    marked = audit.annotated(records, topics).persist()
    report = audit.report(records, topics, patterns).first().asDict()
    top = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    sinks.write_json(f"{out}/report.json", {"format": fixed.REPORT_FORMAT, "source": source, "figures": report})
    sinks.write_report(report, top(audit.topic_counts(marked), "topic", "n"), top(audit.largest_families(marked), "family_id", "n"), top(audit.repeated_sentences(records), "sentence", "n"), f"{out}/report.md")
    kept: DataFrame = audit.cleaned(marked)
    sinks.write_corpus(kept, f"{out}/cleaned")
    sinks.write_families(kept.select("doc_id", "family_id"), source, f"{out}/families")
    marked.unpersist()
    records.unpersist()
    return report
