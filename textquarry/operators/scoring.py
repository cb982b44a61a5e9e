"""Answers scored on five separate dimensions by what they contain; there is no total on purpose.

Items are nested rows: id, category, question, topic_terms, question_requirements,
expected_key_facts (fact, aliases), acceptable_concepts, important_incorrect_concepts and forbidden_claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import fixed, text
from textquarry.functions.maths import ratio

ITEM = """id string, category string, question string, topic_terms array<string>, question_requirements array<string>,
expected_key_facts array<struct<fact: string, aliases: array<string>>>, acceptable_concepts array<string>,
important_incorrect_concepts array<string>, forbidden_claims array<string>"""
_STRINGS = "array<string>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_STRINGS))


def _held(terms: Column, answer: Column) -> Column:
    return text.let(answer, lambda a: F.filter(terms, lambda t: F.contains(a, text.lowered(t))))


def scored(answers: DataFrame) -> DataFrame:
    """``answers`` (an item's columns and answer) with the five dimensions and what was found for each."""
    answer = text.lowered(F.col("answer"))
    facts = F.col("expected_key_facts")
    n_facts = F.size(facts)
    matched = text.let(answer, lambda x: F.filter(facts, lambda f: F.exists(f["aliases"], lambda a: F.contains(x, text.lowered(a)))))
    terms, needs, claims = _list("topic_terms"), _list("question_requirements"), _list("forbidden_claims")
    anchors = F.concat(terms, F.flatten(F.transform(facts, lambda f: f["aliases"])), F.array(*map(F.lit, fixed.ANCHORS)))
    found = answers.withColumn("__anchors", F.transform(anchors, text.lowered))
    parts = F.filter(F.transform(F.split("answer", "[.!?]+", -1), text.stripped), lambda s: s != "")
    loose = F.filter(parts, lambda s: (F.size(F.split(text.squeezed(s), " ", -1)) >= fixed.JUDGED_WORDS) & ~text.let(text.lowered(s), lambda low: F.exists("__anchors", lambda a: F.contains(low, a))))
    out = found.withColumns({
        "matched_facts": F.size(matched),
        "topic_terms_found": _held(terms, answer),
        "requirements_found": _held(needs, answer),
        "forbidden_claims_found": _held(claims, answer),
        "unsupported_sentences": loose,
        "__sentences": F.size(parts),
    })
    coverage = ratio(F.col("matched_facts"), n_facts)
    return out.withColumns({
        "relevance": F.least(ratio(F.size("topic_terms_found"), F.size(terms)), F.lit(1.0)),
        "factual_correctness": F.greatest(F.lit(0.0), coverage - ratio(F.size("forbidden_claims_found"), n_facts)),
        "completeness": coverage,
        "hallucination": ratio(F.size("unsupported_sentences"), F.col("__sentences")),
        "question_following": ratio(F.size("requirements_found"), F.size(needs)),
    }).drop("__anchors", "__sentences")


def summary(results: DataFrame) -> DataFrame:
    """(dimension, mean, count); without results every mean is 0."""
    sums = results.agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in fixed.DIMENSIONS))
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(0.0)).alias("mean"), F.col("n").alias("count")) for d in fixed.DIMENSIONS))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def violations(items: DataFrame) -> DataFrame:
    """(id, violation): what is wrong with a benchmark's items, and the categories that none has (without id)."""
    missing = lambda c: F.col(c).isNull() | (F.size(c) < 1)
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = {
        "no id or question": blank("id") | blank("question"),
        "unsupported category": ~F.coalesce(F.col("category").isin(*fixed.BEHAVIORAL_CATEGORIES), F.lit(False)),
        "no topic terms or requirements": missing("topic_terms") | missing("question_requirements"),
        "no key facts": missing("expected_key_facts"),
        "no acceptable concepts": missing("acceptable_concepts"),
        "no important incorrect concepts": missing("important_incorrect_concepts"),
        "incomplete key fact": F.coalesce(F.exists("expected_key_facts", lambda f: f["fact"].isNull() | (f["fact"] == "") | f["aliases"].isNull()), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    own = items.select("id", F.explode(found).alias("violation"))
    known = items.sparkSession.createDataFrame([(c,) for c in fixed.BEHAVIORAL_CATEGORIES], "category string")
    absent = known.join(items.select("category").distinct(), "category", "left_anti")
    return own.unionByName(absent.select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("missing category: "), "category").alias("violation")))
