"""Audit and conservative cleaning of a corpus: duplicates, template families, topics, boilerplate.

Every operator takes records (doc_id, text, ...), where doc_id gives the order,
and returns a DataFrame. Groups are summed with partial aggregates; what must be chosen from a
group is chosen by an aggregate too, so that a group of any size never meets in one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import fixed, text

BLOCK = ["family_id", "topic"]


def annotated(records: DataFrame, topics=fixed.TOPIC_ALIASES) -> DataFrame:
    """``records`` with canonical, family_id and topic. A text is folded once, and squeezed once, for all three."""
    folded = records.withColumn("__folded", text.folded(F.col("text"))).withColumn("canonical", text.squeezed(F.col("__folded")))
    signed = folded.withColumn("family_id", text.family_id(text.signature_of(F.col("canonical"), topics)))
    return signed.withColumn("topic", text.topic_of(F.col("__folded"), topics)).drop("__folded")


def keyed(marked: DataFrame) -> DataFrame:
    """What choosing and counting need of ``marked``, without the texts: kept (in memory or on disk) once it is computed,
    since masking templates is the dear part and several aggregates follow from it."""
    t = F.col("text")
    own = marked.select("doc_id", *BLOCK, F.size(text.informative_words(t)).alias("n_words"), F.char_length(t).alias("n_chars"), F.octet_length(t).alias("n_bytes"), text.begins_with(F.col("canonical")).alias("begins"))
    return own.persist(StorageLevel.MEMORY_AND_DISK)


def with_preamble(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, begins, ...) with preamble: whether it belongs to the leading run of rows that begin as a preamble does."""
    first = rows.agg(F.min(F.when(~F.coalesce(F.col("begins"), F.lit(False)), F.col("doc_id"))).alias("first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("preamble", F.coalesce(F.col("doc_id") < F.col("first"), F.lit(True))).drop("first")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(canonical_sha256, n, first_id) of canonical texts that several records share."""
    key = F.sha2(text.canonical(F.col("text")), 256).alias("canonical_sha256")
    return records.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def duplicate_summary(records: DataFrame) -> DataFrame:
    return duplicate_groups(records).agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"))


def family_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("family_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def largest_families(marked: DataFrame, most: int = 25) -> DataFrame:
    return family_counts(marked).orderBy(F.desc("n"), "family_id").limit(most)


def topic_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic")


def representatives(rows: DataFrame) -> DataFrame:
    """Of each family and topic of ``rows`` (from ``keyed``) the record with the most informative words, then the longest, then the first:
    (family_id, topic, doc_id, n, n_bytes)."""
    best = F.max(F.struct("n_words", "n_chars", (-F.col("doc_id")).alias("before"), "n_bytes"))
    return rows.groupBy(*BLOCK).agg(best.alias("best"), F.count("*").alias("n")).select(*BLOCK, (-F.col("best.before")).alias("doc_id"), "n", F.col("best.n_bytes").alias("n_bytes"))


def kept(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, family_id, topic, n) of what cleaning keeps of ``rows`` (from ``keyed``): the preamble (with n = 1) and the representatives."""
    parted = with_preamble(rows)
    return parted.where("preamble").select("doc_id", "n_bytes", *BLOCK, F.lit(1).cast("long").alias("n")).unionByName(representatives(parted.where("not preamble")).select("doc_id", "n_bytes", *BLOCK, "n"))


def cleaned(marked: DataFrame) -> DataFrame:
    """The preamble and one representative of each family and topic, unchanged; ``marked`` comes from ``annotated``."""
    return marked.join(kept(keyed(marked)).select("doc_id"), "doc_id", "left_semi").select(*marked.columns)


def removal_summary(marked: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row: records and bytes before, after and removed, and the groups with more than one member."""
    rows = keyed(marked) if rows is None else rows
    size = lambda df, name, *more: df.agg(F.count("*").alias(f"records_{name}"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias(f"bytes_{name}"), *more)
    groups = [F.count_if(F.col("n") > 1).alias("equivalent_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("equivalent_removed")]
    out = size(rows, "before").crossJoin(size(kept(rows), "after", *groups))
    return out.withColumn("bytes_removed", F.col("bytes_before") - F.col("bytes_after"))


def information(records: DataFrame) -> DataFrame:
    """(doc_id, n_words, low) of records outside of the preamble."""
    rows = records.select("doc_id", F.size(text.informative_words(F.col("text"))).alias("n_words"), text.begins_preamble(F.col("text")).alias("begins"))
    return with_preamble(rows).where("not preamble").select("doc_id", "n_words", (F.col("n_words") < fixed.LOW_INFORMATION).alias("low"))


def low_information(records: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` records with little information."""
    return information(records).where("low").orderBy("doc_id").limit(most).select("doc_id", "n_words")


def near_classes(marked: DataFrame) -> DataFrame:
    """Records of a family and topic with the same canonical text, as one: (class_id, n, family_id, topic, canonical); kept once computed."""
    once = marked.groupBy(*BLOCK, "canonical").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    return once.select("class_id", "n", *BLOCK, "canonical").persist(StorageLevel.MEMORY_AND_DISK)


def near_pairs(classes: DataFrame, threshold: float = fixed.NEAR_DUPLICATE) -> DataFrame:
    """(left_id, right_id, n_left, n_right, jaccard): pairs of classes within a family and topic that reach ``threshold``.

    A set-similarity join; classes alone in their family and topic stay out. Hashes of shingles are ordered
    from rare to frequent; two sets that are alike share one among their first (size - ceil(threshold * size) + 1),
    and only these meet, where the sizes allow it. Candidates are then compared exactly.
    """
    several = classes.groupBy(*BLOCK).agg(F.count("*").alias("c")).where("c > 1")
    classes = classes.join(several, BLOCK, "left_semi")
    hashes = F.array_distinct(F.transform(text.shingles(F.col("canonical")), lambda s: F.xxhash64(s)))
    classes = classes.select("class_id", "n", *BLOCK, hashes.alias("hashes")).persist(StorageLevel.MEMORY_AND_DISK)
    each = classes.select("class_id", F.explode("hashes").alias("hash"))
    counted = each.join(each.groupBy("hash").agg(F.count("*").alias("f")), "hash")
    ranked = counted.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("f", "hash"))).alias("r"))
    size = F.size("r")
    prefix = F.slice("r", F.lit(1), (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))
    heads = classes.select("class_id", *BLOCK).join(ranked, "class_id").select("class_id", *BLOCK, size.alias("size"), F.explode(prefix).alias("h")).select("class_id", *BLOCK, "size", "h.hash")
    a, b = heads.alias("a"), heads.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*BLOCK, "hash")]
    fits = (F.col("a.size") >= threshold * F.col("b.size")) & (F.col("b.size") >= threshold * F.col("a.size"))
    met = a.join(b, [*on, F.col("a.class_id") < F.col("b.class_id"), fits]).select(F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id")).distinct()
    side = lambda name: classes.select(F.col("class_id").alias(f"{name}_id"), F.col("n").alias(f"n_{name}"), F.col("hashes").alias(f"{name}_h"))
    pairs = met.join(side("left"), "left_id").join(side("right"), "right_id")
    pairs = pairs.withColumn("jaccard", text.jaccard(F.col("left_h"), F.col("right_h")))
    return pairs.where(F.col("jaccard") >= threshold).select("left_id", "right_id", "n_left", "n_right", "jaccard")


def near_summary(marked: DataFrame, threshold: float = fixed.NEAR_DUPLICATE) -> DataFrame:
    """One row: pairs of near-duplicate records and records in such pairs. Copies are counted by their classes, never paired up."""
    classes = near_classes(marked)
    pairs = near_pairs(classes, threshold)
    within = classes.where("n > 1").agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("w"))
    across = pairs.agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).alias("a"))
    linked = pairs.select(F.col("left_id").alias("class_id")).union(pairs.select("right_id")).union(classes.where("n > 1").select("class_id")).distinct()
    members = classes.join(linked, "class_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"))
    return within.crossJoin(across).crossJoin(members).select((F.col("w") + F.col("a")).alias("pair_count"), "record_count")


def sentence_counts(records: DataFrame) -> DataFrame:
    """(sentence, n, first_id, first_at): how often each canonical sentence stands, and where first."""
    each = records.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))
    found = each.groupBy("sentence").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    return found.select("sentence", "n", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at"))


def repeated_sentences(records: DataFrame, most: int = fixed.TOP_SENTENCES, least: int = fixed.REPEATED_SENTENCE) -> DataFrame:
    """Of the ``most`` frequent sentences (earlier ones first among equals) those that stand ``least`` times or more."""
    return sentence_counts(records).orderBy(F.desc("n"), "first_id", "first_at").limit(most).where(F.col("n") >= least).select("sentence", "n")


def boilerplate_counts(records: DataFrame, patterns=fixed.BOILERPLATE) -> DataFrame:
    """(label, n): matches of each pattern in all records."""
    sums = records.agg(*(F.coalesce(F.sum(text.boilerplate_count(F.col("text"), p)), F.lit(0)).cast("long").alias(f"n{i}") for i, (_, p) in enumerate(patterns)))
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"n{i}").alias("n")) for i, (label, _) in enumerate(patterns)))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def _repeated(found: DataFrame, value: str) -> DataFrame:
    return found.groupBy(value).agg(F.count("*").alias("n"))


def answer_counts(records: DataFrame) -> DataFrame:
    return _repeated(records.select(F.explode(text.assistant_spans(F.col("text"))).alias("answer")), "answer")


def variation_counts(records: DataFrame, topics=fixed.TOPIC_ALIASES) -> DataFrame:
    found = records.select(text.variation_signature(F.col("text"), topics).alias("structure"))
    return _repeated(found.where("structure is not null"), "structure")


def repetition(counts: DataFrame) -> DataFrame:
    """One row (groups, occurrences) of what stands more than once."""
    return counts.where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


def report(records: DataFrame, topics=fixed.TOPIC_ALIASES, patterns=fixed.BOILERPLATE) -> DataFrame:
    """The audit as one row; every part is an aggregate of one row, so joining them moves nothing."""
    marked = annotated(records, topics)
    rows = keyed(marked)
    name = lambda df, **to: df.select(*(F.col(c).alias(t) for c, t in to.items()))
    families = rows.agg(F.count_distinct("family_id").alias("families_before")).crossJoin(kept(rows).agg(F.count_distinct("family_id").alias("families_after")))
    counts = boilerplate_counts(records, patterns).agg(F.sum("n").alias("boilerplate_matches"))
    low = with_preamble(rows).where("not preamble").agg(F.count_if(F.col("n_words") < fixed.LOW_INFORMATION).alias("low_information"))
    out = removal_summary(marked, rows).crossJoin(duplicate_summary(records)).crossJoin(families)
    out = out.crossJoin(name(near_summary(marked), pair_count="near_pairs", record_count="near_records"))
    out = out.crossJoin(name(repetition(answer_counts(records)), groups="repeated_answers", occurrences="repeated_answer_occurrences"))
    out = out.crossJoin(name(repetition(variation_counts(records, topics)), groups="repeated_variations", occurrences="repeated_variation_occurrences"))
    return out.crossJoin(counts).crossJoin(low)


def family_members(marked: DataFrame) -> DataFrame:
    """(family_id, document_indices, document_count); indices in order. The artifact lists every member, so a list is as long as its family."""
    return marked.groupBy("family_id").agg(F.array_sort(F.collect_list("doc_id")).alias("document_indices"), F.count("*").alias("document_count"))


def masked(column: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    return text.family_id(text.signature(column, topics))
