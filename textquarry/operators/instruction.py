"""Instruction examples: pairs, splits, role templates, label masks and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import fixed, hashing, text
from textquarry.functions.running import running
from textquarry.operators.subwords import Vocabulary, encoded


def from_conversations(turns: DataFrame, category: str = "conversation") -> DataFrame:
    """(conv_id, turn, category, question, answer) of each user turn that an assistant turn follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.withColumn("answer", F.lead("text").over(order)).withColumn("next", F.lead("role").over(order))
    return after.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.lit(category).alias("category"), F.col("text").alias("question"), "answer")


def transcripts(turns: DataFrame) -> DataFrame:
    """(doc_id, text): each conversation as one line, ``User: ... Assistant: ...``."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), " ").alias("text"))


def with_split(examples: DataFrame, seed: int = fixed.SPLIT_SEED, validation: float = fixed.INSTRUCTION_VALIDATION_RATIO) -> DataFrame:
    if not 0 < validation < 1:
        raise ValueError("the validation share lies between 0 and 1")
    return examples.withColumn("split", hashing.instruction_split(F.col("category"), F.col("question"), F.col("answer"), seed, validation))


def with_templates(examples: DataFrame) -> DataFrame:
    return examples.withColumn("conversation", text.conversation(F.col("question"), F.col("answer"))).withColumn("prompt", text.prompt(F.col("question")))


def masked(question: Column, answer: Column, user: int, assistant: int, end: int) -> tuple[Column, Column]:
    """(input_ids, labels) from token ids: labels are the next tokens from the answer's first on, before that UNSUPERVISED."""
    ids = F.concat(F.array(F.lit(user)), question, F.array(F.lit(assistant)), answer)
    labels = F.concat(F.array_repeat(F.lit(fixed.UNSUPERVISED), F.size(question) + 1), answer, F.array(F.lit(end)))
    return ids, labels


def encoded_examples(examples: DataFrame, vocabulary: Vocabulary, context: int | None = None) -> DataFrame:
    """``examples`` with input_ids and labels. An example longer than ``context`` is an error, never cut."""
    ids = encoded(encoded(examples, vocabulary, "question", "__q", eos=False, markers=True), vocabulary, "answer", "__a", eos=False, markers=True)
    inputs, labels = masked(F.col("__q"), F.col("__a"), *(vocabulary.special_id(n) for n in (fixed.USER, fixed.ASSISTANT, fixed.END)))
    out = ids.withColumn("input_ids", inputs).withColumn("labels", labels).drop("__q", "__a")
    if context is not None:
        if context < 2:
            raise ValueError("a context has two tokens at least")
        longest = out.agg(F.max(F.size("input_ids")).alias("n")).first().n or 0
        if longest > context:
            raise ValueError(f"an example needs {longest + 1} tokens, the context has {context}")
    return out


def supervised(examples: DataFrame) -> DataFrame:
    """One row: examples and labels that are learned from."""
    return examples.agg(F.count("*").alias("examples"), F.coalesce(F.sum(F.size(F.filter("labels", lambda x: x != fixed.UNSUPERVISED))), F.lit(0)).cast("long").alias("supervised"))


def numbered(examples: DataFrame, order: str) -> DataFrame:
    """``examples`` with number, from 0 by ``order``, an integer that differs in each row."""
    return running(examples.withColumn("__one", F.lit(1)), order, "__one", "number").drop("__one")


def random_batch(examples: DataFrame, size: int, seed: int, step: int = 0) -> DataFrame:
    """``size`` rows of ``examples`` (number, ...; numbers from 0 without gaps) with place, drawn with replacement: the same for the same seed and step."""
    n = examples.count()
    if not n or size < 1:
        raise ValueError("a batch has one example at least")
    drawn = examples.sparkSession.range(size).select(F.col("id").alias("place"), F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "id"), F.lit(n)).alias("number"))
    return examples.join(F.broadcast(drawn), "number").select(*examples.columns, "place") if size <= 100_000 else examples.join(drawn, "number").select(*examples.columns, "place")


def padded(examples: DataFrame, batch: int) -> DataFrame:
    """``examples`` (number, input_ids, labels, ...) with batch and both arrays padded to the batch's longest."""
    if batch < 1:
        raise ValueError("a batch has one example at least")
    rows = examples.withColumn("batch", F.floor(F.col("number") / batch))
    longest = rows.groupBy("batch").agg(F.max(F.size("input_ids")).alias("__n"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__n") - F.size(c)))
    return rows.join(longest, "batch").withColumn("input_ids", fill("input_ids", fixed.PAD_ID)).withColumn("labels", fill("labels", fixed.UNSUPERVISED)).drop("__n")
