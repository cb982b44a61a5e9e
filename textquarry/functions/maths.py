"""Budgets, schedules and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCESSIVE_EPOCHS = 10.0


def perplexity(loss: Column) -> Column:
    """exp(loss); from 700 on infinite; null stays null."""
    return F.when(loss < 700, F.exp(loss)).when(loss.isNotNull(), F.lit(float("inf")))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def budget(spark: SparkSession, train_tokens: int, *, epochs: float | None = None, steps: int = 0, batch: int = 8, accumulation: int = 4, context: int = 1024, warmup: int = 0, warmup_fraction: float = 0.1, validation_tokens: int = 0, test_tokens: int = 0) -> DataFrame:
    """One row: what a run of ``epochs`` or of ``steps`` comes to. Either is given, not both."""
    if train_tokens < 1:
        raise ValueError("there must be a training token")
    if validation_tokens < 0 or test_tokens < 0:
        raise ValueError("token counts must not be negative")
    if min(batch, accumulation, context) < 1:
        raise ValueError("batch, accumulation and context must be positive")
    if steps < 0:
        raise ValueError("steps must not be negative")
    if steps and epochs is not None:
        raise ValueError("ambiguous budget: give either epochs or steps")
    if not steps and (epochs is None or epochs <= 0):
        raise ValueError("give a positive number of epochs or steps")
    tokens = F.lit(train_tokens).cast("long")
    base = spark.range(1).select(tokens.alias("training_tokens"), F.lit(validation_tokens).cast("long").alias("validation_tokens"), F.lit(test_tokens).cast("long").alias("test_tokens"), F.lit(batch * accumulation * context).cast("long").alias("tokens_per_update"))
    base = base.withColumn("updates_per_epoch", F.ceil(F.col("training_tokens") / F.col("tokens_per_update")))
    resolved = F.lit(steps).cast("long") if steps else F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(epochs)) * F.col("updates_per_epoch")))
    base = base.withColumn("training_steps", resolved)
    warm = F.lit(warmup).cast("long") if warmup > 0 else F.greatest(F.lit(1).cast("long"), F.least(F.col("training_steps") - 1, F.bround(F.col("training_steps") * warmup_fraction).cast("long")))
    base = base.withColumn("warmup_steps", warm).withColumn("tokens_processed", F.col("training_steps") * F.col("tokens_per_update"))
    base = base.withColumn("effective_epochs", F.col("tokens_processed") / F.col("training_tokens"))
    return base.withColumn("excessive", F.col("effective_epochs") > EXCESSIVE_EPOCHS)


def learning_rates(spark: SparkSession, steps: int, warmup: int, peak: float, least: float) -> DataFrame:
    """(step, rate) from 0 to ``steps``: a linear rise to ``peak``, then half a cosine down to ``least``."""
    step = F.col("id")
    progress = F.least(F.greatest((step - warmup) / F.lit(float(max(steps - warmup, 1))), F.lit(0.0)), F.lit(1.0))
    falling = F.lit(least) + (peak - least) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))
    return spark.range(steps + 1).select(step.alias("step"), F.when(step <= warmup, F.lit(peak) * step / float(max(warmup, 1))).otherwise(falling).alias("rate"))


def finetune_steps(examples: int, batch: int, accumulation: int, epochs: float, steps: int = 0) -> tuple[int, int]:
    """(steps, updates of an epoch)."""
    if batch < 1 or accumulation < 1 or epochs <= 0:
        raise ValueError("batch, accumulation and epochs must be positive")
    updates = math.ceil(examples / (batch * accumulation))
    return (steps if steps >= 1 else max(1, math.ceil(epochs * updates))), updates


def progress(done: Column, total: Column, seconds: Column, tokens_per_step: Column, train_tokens: Column) -> Column:
    """struct(epoch, tokens_per_second, seconds_left) of a run."""
    return F.struct((done * tokens_per_step / F.greatest(train_tokens, F.lit(1))).alias("epoch"), F.try_divide(done * tokens_per_step, seconds).alias("tokens_per_second"), (F.try_divide(seconds, done) * (total - done)).alias("seconds_left"))
