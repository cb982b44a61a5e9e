"""Next-token choices over score tables: penalties, temperature, top-k, nucleus and the greedy token.

Tables have a row for each step and token (step, token_id, score). A step has
at most as many rows as the vocabulary has tokens, which bounds every window here. Drawing at random from
what is left is not part of this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def penalized(scores: DataFrame, recent: DataFrame, penalty: float) -> DataFrame:
    """``scores`` of tokens in ``recent`` (step, token_id) made less likely: divided where positive, multiplied where negative."""
    if penalty <= 1:
        return scores
    seen = recent.select("step", "token_id").distinct().withColumn("__seen", F.lit(True))
    lower = F.when(F.col("score") < 0, F.col("score") * penalty).otherwise(F.col("score") / penalty)
    return scores.join(seen, ["step", "token_id"], "left").withColumn("score", F.when(F.col("__seen"), lower).otherwise(F.col("score"))).drop("__seen")


def greedy(scores: DataFrame) -> DataFrame:
    """(step, token_id): the best token of each step, of equal ones the smallest id."""
    return scores.groupBy("step").agg(F.max(F.struct("score", (-F.col("token_id")).alias("t"))).alias("x")).select("step", (-F.col("x.t")).alias("token_id"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each step, with all that equal the last of them; all for ``k`` = 0."""
    if k <= 0:
        return scores
    order = Window.partitionBy("step").orderBy(F.desc("score"))
    return scores.withColumn("__rank", F.rank().over(order)).where(F.col("__rank") <= k).drop("__rank")


def probabilities(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``scores`` with p, the softmax of score over temperature."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive; at zero the greedy token is meant")
    best = scores.groupBy("step").agg(F.max("score").alias("__best"))
    raised = scores.join(best, "step").withColumn("__e", F.exp((F.col("score") - F.col("__best")) / temperature))
    total = Window.partitionBy("step")
    return raised.withColumn("p", F.col("__e") / F.sum("__e").over(total)).drop("__best", "__e")


def nucleus(weighed: DataFrame, top_p: float) -> DataFrame:
    """Of ``weighed`` (step, token_id, p, ...) the likeliest tokens before which less than or just ``top_p`` is reached, p made whole again."""
    if top_p >= 1:
        return weighed
    before = Window.partitionBy("step").orderBy(F.desc("p"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = weighed.withColumn("__before", F.coalesce(F.sum("p").over(before), F.lit(0.0))).where(F.col("__before") <= top_p)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("step"))).drop("__before")
