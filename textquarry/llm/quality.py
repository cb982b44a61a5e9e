r"""Quality classifier by hierarchical empirical Bayes.

A logistic curve over features of the text gives a document's own evidence. Its
site speaks too: labels are summed by host and by path, in one grouped
aggregation each; a host's rate is shrunk towards the global rate, a path's
towards its host's, each by a prior strength that the spread of the rates itself
tells (method of moments, from single-row sums). Sparse sites so follow the level above,
well-labelled ones their own record. Evidence and site meet as log odds:
what the site says beyond the global rate is added to what the text says.

Labels of the held-out fold (crc32(doc_id as text) mod 5 is 0) are never used. The curve is
fitted on at most ``SAMPLE`` labelled documents, a uniform choice by hash; sums cover all labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import slices, table, written

SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
#: Sites up to which their rates are broadcast.
MOST_BROADCAST = 200_000
#: Bounds of a prior's strength, in labels.
STRENGTH = (1.0, 1000.0)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER, _DIGITS, _BLANK = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
_MARKS, _SYMBOLS = b".,;:!?'\"()-", bytes(c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-" and not chr(c).isalnum())
FEATURES = ("length", "words", "word_length", "upper", "digits", "marks", "symbols", "other", "distinct", "repeated_lines", "line_length", "short_lines", "exclaimed")


def features(text: bytes | None) -> list[float]:
    """Shares and logarithms that describe a text; all zero for one without words."""
    words = text.split() if text else ()
    if not words:
        return [0.0] * len(FEATURES)
    size, n, lines = len(text), len(words), text.split(b"\n")
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    ascii_letters = share(_LETTERS)
    return [
        np.log1p(size), np.log1p(n), size / n / 10, share(_UPPER) / max(ascii_letters, 1e-3), share(_DIGITS), share(_MARKS), share(_SYMBOLS),
        (size - len(text.translate(None, bytes(range(128, 256))))) / size, len(set(words)) / n, 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
        sum(len(x) < 30 for x in lines) / len(lines), text.count(b"!") / n,
    ]


def _measured(batches):
    for batch in slices(batches):
        x = np.array([features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.float64).reshape(batch.num_rows, len(FEATURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), lists], ["id", "host", "path", "x"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the first of the constant, on features clipped to 6 deviations: [constant, ...], with means and scales as rows 1 and 2."""
    width = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    z = np.c_[np.ones(len(x)), np.clip((x - mean) / scale, -6, 6)]
    z = np.c_[z, z[:, 1:] ** 2]
    w = np.zeros(z.shape[1])
    penalty = np.r_[1e-3, np.full(z.shape[1] - 1, ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.stack([w, np.r_[0, mean, np.zeros(width)], np.r_[1, scale, np.ones(width)]])


def log_odds(model: np.ndarray) -> Column:
    """The model as a column over ``x``: native, so that scoring moves no data to Python."""
    width = len(FEATURES)
    w, mean, scale = model[0], model[1][1 : width + 1], model[2][1 : width + 1]
    out = F.lit(float(w[0]))
    for k in range(width):
        z = F.least(F.greatest((F.get("x", k) - float(mean[k])) / float(scale[k]), F.lit(-6.0)), F.lit(6.0))
        out = out + z * (F.lit(float(w[k + 1])) + z * float(w[k + 1 + width]))
    return F.least(F.greatest(out, F.lit(-30.0)), F.lit(30.0))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def strength(groups: DataFrame) -> float:
    """Prior strength for ``groups`` (n, good, prior): the rates' spread around their priors beyond what chance gives, by the method of moments."""
    rate, spread = F.col("good") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    sums = groups.agg(F.sum(F.col("n") * (rate - F.col("prior")) ** 2).alias("s"), F.sum(spread).alias("chance"), F.sum(F.col("n") * spread).alias("most")).first()
    if not sums.s or sums.s <= sums.chance:
        return STRENGTH[1]
    # E[s] = chance + (most - chance) / (strength + 1)
    return float(min(max((sums.most - sums.chance) / (sums.s - sums.chance) - 1, STRENGTH[0]), STRENGTH[1]))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def classified(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, evidence, host_rate, path_rate, score, keep) of every row of ``docs`` (doc_id, text, ...).

    ``host`` and ``path`` name a document's site; by default its ``source`` and, within it, its ``lang``.
    evidence: the text's log odds of label 1; the rates: posteriors of the site; score: all together, 0 to 1; keep: score >= 0.5.
    Null sites are one site of their own. Null and empty texts have zero for every
    feature. Null and repeated doc_ids stay, the former without labels; contradicting labels count as 0.
    Without labels every rate and score is 0.5. An empty table gives an empty one.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    sites = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    each = written(docs.select(F.col("doc_id").alias("id"), *sites, F.col("text").cast("string").alias("text")).mapInArrow(_measured, f"id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, x array<double>"), "features")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("y")).where(fold(F.col("id")) != HELD_OUT)
    learned = written(each.join(known, "id"), "learned")
    found = learned.orderBy(F.xxhash64("id"), "id", "y").limit(sample).select("x", "y").toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    model = logistic(x, found["y"].to_numpy().astype(float))
    total = learned.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    overall = ((total.good or 0) + 0.5) / (total.n + 1)
    hosts = learned.groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("good")).withColumn("prior", F.lit(overall))
    k = strength(hosts)
    hosts = hosts.select("host", ((F.col("good") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    paths = learned.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")).join(hosts, "host").withColumnRenamed("host_rate", "prior")
    k = strength(paths)
    paths = paths.select("host", "path", ((F.col("good") + k * F.col("prior")) / (F.col("n") + k)).alias("path_rate"))
    hosts, paths = written(hosts, "hosts"), written(paths, "paths")
    # A few sites hold most documents: their rows need not move where the sites are few.
    hosts, paths = (F.broadcast(x) if x.count() <= MOST_BROADCAST else x for x in (hosts, paths))
    out = each.join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    out = out.withColumn("host_rate", F.coalesce("host_rate", F.lit(overall)))
    out = out.withColumn("path_rate", F.coalesce("path_rate", "host_rate")).withColumn("evidence", log_odds(model))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate")) - float(np.log(overall / (1 - overall))))))
    return out.withColumn("score", score).select(F.col("id").alias("doc_id"), (fold(F.col("id")) == HELD_OUT).alias("held_out"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6}
ORACLES: dict[str, str] = {}
