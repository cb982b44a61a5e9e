r"""URL filters: rules first, then host word segmentation and naive Bayes.

A rule names a host (which covers its subdomains) and the start of a path; the
longest that fits decides. What no rule decides is judged by a multinomial
naive Bayes over the words of the host and the path, learned from the urls that
rules decide. Names run together are split into words by a unigram Viterbi:
word counts come from the text of all pages, and each distinct piece of a host
name only gets the counts of its own substrings, so the word list is never
broadcast. A substring that is no word costs as in a geometric model of its length.

All distinct urls are judged once; counts are grouped sums, and the model is
broadcast only if it has at most ``MOST_BROADCAST`` tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import ascii_lower, table, written

#: (action, host and path) of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Letters of a word at most; pieces longer than a host label may be stay whole.
LONGEST_WORD, LONGEST_LABEL = 24, 63
SMOOTHING, MOST_BROADCAST = 1.0, 200_000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (url, host, path) with the rule and action that fit, or nulls; the rules are looked up by the host's own suffixes."""
    spark = urls.sparkSession
    rows = [(rule, action, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) for action, rule in rules]
    known = spark.createDataFrame(rows, "rule string, action string, rule_host string, rule_path string")
    known = F.broadcast(known) if len(rows) <= MOST_BROADCAST else known
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(known, "rule_host").where(F.startswith("path", "rule_path"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    return urls.join(best, "url", "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): the a-z words of at most LONGEST_WORD letters, lower-cased, of all pages' text, without what stands in tags, scripts and styles."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col("html").cast("string"), F.lit(""))), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(F.octet_length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n"))


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of ``name`` under unigram counts; of equal ones that with the longest last word."""
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            n = counts.get(word, 0)
            cost = math.log(n / total) if n else math.log(10.0 / total) - len(word) * math.log(10.0)
            if best[start] + cost > best[end] + 1e-12:
                best[end], back[end] = best[start] + cost, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words): each distinct ``name`` split into words. ``words`` (word, n) stays distributed."""
    total = max(1, words.agg(F.sum("n")).first()[0] or 1)
    size = F.length("name")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - i + 1)), lambda n: F.substring("name", i, n))))
    short = names.where(size.between(2, LONGEST_LABEL))
    known = short.select("name", F.explode(F.array_distinct(cuts)).alias("word")).join(words, "word")
    with_counts = names.join(known.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known")), "name", "left")

    def cut(batches):
        for batch in batches:
            known = batch.column("known").to_pylist()
            out = [split(name, {x["word"]: x["n"] for x in k or ()}, total) if 1 < len(name) <= LONGEST_LABEL else [name] for name, k in zip(batch.column("name").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return with_counts.mapInArrow(cut, "name string, words array<string>")


def tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(url, token), repeats included: ``h:`` and the words of the host, ``p:`` and those of the path, numbers as ``#``."""
    pieces = F.array_remove(F.split("host", "[^a-z]+", -1), "")
    hosts = written(urls.select("host").distinct().select("host", F.explode(pieces).alias("name")), "hosts")
    named = hosts.join(segmented(hosts.select("name").distinct(), words), "name")
    # Written first: a hot host's urls then meet a plain table, which is broadcast where it is small and split where it is not.
    per_host = written(named.groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words")), "words_of_hosts")
    path = F.transform(F.array_remove(F.split(F.lower("path"), r"[^\p{L}\p{Nd}]+", -1), ""), lambda t: F.concat(F.lit("p:"), F.regexp_replace(t, r"\p{Nd}+", "#")))
    host = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda t: F.concat(F.lit("h:"), t))
    return urls.join(per_host, "host", "left").select("url", F.explode(F.concat(host, path)).alias("token"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, host, path, rule, verdict, score) for each distinct url of ``pages`` (url, html, ...), null counting as empty.

    score: the log odds of blocking under naive Bayes. Without a rule the verdict is block if
    they are positive. Where rules decide no url of either kind there is nothing to learn: all else is allowed.
    """
    host, path = parts(F.col("url"))
    urls = pages.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    urls = written(ruled(urls, rules), "urls")
    each = written(tokens(urls, written(word_counts(pages), "word_counts")), "tokens")
    seen = {r.action: r.n for r in urls.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if not seen.get("allow") or not seen.get("block"):
        return urls.select("url", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    counts = each.join(urls.where("action is not null").select("url", "action"), "url").groupBy("token").agg(F.count_if(F.col("action") == "block").alias("b"), F.count_if(F.col("action") == "allow").alias("a"))
    counts = written(counts, "model")
    n = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    a, b = (n.a or 0) + SMOOTHING * (n.v + 1), (n.b or 0) + SMOOTHING * (n.v + 1)
    model = counts.select("token", (F.log((F.col("b") + SMOOTHING) / b) - F.log((F.col("a") + SMOOTHING) / a)).alias("weight"))
    model = F.broadcast(model) if n.v <= MOST_BROADCAST else model
    # Summed as decimals, so that the order of the rows changes nothing.
    summed = each.join(model, "token", "left").groupBy("url").agg(F.sum(F.coalesce("weight", F.lit(math.log(a / b))).cast("decimal(28,15)")).alias("weight"))
    score = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) + math.log(seen["block"] / seen["allow"])
    out = urls.join(summed, "url", "left").withColumn("score", score)
    verdict = F.coalesce("action", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("url", "host", "path", "rule", verdict.alias("verdict"), "score")


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url, html, ...).

    A verdict depends on the url alone; null and repeated page_ids stay. A
    url that is null or has no ``://`` has an empty host and path and gets the
    verdict of the class shares. Null html has no words. Other columns are
    ignored; an empty table gives an empty one.
    """
    left = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    return left.join(judged(pages, rules), "url").select("page_id", "host", "path", "rule", "verdict", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filter": op2}
ORACLES: dict[str, str] = {}
