r"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) report
by themselves. Weak ones (an account name, a short secret, an endpoint) are
ordinary on their own and report only when complementary parts stand within
one scope: of the two parts exactly one is a secret, the other an identifier or
an endpoint. The parts are linked by an interval join: each part is dealt to the
scope buckets that it covers and meets those whose scope reaches it. The join
only asks whether a partner exists, so crowded scopes don't multiply rows.

Only built-in functions run here. Places are counted in code points: a running
sum over the pieces between a pattern's matches and the matches themselves
gives every start and end. Equal texts are handled once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import table, written


def any_case(pattern: str) -> str:
    """The letters of ``pattern`` in either case; A-Z only, unlike (?i) in some engines."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_IS, _FREE = r"""["']?\x20*[:=]\x20*["']?""", "(?<![A-Za-z0-9_])"
#: Strong kinds in the order of the contract: pattern, group to measure, least length.
STRONG = (
    ("assign", any_case("(password|passwd|secret|token|api_?key)") + _IS + "([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
#: Weak kinds and the side of a credential that each gives.
WEAK = (
    ("account", _FREE + any_case("(?:user_?name|user_?id|user|login|account_?id|account|client_?id)") + _IS + "[A-Za-z0-9_.@+-]{3,}", "identifier"),
    ("phrase", _FREE + any_case("(?:passphrase|password|passwd|pass|pwd|secret|token|api_?key|credentials?)") + _IS + "[A-Za-z0-9+/_.=!@#%^&*-]{4,}", "secret"),
    ("endpoint", _FREE + "(?:(?:https?|ftp|ssh|sftp|jdbc|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]{2,5})?|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{2,5})?)", "endpoint"),
)
SIDE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: side for k, _, side in WEAK}
KINDS = [k for k, *_ in STRONG] + [k for k, *_ in WEAK]
#: Code points between the parts of one credential.
SCOPE = 200
KEY = ["k1", "k2"]


def _matches(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of struct(kind, i, before, size, enough): for each leftmost match that doesn't overlap the last,
    the code points between the two, its own, and whether ``group`` has ``least``; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else found
    between = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(found))
    zipped = F.arrays_zip(between.alias("before"), found.alias("size"), measured.alias("measured"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["before"].alias("before"), x["size"].alias("size"), (x["measured"] >= least).alias("enough")))
    return F.when(text.rlike(pattern), rows)


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, k1, k2; null keys where nothing matches), and all parts of their distinct texts:
    (k1, k2, kind, start, end, strong), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = [_matches(F.col("t"), KINDS.index(k), p, g, n) for k, p, g, n in STRONG] + [_matches(F.col("t"), KINDS.index(k), p) for k, p, _ in WEAK]
    empty = F.array().cast("array<struct<kind:int,i:int,before:int,size:int,enough:boolean>>")
    found = docs.select("doc_id", text.alias("t")).withColumn("found", F.flatten(F.array(*(F.coalesce(x, empty) for x in every))))
    hit = F.size("found") > 0
    scanned = written(found.select("doc_id", F.when(hit, F.xxhash64("t")).alias("k1"), F.when(hit, F.xxhash64(F.lit(1), "t")).alias("k2"), F.when(hit, F.col("found")).alias("found")), "scanned")
    once = scanned.where("k1 is not null").groupBy(*KEY).agg(F.first("found").alias("found"))
    upto = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = once.select(*KEY, F.explode("found").alias("m")).select(*KEY, "m.*")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(upto).cast("long")).where("enough")
    spans = rows.select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("kind") < len(STRONG)).alias("strong"))
    return scanned.select("doc_id", *KEY), written(spans, "parts")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that overlap no strong one and have a complementary part within ``scope`` code points."""
    secret = F.col("kind").isin([i for i, k in enumerate(KINDS) if SIDE[k] == "secret"])
    sides = spans.withColumn("secret", secret)
    deal = lambda df, reach: df.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope))))
    own, other = deal(sides.where("not strong"), 0).alias("w"), deal(sides, scope).alias("p")
    same = [F.col(f"w.{c}") == F.col(f"p.{c}") for c in (*KEY, "bucket")]
    gap = F.greatest(F.col("p.start") - F.col("w.end"), F.col("w.start") - F.col("p.end"))
    covered = own.join(other.where("strong"), [*same, gap < 0], "left_semi").select(*KEY, "kind", "start", "end").distinct()
    free = sides.where("not strong").join(covered, [*KEY, "kind", "start", "end"], "left_anti")
    # A weak part is a partner only if no strong one covers it.
    parts_of = deal(sides.where("strong").unionByName(free), scope).alias("p")
    near = deal(free, 0).alias("w").join(parts_of, [*same, F.col("w.secret") != F.col("p.secret"), gap <= scope], "left_semi")
    return near.select(*KEY, "kind", "start", "end", "strong").distinct()


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text, ...): doc_id and
    ``spans``, an array of struct(start, kind, end, strong) by start, then kind.

    Null and empty texts have no spans. Null or repeated doc_ids stay as they
    are: a result depends on the text alone. Other columns are ignored; an
    empty table gives an empty one.
    """
    rows, spans = parts(docs)
    every = spans.where("strong").unionByName(linked(spans, scope))
    by_text = every.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "strong"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,strong:boolean>>")
    # Texts without any match have no key; they stay out of the join, where they would all meet.
    found = rows.where("k1 is not null").join(by_text, KEY, "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return rows.where("k1 is null").select("doc_id", none.alias("spans")).unionByName(found)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["strong"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(STRONG)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same for DuckDB: places from the pieces between the matches, links from a join on the distance."""
    quoted = lambda p: "'" + p.replace(_FREE, r"\b").replace("'", "''") + "'"
    every = [(k, p, g, n, "true") for k, p, g, n in STRONG] + [(k, p, 0, 0, "false") for k, p, _ in WEAK]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, {strong} AS strong, '{SIDE[k]}' = 'secret' AS secret, unnest(range(1, len(m) + 1)) AS i, m, g, b FROM "
        f"(SELECT doc_id, regexp_extract_all(text, {quoted(p)}) AS m, regexp_extract_all(text, {quoted(p)}, {g}) AS g, regexp_split_to_array(text, {quoted(p)}) AS b FROM texts)"
        for i, (k, p, g, n, strong) in enumerate(every)
    )
    least = "[" + ", ".join(str(n) for *_, n, _ in every) + "]"
    total = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda x: length(x))), 0)"
    listed = lambda what, which: f"coalesce(string_agg({what}, ',' ORDER BY s, kind){which}, '')"
    name = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][kind + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, (k, *_) in enumerate(STRONG))
    gap = "greatest(p.s - w.e, w.s - p.e)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}),
spans AS (SELECT doc_id, kind, strong, secret, ({total('b', 'i')} + {total('m', '(i - 1)')})::BIGINT AS s, ({total('b', 'i')} + {total('m', 'i')})::BIGINT AS e FROM found WHERE length(g[i]) >= {least}[kind + 1]),
parts AS (SELECT * FROM spans w WHERE strong OR NOT EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = w.doc_id AND p.strong AND {gap} < 0)),
kept AS (SELECT * FROM parts w WHERE strong OR EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.secret <> w.secret AND {gap} <= {SCOPE}))
SELECT d.doc_id, {counts}, sha256({listed(name, " FILTER (WHERE strong)")}) AS base_sha256, {listed(name, " FILTER (WHERE kind IS NOT NULL)")} AS spans
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


QUERIES = {"op9_secret_scan": op9}
ORACLES = {"op9_secret_scan": _sql()}
