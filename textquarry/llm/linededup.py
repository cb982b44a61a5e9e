"""Line dedup over levelled sorted runs of line hashes.

Every batch of documents becomes one sorted run of (hash, documents, largest
document, fresh), where ``fresh`` is what a merge-anti-join with the runs
already there says: no earlier batch holds the line. When a level has ``FANOUT``
runs they are compacted into one run of the next level. A line's hash is 128
bits wide; a run is a folder of Parquet files, each sorted by hash.

Two ways to use the store: ``LineRuns.dedup`` takes batch after batch, as a
crawl delivers them, and drops what any earlier batch held; ``dedup_lines``
takes a whole corpus, adds it in batches from the largest ids downwards and
drops frequent lines everywhere but in the largest document that holds them: that of the
batch which the anti-join found no earlier holder for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import BLANKS, ROWS_OF_A_FILE, ascii_lower, shared_dir, table, written

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 3
#: Different lines of a document that are looked up in an array; where more go, its lines are joined.
MOST_LOOKED_UP = 64
#: Rows up to which ids are broadcast.
MOST_BROADCAST = 500_000
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """Null or empty: one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hashed(lines: Column, min_chars: int) -> Column:
    """For each line struct(h1, h2) of its key, null if that is too short; the key is made once, and only of lines long enough."""
    keys = F.transform(lines, lambda x: F.when(F.char_length(x) >= min_chars, line_key(x)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2), once for each document row and long line; rows without a doc_id give none."""
    each = F.array_distinct(F.filter(_hashed(lines_of(F.col("text")), min_chars), lambda x: x.isNotNull()))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(each).alias("h")).select("doc_id", "h.h1", "h.h2")


class LineRuns:
    """Levelled runs in ``folder``: self.levels[k] lists the runs of level k."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or shared_dir(spark), fanout
        self.levels: list[list[str]] = [[]]
        self._made = 0

    SCHEMA = "h1 long, h2 long, n long, keep long, fresh boolean"

    def _write(self, run: DataFrame, level: int, rows: int) -> None:
        """A run of at most ``rows``: it comes dealt by hash, and each of its files is sorted by hash."""
        self._made += 1
        path = f"{self.folder}/level{level}-run{self._made}"
        run.select("h1", "h2", "n", "keep", "fresh").coalesce(-(-max(rows, 1) // ROWS_OF_A_FILE)).sortWithinPartitions(*HASH).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def rows(self, paths: list[str] | None = None) -> DataFrame:
        """All runs, or those of ``paths``, one row for each run and line."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        read = self.spark.read.schema(self.SCHEMA)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        """One row for each line of the runs; ``keep`` is that of the first batch which held it, null if none of these runs is of that batch."""
        return self.rows(paths).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max(F.when(F.col("fresh"), F.col("keep"))).alias("keep"), F.max("fresh").alias("fresh"))

    def add(self, hashes: DataFrame) -> None:
        """Add a batch's (doc_id, h1, h2) as a run of its own; compact full levels."""
        own = hashes.dropDuplicates(["doc_id", *HASH]).groupBy(*HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        if any(self.levels):
            seen = self.rows().where("fresh").select(*HASH)
            new = own.join(seen, HASH, "left_anti").withColumn("fresh", F.lit(True))
            old = own.join(seen, HASH, "left_semi").withColumn("fresh", F.lit(False))
            own = new.unionByName(old)
        else:
            own = own.withColumn("fresh", F.lit(True))
        self._write(own, 0, hashes.count())
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.merged(full), level + 1, self.rows(full).count())
            level += 1

    def dedup(self, batch: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """``batch`` without the long lines that an earlier batch or a larger doc_id of this one holds; then adds it."""
        hashes = written(line_hashes(batch, min_chars), "batch")
        seen = self.rows().where("fresh").select(*HASH)
        within = hashes.groupBy(*HASH).agg(F.max("doc_id").alias("keep")).join(seen.withColumn("old", F.lit(True)), HASH, "left")
        drops = hashes.join(within, HASH).where("old or doc_id < keep")
        out = written(without(batch, drops, min_chars), "kept")
        self.add(hashes)
        return out


def without(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of ``drops`` (doc_id, h1, h2) taken out of ``text``, and n_lines and n_dropped (named __tq_n_lines and __tq_n_dropped).

    The work grows with the lines: a document looks its lines up among at most MOST_LOOKED_UP; where it
    loses more, each line is a row of a join, dealt by line and put together again.
    """
    drops = drops.select(F.col("doc_id").alias("__tq_id"), *HASH).distinct()
    drops = written(drops, "drops")
    sizes = drops.groupBy("__tq_id").agg(F.count("*").alias("__tq_n"))
    many = written(sizes.where(F.col("__tq_n") > MOST_LOOKED_UP), "many")
    no_many = many.isEmpty()
    few = drops if no_many else drops.join(many, "__tq_id", "left_anti")
    gone = few.groupBy("__tq_id").agg(F.collect_list(F.struct(*HASH)).alias("__tq_gone"))
    lines = lines_of(F.col("text"))
    each = F.arrays_zip(lines.alias("line"), _hashed(lines, min_chars).alias("h"))
    kept = F.transform(F.filter(each, lambda x: x["h"].isNull() | ~F.array_contains(F.col("__tq_gone"), x["h"])), lambda x: x["line"])
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["__tq_id"], "left")
    cut = joined.withColumn("__tq_kept", F.when(F.col("__tq_gone").isNotNull(), kept))
    cut = cut.withColumn("__tq_n_lines", F.size(lines).cast("long"))
    cut = cut.withColumn("__tq_n_dropped", F.coalesce(F.col("__tq_n_lines") - F.size("__tq_kept"), F.lit(0)).cast("long"))
    text = F.when(F.col("__tq_gone").isNotNull(), F.array_join("__tq_kept", "\n")).otherwise(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = cut.select(*(text.alias(c) if c == "text" else joined[c] for c in docs.columns), "__tq_n_lines", "__tq_n_dropped")
    if no_many:
        return out
    # The texts with many lines to drop: cut once for each (doc_id, text), then given to all rows that have it.
    key = [F.col("doc_id").cast("long").alias("__tq_id"), F.xxhash64("text").alias("__tq_k1"), F.xxhash64(F.lit(1), "text").alias("__tq_k2")]
    keys = ["__tq_id", "__tq_k1", "__tq_k2"]
    few_ids = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
    large = docs.select(*key, "text").join(few_ids, "__tq_id", "left_semi").dropDuplicates(keys)
    rows = large.select(*keys, F.posexplode(F.arrays_zip(lines.alias("line"), _hashed(lines, min_chars).alias("h"))).alias("pos", "x"))
    rows = rows.select(*keys, "pos", F.col("x.line").alias("line"), F.col("x.h.h1").alias("h1"), F.col("x.h.h2").alias("h2"))
    marked = rows.join(drops.withColumn("__tq_drop", F.lit(True)), ["__tq_id", *HASH], "left")
    stays = F.when(F.col("__tq_drop").isNull(), F.struct("pos", "line"))
    texts = marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(stays)), lambda x: x["line"]), "\n").alias("__tq_text"), F.count("*").alias("__tq_n_lines"), F.count("__tq_drop").alias("__tq_n_dropped"))
    whole = docs.withColumns({"__tq_id": key[0], "__tq_k1": key[1], "__tq_k2": key[2]}).join(written(texts, "cut"), keys)
    whole = whole.select(*(F.col("__tq_text").alias(c) if c == "text" else F.col(c) for c in docs.columns), "__tq_n_lines", "__tq_n_dropped")
    mine = out.join(few_ids, out["doc_id"].cast("long") == few_ids["__tq_id"], "left_anti")
    return mine.unionByName(whole)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` without the lines whose key has at least ``min_chars`` code
    points and stands in at least ``min_docs`` documents, but for the largest
    doc_id that holds it; and __tq_n_lines (before) and __tq_n_dropped.

    A null text is one empty line. Rows that repeat a doc_id are one document.
    Rows with a null doc_id neither count nor lose lines. Other columns stay
    as they are; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    hashes = line_hashes(docs, min_chars)
    # Batches of about as many documents each, however the ids lie.
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)] or [1.0], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in (cuts if batches > 1 else [])), F.lit(0)).cast("int")
    hashes = written(hashes.withColumn("batch", batch), "lines")
    runs = LineRuns(spark, fanout=fanout)
    for k in reversed(range(batches)):
        runs.add(hashes.where(F.col("batch") == k).drop("batch"))
    # As a table of its own, so that the join sees two plain shuffles and can split a line that very many documents hold.
    frequent = written(runs.merged().where(F.col("n") >= min_docs).select(*HASH, "keep"), "frequent", runs.rows().count())
    return without(docs, hashes.drop("batch").join(frequent, HASH).where("doc_id < keep"), min_chars)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__tq_n_lines").alias("n_lines"), F.col("__tq_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, f.keep IS NOT NULL AND k.doc_id <> f.keep AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
QUERIES = {"op5_line_dedup": op5}
ORACLES = {"op5_line_dedup": SQL}
