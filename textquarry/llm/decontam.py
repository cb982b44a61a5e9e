r"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased tokens (runs of letters, and numbers); case, layout
and punctuation do not matter. A number, a unit that follows a number, and a name (a word
capitalised within a sentence) are slots. Windows of ``WINDOW`` tokens are hashed twice:
typed, with all slots as typed placeholders, so that a question asked again with
other numbers, names or units meets its template; and literal, with names as the words they are, so that a
copy in any case or layout meets it too. Both are hash-joined with those of the benchmark.
On a diagonal (a document place minus an item place) the slots must be filled
consistently: equal fillings in the item must be equal fillings in the document. An
item is found in a document where its windows on consistent diagonals cover
at least ``COVERAGE`` of its windows.

Windows with fewer than ``LITERALS`` words that are no slots say nothing and don't count. An item
without any other, or of fewer tokens than a window, is looked for by its exact tokens (one window of its own length where it is that short).

Only built-in functions run here. Equal texts are scanned once. The item windows are broadcast if there are
at most ``MOST_BROADCAST`` of them, else joined by shuffle. An item is first told by which of its windows a
text holds at all; places are filled and compared for what passes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import table, written

#: Words of a window, literal ones among them, part of an item's windows that must be found; tokens of an item at least.
WINDOW, LITERALS, COVERAGE, SHORTEST = 5, 2, 0.5, 2
MOST_BROADCAST = 500_000
NUMBER, UNIT, NAME = -1, -2, -3
UNITS = "kg g mg lb oz t km m cm mm mi ft in yd l ml gal s ms min h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent mph kmh kph c f k w kw j n hz mb gb".split()
#: Put before a name, so that its token is told from others.
MARK = "\ue001"
#: White space before a name: 64 characters at most, as the pattern needs a bound.
_NAMED = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;]\s{1,64})"
_TOKEN = rf"{MARK}?[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*"
KEY = ["k1", "k2"]


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; those of names begin with MARK. A mark that the text itself holds is dropped."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, " ")
    return F.regexp_extract_all(F.lower(F.regexp_replace(plain, _NAMED, MARK)), F.lit(_TOKEN), F.lit(0))


def _digit(t: Column) -> Column:
    return t.between("0", "9\uffff")


def _word(t: Column) -> Column:
    return F.when(t.startswith(MARK), F.substring(t, 2, 1 << 30)).otherwise(t)


def literal_codes(found: Column) -> Column:
    """A number for each token: the type of a number or unit, or a hash of the word."""

    def code(t: Column, i: Column) -> Column:
        unit = (F.octet_length(t) < 8) & t.isin(UNITS) & (i > 0) & _digit(F.get(found, i - 1))
        return F.when(_digit(t), F.lit(NUMBER).cast("long")).when(unit, F.lit(UNIT).cast("long")).otherwise(F.xxhash64(_word(t)))

    return F.transform(found, code)


def typed_codes(found: Column, literal: Column) -> Column:
    """``literal`` with the type of a name in place of its word."""
    return F.transform(found, lambda t, i: F.when(t.startswith(MARK), F.lit(NAME).cast("long")).otherwise(F.get(literal, i)))


def exact_codes(found: Column) -> Column:
    """A hash for each token as it is, told from those of the other codes."""
    return F.transform(found, lambda t: F.xxhash64(F.lit("exact"), _word(t)))


def _slot(code: Column) -> Column:
    return code.between(NAME, NUMBER)


def _hashes(code: Column, size: int) -> Column:
    """The hash of each window of ``size`` codes, in order. ``code`` is a column that is there: an expression would be computed for each window."""
    each = F.transform(F.sequence(F.lit(0), F.size(code) - size), lambda i: F.xxhash64(*(F.get(code, i + k) for k in range(size))))
    return F.when(F.size(code) >= size, each).otherwise(F.array().cast("array<bigint>"))


def _coded(texts: DataFrame) -> DataFrame:
    """``texts``'s columns but for text, with ``tok``, ``lit`` and ``typ`` (null where the text has no names).

    A generator stands between the steps, so that none is computed again for each use.
    """
    own = [c for c in texts.columns if c != "text"]
    out = texts.select(*own, F.explode(F.array(tokens(F.col("text")))).alias("tok"))
    out = out.select(*own, "tok", F.explode(F.array(literal_codes(F.col("tok")))).alias("lit"))
    named = F.exists("tok", lambda t: t.startswith(MARK))
    return out.select(*own, "tok", "lit", F.explode(F.array(F.when(named, typed_codes(F.col("tok"), F.col("lit"))))).alias("typ"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, pos, w, size, slots, kinds): the windows of each item, literal and typed ones, or exact ones where those say nothing.

    Items of fewer than ``shortest`` tokens, null ids and null texts give none; items
    with the same id are one after another; copies of an item all count.
    """
    found = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = written(_coded(found).withColumn("typ", F.coalesce("typ", "lit")).withColumn("exact", exact_codes(F.col("tok"))).where(F.size("tok") >= shortest), "coded")
    words = F.transform("tok", _word)
    rows = rows.withColumns({"tok": words, "kinds": F.transform("typ", lambda c: F.when(_slot(c), c))})
    part = lambda c: F.slice(c, F.col("pos") + 1, F.least(F.lit(window), F.size(c)))
    said = F.size(F.filter(part("typ"), lambda c: ~_slot(c))) >= literals
    saying = lambda c: F.size(F.filter(part(c), lambda x: ~_slot(x))) >= literals
    places = rows.select("*", F.explode(F.when(F.size("tok") > window, F.sequence(F.lit(0), F.size("tok") - window)).otherwise(F.array(F.lit(0)))).alias("pos"))
    # Places whose typed window says something; for an item without any, those whose literal window does; else exact tokens.
    level = F.when(F.size("tok") < window, 0).when(said, 2).when(saying("lit"), 1).otherwise(0)
    best = places.withColumn("level", level).groupBy("item_id").agg(F.max("level").alias("best"))
    places = places.withColumn("level", level).join(best, "item_id").where("level = best")
    hashed = lambda c: F.get(_hashes(F.col(c), window), F.col("pos"))
    short = F.coalesce(*(F.when(F.size("exact") == n, F.xxhash64(*(F.get("exact", F.lit(k)) for k in range(n)))) for n in range(1, window + 1)), hashed("exact"))
    kind = part("kinds")
    shape = ["item_id", "pos", F.least(F.lit(window), F.size("tok")).alias("size"), part("tok").alias("slots")]
    literal = places.where("level > 0").select(*shape, hashed("lit").alias("w"), kind.alias("kinds"), F.lit(False).alias("exact"))
    typed = places.where("level = 2").select(*shape, hashed("typ").alias("w"), kind.alias("kinds"), F.lit(False).alias("exact"))
    whole = places.where("level = 0").select(*shape, short.alias("w"), F.transform(kind, lambda c: F.lit(None).cast("bigint")).alias("kinds"), F.lit(True).alias("exact"))
    return literal.unionByName(typed).unionByName(whole).distinct()


def _scanned(texts: DataFrame, keys: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(k1, k2, w, pos, size): where a text holds an item's window. No row but the text's own carries its tokens."""
    coded = _coded(texts)
    typed = F.when(F.col("typ").isNotNull(), _hashes(F.col("typ"), window)).otherwise(F.array().cast("array<bigint>"))
    # The number of places is a column of its own below the generator: computed beside it, it would carry the tokens into every row.
    placed = coded.select(*KEY, "lit", "typ", F.greatest(F.size("tok") - (window - 1), F.lit(1)).alias("n"))
    rows = placed.select(*KEY, "n", F.posexplode(F.concat(_hashes(F.col("lit"), window), typed)).alias("i", "w"))
    rows = rows.select(*KEY, "w", F.pmod("i", "n").alias("pos"), F.lit(window).alias("size"))
    # Windows of exact tokens, of each size that an item asks for.
    whole = coded.select(*KEY, F.explode(F.array(exact_codes(F.col("tok")))).alias("exact"))
    for size in sizes:
        exact = whole.select(*KEY, F.posexplode(_hashes(F.col("exact"), size)).alias("pos", "w"))
        rows = rows.unionByName(exact.select(*KEY, "w", "pos", F.lit(size).alias("size")))
    return rows.join(_few(keys), "w", "left_semi").select(*KEY, "w", "pos", "size")


def _filled(texts: DataFrame, met: DataFrame) -> DataFrame:
    """``met`` (k1, k2, w, pos, size) with ``theirs``, the tokens there: each of these texts is cut once more, for all of its places."""
    places = written(met.groupBy(*KEY).agg(F.collect_set(F.struct("w", "pos", "size")).alias("places")), "places")
    tok = texts.join(_few(places), KEY).select(*KEY, "places", F.explode(F.array(tokens(F.col("text")))).alias("tok"))
    own = F.transform("places", lambda x: F.struct(x["w"].alias("w"), x["pos"].alias("pos"), F.transform(F.slice("tok", x["pos"] + 1, x["size"]), _word).alias("theirs")))
    return tok.select(*KEY, F.explode(own).alias("x")).select(*KEY, "x.*")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, k1, k2, item_id, n_windows, n_found, coverage, reparameterised), a row for each document row and item found in it.

    k1 and k2 hash the text. ``reparameterised``: some slot is filled otherwise
    than in the item. Null texts hold nothing; null and repeated doc_ids stay
    as they are. An empty table, on either side, gives an empty one. Items of fewer than ``shortest`` tokens are never found.
    """
    items = written(item_windows(benchmark, window, literals, shortest), "items")
    totals = items.groupBy("item_id").agg(F.count_distinct("pos").alias("n_windows"))
    sizes = sorted(r["size"] for r in items.where("exact").select("size").distinct().collect())  # at most ``window`` of them
    side = items.select("item_id", F.col("pos").alias("at"), "w", F.col("slots").alias("own"), "kinds")
    keys = side.select("w").distinct()

    # One row of each text: of copies, that with the smallest doc_id.
    keyed = _keyed(docs)
    copies = written(keyed.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(*KEY, "least"), "copies")
    texts = keyed.join(_few(copies), KEY, "left").where("least is null or doc_id = least").select(*KEY, "text")
    met = written(_scanned(texts, keys, sizes, window), "met")

    # What a text holds of an item at all; then, for items held well enough, on which diagonals.
    held = met.select(*KEY, "w").distinct().join(_few(side.select("w", "item_id", "at").distinct()), "w").groupBy(*KEY, "item_id").agg(F.count_distinct("at").alias("n_held"))
    held = written(held.join(_few(totals), "item_id").where(F.col("n_held") >= coverage * F.col("n_windows")).select(*KEY, "item_id", "n_windows"), "held")
    good = met.join(_few(held.select(*KEY).distinct()), KEY, "left_semi")
    per_text = _filled(texts, good).distinct().join(_few(held), KEY).join(_few(side), ["item_id", "w"])
    per_text = written(per_text.select(*KEY, "item_id", "at", (F.col("pos") - F.col("at")).alias("diagonal"), "theirs", "own", "kinds"), "diagonals")
    # Slot consistency: on a diagonal, what the item fills alike the document fills alike.
    pairs = per_text.where("exists(kinds, c -> c is not null)").select(*KEY, "item_id", "diagonal", F.explode(F.arrays_zip(F.col("kinds").alias("kind"), F.col("own").alias("mine"), "theirs")).alias("s"))
    pairs = pairs.where("s.kind is not null").groupBy(*KEY, "item_id", "diagonal", "s.kind", "s.mine").agg(F.count_distinct("s.theirs").alias("n"), F.max((F.col("s.mine") != F.col("s.theirs")).cast("int")).alias("other"))
    slots = pairs.groupBy(*KEY, "item_id", "diagonal").agg(F.max("n").alias("n"), F.max("other").alias("other"))
    good = per_text.select(*KEY, "item_id", "diagonal", "at").join(slots, [*KEY, "item_id", "diagonal"], "left").where("n is null or n = 1")
    by_item = good.groupBy(*KEY, "item_id").agg(F.count_distinct("at").alias("n_found"), F.min(F.coalesce("other", F.lit(0))).alias("other"))
    by_item = written(by_item.join(held, [*KEY, "item_id"]).where(F.col("n_found") >= coverage * F.col("n_windows")), "found")
    out = keyed.select("doc_id", *KEY).join(_few(by_item), KEY)
    return out.select("doc_id", *KEY, "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"), (F.col("other") == 1).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, in which no item is found."""
    gone = _few(written(contaminated(docs, benchmark).select(F.col("k1").alias("__tq_k1"), F.col("k2").alias("__tq_k2")).distinct(), "gone"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    on = (F.xxhash64(text) == gone["__tq_k1"]) & (F.xxhash64(F.lit(1), text) == gone["__tq_k2"])
    return docs.join(gone, on, "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it; documents without any have none."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*KEY)


QUERIES = {"op3_decontamination": op3}
ORACLES: dict[str, str] = {}
