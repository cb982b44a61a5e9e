"""Column functions against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textquarry.functions import fixed, hashing, text

TEXTS = [
    "", " ", "Plain  Text\n with\tblanks ", "Straße ΑΣ und ςίγμα", "a b c\x1cd", "In 2024 and ٣ times", "Training variation 12: the ILS. What now?",
    "In this training context, during a check, where the learner is focusing on x while checking y. End.", "From the pilot perspective, from a new perspective and from the angle of doubt?",
    "during line study, during 9 study", "after a small configuration change — exercise 4 and exercise 5", "The ILS/DME and ils, fly-by-wire, a321neo; RNAV and RNP. xils ils_1 (ils)",
    "User: hi Assistant: Yes  it is. User: and? Assistant: No.\nAssistant:\nScenario: x", "Assistant: one\ntwo", "One. Two! Three?  Four.Five", "word " * 300, "rnav/rnp ceo and neo ceo/neo distinction",
]


def canonical(t):
    return " ".join(t.casefold().split())


def masked(t, aliases):
    for a, _ in aliases:
        t = re.sub(r"(?<![\w/-])" + re.escape(a) + r"(?![\w/-])", "<topic>", t)
    return t


def signature(t):
    out = canonical(t)
    for pattern, mask in fixed.SLOTS:
        out = masked(out, text.by_length(fixed.TOPIC_ALIASES)) if pattern is fixed.TOPICS else re.sub(pattern, mask, out)
    return out


def topic(t):
    return next((name for a, name in text.by_length(fixed.TOPIC_ALIASES) if re.search(r"(?<![\w/-])" + re.escape(a) + r"(?![\w/-])", t.casefold())), "<unknown>")


def spans(t):
    return [c for m in re.finditer(fixed.ASSISTANT_SPAN, t, re.I) if (c := canonical(m[1]))]


def variation(t):
    m = re.search(fixed.VARIATION, t, re.I)
    return signature(m[1]) if m else None


def words(t):
    return {w.casefold() for w in re.findall(fixed.INFORMATIVE_WORD, t)} - set(fixed.STOPWORDS) - set(fixed.GENERIC_WORDS)


def shingles(t, n=5):
    w = canonical(t).split()
    return {" ".join(w)} if len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def rows(spark):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    return df.select(
        t, text.canonical(t).alias("canonical"), text.signature(t).alias("signature"), text.topic(t).alias("topic"), text.assistant_spans(t).alias("spans"), text.variation_signature(t).alias("variation"),
        text.informative_words(t).alias("words"), text.shingles(t).alias("shingles"), text.sentences(t).alias("sentences"), text.family_id(text.signature(t)).alias("family"), hashing.split_of(t).alias("split"), hashing.length_prefixed(t).alias("prefixed"),
    ).collect()


def test_functions_equal_python(rows):
    for r in rows:
        assert r.canonical == canonical(r.t)
        assert r.signature == signature(r.t), r.t
        assert r.family == "family-" + hashlib.sha256(signature(r.t).encode()).hexdigest()[:16]
        assert r.topic == topic(r.t), r.t
        assert r.spans == spans(r.t), r.t
        assert r.variation == variation(r.t), r.t
        assert set(r.words) == words(r.t)
        assert set(r.shingles) == shingles(r.t)
        assert r.sentences == [c for s in re.split(r"(?<=[.!?])\s+", r.t) if (c := canonical(s))]
        v = int.from_bytes(hashlib.sha256(b"1337\0" + r.t.encode()).digest()[:8], "big") / 2.0**64
        assert r.split == ("train" if v < 0.9 else "validation" if v < 0.9 + 0.05 else "test")
        assert bytes(r.prefixed) == len(r.t.encode()).to_bytes(8, "big") + r.t.encode()


def test_nulls_stay_null(spark):
    t = F.lit(None).cast("string")
    r = spark.range(1).select(text.canonical(t).alias("a"), text.signature(t).alias("b"), text.shingles(t).alias("c"), text.sentences(t).alias("d"), text.variation_signature(t).alias("e")).first()
    assert r.a is r.b is r.d is r.e is None


def test_ratios():
    hashing.check_ratios(0.9, 0.05, 0.05)
    for bad in ((1.0, 0.0, 0.0), (0.5, 0.1, 0.1)):
        with pytest.raises(ValueError):
            hashing.check_ratios(*bad)


def test_markers(spark):
    r = spark.range(1).select(text.conversation(F.lit("q"), F.lit("a")).alias("c"), text.prompt(F.lit("q")).alias("p"), text.before_user_marker(F.lit(" x <|user|> y")).alias("b")).first()
    assert (r.c, r.p, r.b) == ("<|user|>\nq\n<|assistant|>\na\n<|end|>", "Question: q\nAnswer:", "x")


def test_folding_over_every_code_point(spark):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p) != "|"]
    rows = [(k, "|".join(points[k : k + 512])) for k in range(0, len(points), 512)]
    got = {r.k: r.f.split("|") for r in spark.createDataFrame(rows, "k int, t string").select("k", text.folded(F.col("t")).alias("f")).collect()}
    wrong = [(c, f) for k, t in rows for c, f in zip(t.split("|"), got[k], strict=True) if f != c.casefold()]
    # Spark may know letters that this Python does not know yet.
    assert all(unicodedata.category(c) == "Cn" for c, _ in wrong), wrong


def test_blanks_and_neighbouring_topics(spark):
    """Runs of any white space are squeezed, and topics of one word are masked in one pass as they were one after another."""
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["a" + x + y + "b" + y + x + " " for x in blanks for y in ("", " ", "\n", x)] + ["der que der, le/le -le le der.\nder der_ Der"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    aliases = (("one", ("der", "der que")), ("two", ("le", "que")))
    got = df.select(text.squeezed(F.col("t")).alias("s"), text._topics_masked(F.col("t"), "<topic>", aliases).alias("m")).collect()
    assert [r.s for r in got] == [" ".join(t.split()) for t in texts]
    want = texts[-1]
    for alias in ("der que", "der", "que", "le"):
        want = re.sub(rf"(?<![\w/-]){alias}(?![\w/-])", "<topic>", want)
    assert got[-1].m == want
