import random

import regex

from textquarry.llm import decontam
from textquarry.llm.decontam import COVERAGE, LITERALS, MARK, SHORTEST, UNITS, WINDOW


def template(text):
    """(literal codes, typed codes, words), token by token."""
    text = regex.sub(r"(?<=[\p{Ll},;]\s{1,64})(?=\p{Lu}\p{Ll})", MARK, (text or "").replace(MARK, " "), flags=regex.ASCII).lower()
    found = regex.findall(decontam._TOKEN, text)
    number = lambda t: "0" <= t[0] <= "9"
    literal, typed = [], []
    for i, t in enumerate(found):
        unit = i and t in UNITS and number(found[i - 1])
        literal.append(-1 if number(t) else -2 if unit else t.removeprefix(MARK))
        typed.append(-3 if t[0] == MARK else literal[-1])
    return literal, typed, [t.removeprefix(MARK) for t in found]


def windows(code, size=WINDOW):
    return [tuple(code[i : i + size]) for i in range(len(code) - size + 1)]


def says(window):
    return sum(isinstance(c, str) for c in window) >= LITERALS


def item_windows(text):
    """(windows by place: sets of (kind, window), typed codes, words)."""
    literal, typed, words = template(text)
    places = list(enumerate(zip(windows(literal), windows(typed))))
    for level in (lambda a, b: says(b), lambda a, b: says(a)):
        own = {i: {("code", a)} | ({("code", b)} if says(b) else set()) for i, (a, b) in places if level(a, b)}
        if own:
            return own, typed, words
    size = min(WINDOW, len(words))
    return ({i: {("exact", w)} for i, w in enumerate(windows(words, size))} if len(words) >= SHORTEST else {}), [None] * len(words), words


def slow(docs, items):
    templates = {item: item_windows(t) for item, t in items if t is not None and item is not None}
    out = []
    for d, text in docs:
        literal, typed, words = template(text)
        places = {}
        for kind, code in (("code", literal), ("code", typed), *(("exact", words) for _ in range(1))):
            for size in (WINDOW,) if kind == "code" else range(1, WINDOW + 1):
                for i, w in enumerate(windows(code, size)):
                    places.setdefault((kind, w), set()).add(i)
        for item, (own, item_code, item_words) in templates.items():
            diagonals, width = {}, min(WINDOW, len(item_words))
            for at, each in own.items():
                for w in each:
                    for i in places.get(w, ()):
                        diagonals.setdefault(i - at, set()).add(at)
            hit, others = set(), []
            for shift, ats in diagonals.items():
                pairs = {(item_code[a + k], item_words[a + k], words[a + k + shift]) for a in ats for k in range(width) if isinstance(item_code[a + k], int)}
                if len({p[:2] for p in pairs}) == len(pairs):
                    hit |= ats
                    others.append(any(p[1] != p[2] for p in pairs))
            if own and hit and len(hit) >= COVERAGE * len(own):
                out.append((str(d), item, len(own), len(hit), round(len(hit) / len(own), 9), all(others)))
    return sorted(out)


ITEMS = [
    (1, "If Anna has 12 apples and gives 5 kg to Bob how many apples has Anna now out of 12"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank"),
    (3, "too short"), (4, None), (5, ""), (None, "an item without an id that has many words"), (6, "12 13 14 15 16 17 18"),
    (7, "The treaty was signed when Alice met Bob near Paris while Carol visited London and Berlin with David"),
    (8, "a train goes from Leeds to York at 30 km in 2 hours how far"), (9, "Who wrote Hamlet?"), (10, "alone"),
    (11, "we saw Anna Berta Carla Dora Emma Fritz"),
]


def texts():
    rng = random.Random(2)
    words = ["w%s" % "abcdefghij"[i] for i in range(10)] + ["The", "Anna", "7", "kg"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    asked = "so if Peter has 30 apples and gives 8 km to Carl how many apples has Peter now out of 30"
    wrong = "so if Peter has 30 apples and gives 8 km to Carl how many apples has Maria now out of 31"
    return [
        None, "", "x", some(50), some(900), ITEMS[0][1], f"{some(40)}\n{ITEMS[1][1]}. {some(9)}", f"{some(9)} {asked} {some(9)}", f"{some(9)} {wrong}",
        ITEMS[7][1].lower(), ITEMS[7][1].upper(), ITEMS[7][1].replace(" ", "\n"), ITEMS[7][1].replace(" ", "  "), ITEMS[8][1].replace(" ", " \n\t"), f"{some(5)} who WROTE\nhamlet {some(3)}",
        ITEMS[7][1].replace("Alice", "Xenia").replace("Bob", "Yorick").replace("Paris", "Rome").replace("Carol", "Zoe").replace("David", "Willy"), "alone", ITEMS[11][1], ITEMS[11][1].upper(),
        ITEMS[1][1].upper(), "the quick brown fox jumps over the lazy cat", "the quick brown", f"{ITEMS[1][1]} {some(5)} " * 50, MARK + ITEMS[1][1], "12 13 14 15 16 17 18",
    ]


def test_equals_brute_force(spark):
    rows = [(None if i == 6 else i // 2, t) for i, t in enumerate(texts() + texts()[5:9])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k1 int, code string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contaminated(docs, items)
    assert sorted((str(r.doc_id), r.item_id, r.n_windows, r.n_found, round(r.coverage, 9), r.reparameterised) for r in got.collect()) == slow(rows, ITEMS)
    asked = {(r.doc_id, r.item_id): r.reparameterised for r in got.collect()}
    assert asked[3, 1] is True and (4, 1) not in asked
    found = {(t, x[1]): x[5] for _, t in rows for x in slow([(0, t)], ITEMS)}
    copies = [t for t in texts() if t and "".join(ITEMS[7][1].lower().split()) in "".join(t.lower().split())]
    assert len(copies) == 4 and all(found[t, 7] is False for t in copies)
    assert any("Xenia" in t and i == 7 and other for (t, i), other in found.items())
    assert {i for _, i in found} == {1, 2, 6, 7, 8, 9, 11}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    gone = {(d, texts_) for d, texts_ in rows if any((str(d), 0) <= (x[0], 0) and x[0] == str(d) for x in slow([(d, texts_)], ITEMS))}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([r for r in rows if tuple(r) not in gone], "doc_id long, text string").collect()))
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(str, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert sorted(map(str, decontam.contaminated(docs, items).collect())) == want


def test_real_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = decontam.op3(spark, sf).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_windows, r.n_found, round(r.coverage, 9), r.reparameterised) for r in got) == slow(docs, items)


def test_work_grows_with_the_text(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=300_000))
    docs = spark.createDataFrame([(1, f"{long} {ITEMS[1][1]} {long}"), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(1, 2)]
