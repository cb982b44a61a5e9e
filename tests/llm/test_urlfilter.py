import itertools
import math
import re
from collections import Counter

import pytest

from textquarry.llm import urlfilter as U


def parts(url):
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = []
    for action, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def likeliest(name, counts, total):
    """By trying every way to split."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        words, word = [], name[0]
        for c, cut in zip(name[1:], cuts):
            words, word = (words + [word], c) if cut else (words, word + c)
        words.append(word)
        cost = sum(math.log(counts[w] / total) if counts.get(w) else math.log(10 / total) - len(w) * math.log(10) for w in words)
        best = max(best or (-math.inf, 0), (round(cost, 9), 0))
    return best[0]


def slow(pages):
    """page -> (host, path, rule, verdict), with the words split by U.split."""
    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", (html or "").lower())
        counts.update(w for w in re.findall("[a-z]+", text) if len(w) <= 24)
    total = max(1, sum(counts.values()))
    urls = {}
    for _, url, _ in pages:
        host, path = parts(url)
        words = [w for name in re.findall("[a-z]+", host) for w in (U.split(name, counts, total) if 1 < len(name) <= 63 else [name])]
        seen = ["h:" + w for w in words] + ["p:" + re.sub(r"\d+", "#", t) for t in re.split(r"[\W_]+", path.lower()) if t]
        urls[url or ""] = (host, path, *rule_of(host, path), seen)
    n, t = Counter(), {"allow": Counter(), "block": Counter()}
    for *_, action, seen in urls.values():
        if action:
            n[action] += 1
            t[action].update(seen)
    out = []
    size = len(set(t["allow"]) | set(t["block"])) + 1
    p = lambda c, w: math.log((t[c][w] + 1) / (sum(t[c].values()) + size))
    for page, url, _ in pages:
        host, path, rule, action, seen = urls[url or ""]
        if not action:
            score = math.log(n["block"] / n["allow"]) + sum(p("block", w) - p("allow", w) for w in seen) if n["block"] and n["allow"] else 0
            action = "block" if score > 0 else "allow"
        out.append((str(page), host, path, str(rule), action))
    return sorted(out)


PAGES = [
    (1, "https://www.Example.com/en/1?x#y", "<p>the cat</p>"), (2, "http://a.example.com/en/", "<script>bad words</script> cat cat"), (3, "http://example.com/EN/", None), (4, None, "sat"),
    (5, "no scheme", ""), (6, "x://net/es/a://b/", "the"), (7, "x://thecat.net/fr/", "the sat cat"), (8, "x://thecatsat.org/fr/9", "cat"), (9, "x://host?q", "a"), (9, "x://host#q", "a"),
    (None, "x://É.com/en/ü_1", "é"), (11, "ftp://" + "y" * 70 + ".net/de/", "y"), (12, "x:///en/", ""), (12, "x:///en/", ""), (13, "x://com", "x"), (14, "x://notexample.com/en/", "x"), (15, "a\nb://c.net/es/\n", "x"), (16, "x://..net/es/", ""),
]


def rows(df):
    return sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in df.collect())


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(*p, "host", 1) for p in PAGES], "page_id long, url string, html string, host string, n int")
    assert rows(U.filtered(pages)) == slow(PAGES)
    assert U.filtered(pages.limit(0)).count() == 0
    few = [p for p in PAGES if p[0] in (4, 5, 9)]
    assert rows(U.filtered(spark.createDataFrame(few, "page_id long, url string, html string"))) == slow(few)


def test_model_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(U, "MOST_BROADCAST", 0)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert rows(U.filtered(pages)) == slow(PAGES)


def test_real_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows(U.op2(spark, sf)) == slow(pages)


@pytest.mark.parametrize("name", ["thecat", "catsat", "xqz", "acat", "thethe", "t", "satx"])
def test_split_is_the_likeliest(name):
    counts = {"the": 50, "cat": 9, "sat": 7, "a": 30, "t": 1, "he": 12}
    words = U.split(name, counts, 200)
    assert "".join(words) == name
    cost = sum(math.log(counts[w] / 200) if counts.get(w) else math.log(10 / 200) - len(w) * math.log(10) for w in words)
    assert round(cost, 9) == likeliest(name, counts, 200)
