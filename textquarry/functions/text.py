"""Text as columns: canonical forms, template signatures, topics, words and sentences.

All are built-in expressions, so they stay in generated code. Java's classes are
made Unicode-aware where Python's are, and `.` stops at a line feed only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions import fixed

_BLANK = r"(?U)[\s\x1c-\x1f]"
#: Runs of white space that are not one blank already: most are, and each match costs far more than a letter that is passed by.
_UNSQUEEZED = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


#: From here on letters count as rare without a closer look.
_WIDE = "\u0180"


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Of lower-case letters that Unicode case folding changes: those that become one letter, and those that become several."""
    every = (c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000)
    changed = {c: c.casefold() for c in every if c.lower() == c and c.casefold() != c}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def _class(letters: Iterable[str]) -> str:
    """A pattern for one of ``letters``, by ranges."""
    points, out = sorted(map(ord, letters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def folded(text: Column) -> Column:
    """Case-folded as Unicode has it: lower-cased, then the letters that folding treats otherwise. Of
    these all but two are rare, and only texts that hold one go through their list. The class that finds them has
    so many ranges that a wider one of a few goes before it."""
    common = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    one, several = _folds()
    rare = {*one, *several} - {"ß", "ς"}
    wide = _class(c for c in rare if c < _WIDE)[:-1] + rf"\x{{{ord(_WIDE):x}}}-\x{{10ffff}}]"

    def fold(t: Column) -> Column:
        out = F.translate(t, "".join(one), "".join(one.values()))
        for letter, folds in several.items():
            out = F.replace(out, F.lit(letter), F.lit(folds))
        return F.when(t.rlike(wide) & t.rlike(_class(rare)), out).otherwise(t)

    return let(common, fold)


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, _UNSQUEEZED, " "))


def canonical(text: Column) -> Column:
    return squeezed(folded(text))


def lowered(text: Column) -> Column:
    """As ``canonical``, but lower-cased only: how answers are compared."""
    return squeezed(F.lower(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_BLANK}+\z|\A{_BLANK}+", "")


def _alias_pattern(alias: str) -> str:
    """The plain letters are looked for first: what stands before them is dear to ask at every place."""
    return rf"(?U)(?={re.escape(alias)})(?<![\w/-]){re.escape(alias)}(?![\w/-])"


def by_length(topics: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, str]]:
    """(alias, topic), longer aliases first, as declared among equals."""
    return sorted(((alias, topic) for topic, aliases in topics for alias in aliases), key=lambda x: -len(x[0]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once for a row: inside of a lambda it would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def topic(text: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    """The topic of the longest alias that stands by itself in ``text``."""
    return topic_of(folded(text), topics)


def topic_of(low: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    """As ``topic``, of a folded text; a plain search comes before each pattern."""

    def found(low: Column) -> Column:
        out = None
        for alias, name in by_length(topics):
            here = F.contains(low, F.lit(alias)) & low.rlike(_alias_pattern(alias))
            out = F.when(here, name) if out is None else out.when(here, name)
        return F.lit(fixed.UNKNOWN_TOPIC) if out is None else out.otherwise(fixed.UNKNOWN_TOPIC)

    return let(low, found)


def _topics_masked(text: Column, mask: str, topics) -> Column:
    """Longer aliases first; texts that don't hold an alias at all are spared its pattern. Aliases of one word stand
    for whole words, which cannot overlap: several of them, one after another, are masked in one pass."""

    def one(alias: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(alias)), F.regexp_replace(t, _alias_pattern(alias), mask)).otherwise(t)

    def several(words: list[str]) -> Callable[[Column], Column]:
        # A first letter is looked for before all else: what stands before it is dear to ask at every place.
        first = "".join(sorted({re.escape(w[0]) for w in words}))
        any_of = "|".join(rf"(?<={re.escape(w[0])}){re.escape(w[1:])}" for w in words)
        return lambda t: F.regexp_replace(t, rf"(?U)[{first}](?<![\w/-].)(?:{any_of})(?![\w/-])", mask)

    in_mask = set(re.findall(r"[\w/-]+", mask))
    for plain, group in groupby((alias for alias, _ in by_length(topics)), lambda a: bool(re.fullmatch(r"[\w/-]+", a, re.ASCII)) and a not in in_mask):
        aliases = list(group)
        for use in [several(aliases)] if plain and len(aliases) > 1 else map(one, aliases):
            text = let(text, use)
    return text


def signature(text: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    """The canonical text with template slots masked, in the fixed order."""
    return signature_of(canonical(text), topics)


def signature_of(canonical: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    """As ``signature``, of a canonical text."""
    out = canonical
    for pattern, mask in fixed.SLOTS:
        out = _topics_masked(out, mask, topics) if pattern is fixed.TOPICS else let(out, _slot_masked(pattern, mask))
    return out


def _slot_masked(pattern: str, mask: str) -> Callable[[Column], Column]:
    """Texts without the longest plain piece of ``pattern`` are spared it; where it begins with a word's edge before a digit, the digit is looked for first."""
    plain = max(re.split(r"\(\?:[^)]*\)|\[[^]]*\]|\\.|[+*?.]", pattern), key=len)
    masked = lambda t: F.regexp_replace(t, "(?U)" + (r"(?=\d)" if pattern.startswith(r"\b\d") else "") + pattern, mask)
    return (lambda t: F.when(F.contains(t, F.lit(plain)), masked(t)).otherwise(t)) if plain else masked


def family_id(signed: Column) -> Column:
    return F.concat(F.lit("family-"), F.left(F.sha2(signed, 256), F.lit(16)))


def begins_preamble(text: Column, prefixes: Iterable[str] = fixed.PREAMBLE_PREFIXES) -> Column:
    return begins_with(canonical(text), prefixes)


def begins_with(canonical: Column, prefixes: Iterable[str] = fixed.PREAMBLE_PREFIXES) -> Column:
    """Whether a canonical text, which is computed once, begins with one of ``prefixes``."""

    def begins(start: Column) -> Column:
        out = F.lit(False)
        for prefix in prefixes:
            out = out | F.startswith(start, F.lit(prefix))
        return out

    return let(canonical, begins)


def informative_words(text: Column) -> Column:
    """The different words of three letters or more that say something, in no order."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.INFORMATIVE_WORD), F.lit(0))), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, fixed.STOPWORDS + fixed.GENERIC_WORDS)))


def words(text: Column) -> Column:
    """Words of a text whose white space is squeezed; none in an empty one."""
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def shingles(text: Column, size: int = fixed.SHINGLE_WORDS) -> Column:
    """The different runs of ``size`` words of the canonical text; a shorter text is one shingle."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
        return F.array_distinct(F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(each))

    return let(words(canonical(text)), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def sentences(text: Column) -> Column:
    """Canonical sentences, cut after . ! or ? and white space; none empty."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+", -1), canonical), lambda s: s != "")


def boilerplate_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?id)" + pattern))


def assistant_spans(text: Column) -> Column:
    """Canonical answers after ``Assistant:``, up to the next speaker or the end; none empty."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?idU)" + fixed.ASSISTANT_SPAN), F.lit(1)), canonical), lambda s: s != "")


def variation_signature(text: Column, topics=fixed.TOPIC_ALIASES) -> Column:
    """The signature of what follows a variation's label to the end of its line, null without one."""
    pattern = "(?idU)" + fixed.VARIATION
    return F.when(text.rlike(pattern), signature(F.regexp_extract(text, pattern, 1), topics))


def conversation(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(f"{fixed.USER}\n"), question, F.lit(f"\n{fixed.ASSISTANT}\n"), answer, F.lit(f"\n{fixed.END}"))


def prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def before_user_marker(text: Column) -> Column:
    return stripped(F.substring_index(text, fixed.USER, 1))
