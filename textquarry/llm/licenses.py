r"""License scans by exact set-similarity join.

Templates are license notices; a text block is any run of at most ``SPREAD`` times as many consecutive
words as the template has, so that words strewn in do not hide it. A block meets a template if it holds at least
``THRESHOLD`` of the template's distinct words (containment). Of all words of all
templates the number of occurrences in the whole corpus is counted first; a
template's words are ordered from rare to frequent, and by the prefix filter
a block that misses all of its first (n - needed + 1) words cannot meet it, so
only what lies within a block's length of these rarest words is looked at. The length filter leaves out texts of
fewer words than are needed and blocks of more than SPREAD times the template's; the positional filter leaves out
stretches whose template words are too few. In what passes two pointers move over the places of template words
and count exactly, so every block that meets the threshold is found.

The templates are a parameter whose size does not grow with the corpus; they
and their counts go to every task.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import slices, table

THRESHOLD, SPREAD = 0.8, 2
#: Phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices by label (fixed values: the public texts of these licenses).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "all rights reserved no part of this publication may be reproduced without permission"),
)
#: A-Z lower-cased; a-z, 0-9 and bytes from 0x80 make words; all else parts them.
_KEEP = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


class Templates:
    """Templates whose words are ordered by their number in the corpus."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float, spread: int = SPREAD):
        self.spread = spread
        self.each = []
        for label, text in templates:
            words = words_of(text.encode())
            order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            needed = math.ceil(threshold * len(order) - 1e-9)
            if order:
                self.each.append((label, len(words), order, needed, frozenset(order[: len(order) - needed + 1])))
        self.rare = frozenset(w for *_, prefix in self.each for w in prefix)
        self.all = frozenset(w for _, _, order, *_ in self.each for w in order)

    def met(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, containment) of every stretch of overlapping blocks that meet a template."""
        here = self.rare.intersection(words)
        if not here:
            return []
        places: dict[bytes, list[int]] = {w: [] for w in self.all}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        out = []
        for label, size, order, needed, prefix in self.each:
            if len(words) < needed or here.isdisjoint(prefix):
                continue
            width, own = size * self.spread, len(out)
            rare = sorted(i for w in prefix for i in places[w])
            every = sorted((i, w) for w in order for i in places[w])
            for a, b in self._stretches(rare, width - 1):
                near = every[bisect_left(every, (a,)) : bisect_left(every, (b + 1,))]
                if len({w for _, w in near}) < needed:
                    continue
                for start, end, n in self._blocks(near, needed, width):
                    if len(out) > own and start <= out[-1][2]:
                        out[-1] = (label, out[-1][1], max(out[-1][2], end), max(out[-1][3], n / len(order)))
                    else:
                        out.append((label, start, end, n / len(order)))
        return out

    @staticmethod
    def _stretches(places: list[int], reach: int):
        """(first, last) of the runs of words within ``reach`` of ``places``, in order and apart from each other."""
        first = last = None
        for i in places:
            if first is None:
                first, last = i - reach, i + reach
            elif i - reach <= last + 1:
                last = i + reach
            else:
                yield first, last
                first, last = i - reach, i + reach
        if first is not None:
            yield first, last

    @staticmethod
    def _blocks(near: list[tuple[int, bytes]], needed: int, width: int):
        """(first word, last word, distinct template words) of the blocks that end at each template word and hold
        ``needed`` different ones: as long as they may be, without what adds nothing in front."""
        held: Counter = Counter()
        left = 0
        for right, (end, word) in enumerate(near):
            held[word] += 1
            while near[left][0] <= end - width:
                held[near[left][1]] -= 1
                if not held[near[left][1]]:
                    del held[near[left][1]]
                left += 1
            if len(held) >= needed:
                # The shortest block with as many different words.
                again, start = Counter(held), left
                while again[near[start][1]] > 1:
                    again[near[start][1]] -= 1
                    start += 1
                yield near[start][0], end, len(held)


def phrases_in(words: list[bytes], base=BASE) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in base:
        needle = b" " + phrase.encode() + b" "
        at, word, before = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)
            before = at
            out.append((word, label))
            at = joined.find(needle, at + 1)
    return out


def corpus_counts(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of ``words`` stands in the whole corpus; as many rows as words come to the driver."""

    def counted(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                total.update(filter(words.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` (text, ...) with __tq_scan: a struct of

    n_words; ``phrases``, an array of struct(start, label); ``blocks``, an array of
    struct(label, first, last, containment), places in words; and score: 1 with a phrase, else
    the highest containment of a block found, else 0. A null text counts as
    empty: no words, phrases or blocks. Repeated rows stay; an empty table gives an empty one.
    """
    known = Templates(templates, {}, threshold).all
    counts = corpus_counts(docs, known)

    def scanned(batches):
        every = Templates(templates, counts, threshold)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                phrases, blocks = phrases_in(words, base), every.met(words)
                out.append({
                    "n_words": len(words),
                    "phrases": [{"start": s, "label": x} for s, x in phrases],
                    "blocks": [{"label": x, "first": a, "last": b, "containment": c} for x, a, b, c in blocks],
                    "score": 1.0 if phrases else max([0.0, *(c for *_, c in blocks)]),
                })
            kind = pa.struct([("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "__tq_scan"])

    shape = "struct<n_words:bigint,phrases:array<struct<start:bigint,label:string>>,blocks:array<struct<label:string,first:bigint,last:bigint,containment:double>>,score:double>"
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(scanned, typed.withColumn("__tq_scan", F.lit(None).cast(shape)).schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__tq_scan.*")
    label = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*map(label, c)))), ",")
    starts = F.transform("phrases", lambda x: x["start"])
    return out.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("phrases").alias("base_labels"), joined("phrases", "blocks").alias("labels"), "score",
    )


QUERIES = {"op8_license_scan": op8}
ORACLES: dict[str, str] = {}
