"""Licence scan: an exact containment join of text blocks with licence templates.

A block is a run of words, ``WINDOW`` times as many as a template has, whatever the line breaks, as a set; a template is found
where a block holds at least ``CONTAINMENT`` of its words. Words have one order in both: those of templates by their frequency in
the whole corpus, rarest first, all others behind them. Of a template with m words, t of which must be there, the rarest that a
block shares is one of its m - t + 1 rarest: only those words are looked up (prefix filter), each as the rarest of its block. Blocks
with fewer than t words of templates are left (length filter); behind the match the template has m - i - 1 words and the block as
many as follow it in the order, and one more than the smaller number must reach t (positional filter). Candidates left are verified
on whole sets, for every block around the match.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import bounded_batches

# Phrases that name a licence, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages by which licences are declared.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd license",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
    ],
    "cc-by-nc": ["licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
}
CONTAINMENT = 0.9
#: Words in a row that are searched for a template, as a multiple of its own: room for a marker at each wrapped line.
WINDOW = 2

_FOLD = bytearray(range(256))
for _b in range(128):
    _FOLD[_b] = 32 if not chr(_b).isalnum() else ord(chr(_b).lower())
_FOLD = bytes(_FOLD)


class Templates:
    """Templates by word order; ``prefix`` maps a word's rank to the templates (number, place) that it opens."""

    def __init__(self, texts: dict[str, list[str]], containment: float, counts: dict[bytes, int]):
        split = [(label, text.encode().translate(_FOLD).split()) for label, some in sorted(texts.items()) for text in some]
        split = [(label, words) for label, words in split if words]
        order = sorted({w for _, words in split for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.labels = [label for label, _ in split]
        self.words = [frozenset(words) for _, words in split]
        self.ranks = [frozenset(self.rank[w] for w in words) for words in self.words]
        self.need = [max(1, int(np.ceil(containment * len(words) - 1e-9))) for words in self.words]
        self.wide = [WINDOW * len(words) for _, words in split]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for number, ranks in enumerate(self.ranks):
            for place, r in enumerate(sorted(ranks)[: len(ranks) - self.need[number] + 1]):
                self.prefix.setdefault(r, []).append((number, place))
        self.opening = frozenset(order[r] for r in self.prefix)

    def passages(self, words: list[bytes]) -> dict[int, float]:
        """Best containment of each template that some block of the text reaches."""
        rank = self.rank
        hits = [(k, rank[w]) for k, w in enumerate(words) if w in rank]
        places = [k for k, _ in hits]
        found: dict[int, float] = {}
        for k, r in hits:
            for number, place in self.prefix.get(r, ()):
                wide, need, size = self.wide[number], self.need[number], len(self.ranks[number])
                low, high = bisect_left(places, k - wide + 1), bisect_right(places, k + wide - 1)
                near = {x for _, x in hits[low:high]}
                if len(near) < need or 1 + min(size - place - 1, sum(x > r for x in near)) < need:
                    continue
                most = self._most(hits[low:high], number)
                if most >= need:
                    found[number] = max(found.get(number, 0.0), most / size)
        return found

    def _most(self, hits: list[tuple[int, int]], number: int) -> int:
        """Most different words of a template that one block among these places holds."""
        ranks, wide = self.ranks[number], self.wide[number]
        mine = [(k, x) for k, x in hits if x in ranks]
        inside: dict[int, int] = {}
        low = most = 0
        for k, x in mine:
            inside[x] = inside.get(x, 0) + 1
            while k - mine[low][0] >= wide:
                first = mine[low][1]
                inside[first] -= 1
                if not inside[first]:
                    del inside[first]
                low += 1
            most = max(most, len(inside))
        return most


def _count(words: list[bytes]):
    """Occurrences of the templates' words."""
    wanted = sorted(words)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(_hashes(wanted))
        back = {int(h): w for h, w in zip(_hashes(wanted), wanted, strict=True)}
        total = np.zeros(len(keys), np.int64)
        for batch in source:
            for _, _, raw, at in _text.chunks(batch.column(0)):
                folded = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8)
                hashes, _, _, _ = _text.words(folded, at)
                place = np.searchsorted(keys, hashes)
                place[place == len(keys)] = 0
                total += np.bincount(place[keys[place] == hashes], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([back[int(k)] for k in keys], pa.binary()), pa.array(total)], names=["word", "n"])

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return _text.words(np.frombuffer(b"".join(words), np.uint8), at)[0]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read.

    Returns for every row ``doc_id``, ``n_words``, ``n_base`` (places where the words of a phrase stand consecutively),
    ``first_word``, ``last_word`` (smallest and largest such place, words from 0; else null), ``base_labels``, ``labels``
    (with those of templates found; distinct, sorted, comma-joined, else empty), ``score`` (1 with a phrase, else the best
    containment found, 0 without). Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters.
    Null counts as empty text. Repeated rows give repeated results, an empty table an empty one. Templates are
    few and given by the caller; they are what is broadcast.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = {w for some in templates.values() for t in some for w in t.encode().translate(_FOLD).split()}
    counts: dict[bytes, int] = {}
    if words:
        rows = docs.select("text").mapInArrow(_count(list(words)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        counts = {bytes(r["word"]): r["n"] for r in rows}
    shared = spark.sparkContext.broadcast(Templates(templates, containment, counts))
    named = [(b" " + p.encode().translate(_FOLD) + b" ", label) for p, label in phrases.items()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _text.batches(source):
            raw, at = _text.texts(batch.column(1))
            folded = raw.tobytes().translate(_FOLD)
            out: list[list] = [[] for _ in range(7)]
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = folded[low:high]
                words = text.split()
                flat = b" " + b" ".join(words) + b" "
                places, base = [], set()
                for phrase, label in named:
                    k, before, passed = flat.find(phrase), 0, 0
                    while k >= 0:
                        passed += flat.count(b" ", before, k)
                        before = k
                        places.append(passed)
                        base.add(label)
                        k = flat.find(phrase, k + 1)
                found = {} if known.opening.isdisjoint(words) else known.passages(words)
                labels = base | {known.labels[n] for n in found}
                score = 1.0 if places else max(found.values(), default=0.0)
                values = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
