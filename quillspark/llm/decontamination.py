"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size, each compared with all
documents. Every n-gram of an item is a seed, however frequent, so what one group of copies keeps does not hide
another. Around the seeds that a document holds, the item is aligned with the document's words, unless too few of the
item's words are there to reach the threshold (an upper bound, so nothing is lost): copies that were edited or paraphrased
keep some seeds and most of the alignment. The score is the part of the item's best possible alignment that is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import bounded_batches

SEED_WORDS = 3
THRESHOLD = 0.5
#: Items compared in one pass over the documents, and bytes of them, about; both bound what is broadcast.
BLOCK, BLOCK_BYTES = 20_000, 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_FOLD = bytearray(range(256))
for _b in range(128):
    _FOLD[_b] = 32 if not chr(_b).isalnum() else ord(chr(_b).lower())
_FOLD = bytes(_FOLD)
_RESULT = "doc_id long, item_id long, score double, first_word long, last_word long"


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word: runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters."""
    hashes, rows, _, _ = _text.words(np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8), at)
    return hashes, rows


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local alignment score, end in item, end in text); the first of equal ends."""
    steps = np.arange(len(text) + 1) * -GAP
    above = np.zeros(len(text) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
        above = row
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best local alignment in the text."""
    score, i, j = smith_waterman(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = smith_waterman(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


class Items:
    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.n = n
        column = pa.array(texts, pa.string())
        raw, at = _text.texts(column)
        hashes, rows = word_hashes(raw, at)
        cut = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.ids = ids
        self.words = [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        # an item of fewer words has all of them as its seed
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.opens: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            for g in np.unique(_text.grams(w, w, min(n, len(w)))).tolist() if len(w) else ():
                self.opens.setdefault(g, []).append(k)
        self.keys = np.array(sorted(self.opens), np.uint64)

    def found(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, rows, words that open a gram, its place among ``keys``)."""
        hashes, rows = word_hashes(raw, at)
        hits, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes:
            if len(hashes) < n:
                continue
            grams = _text.grams(hashes, rows, n)
            place = np.searchsorted(self.keys, grams)
            place[place == len(self.keys)] = 0
            hit = np.flatnonzero((self.keys[place] == grams) & (rows[: len(grams)] == rows[n - 1 :]))
            hits.append(hit)
            places.append(place[hit])
        hit, place = np.concatenate(hits), np.concatenate(places)
        order = np.argsort(hit, kind="stable")
        return hashes, rows, hit[order], place[order]


def _align_all(shared, threshold: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        keys = items.keys.tolist()
        for batch in _text.batches(source):
            out: list[tuple] = []
            for low, _, raw, at in _text.chunks(batch.column(1)):
                hashes, rows, hit, place = items.found(raw, at)
                starts = np.searchsorted(rows, np.arange(len(at)))
                near: dict[tuple[int, int], list[int]] = {}
                for h, p in zip(hit.tolist(), place.tolist(), strict=True):
                    for k in items.opens[keys[p]]:
                        near.setdefault((int(rows[h]), k), []).append(h)
                for (row, k), places in near.items():
                    item, best = items.words[k], (0, 0, 0)
                    reach = 2 * len(item)
                    begin = places[0]
                    for now, after in zip(places, [*places[1:], 1 << 60], strict=True):
                        if after - now > reach:  # the next seed belongs to another passage
                            a, b = max(starts[row], begin - reach), min(starts[row + 1], now + reach)
                            around = hashes[a:b]
                            # a word of the item that matches adds MATCH at most; others add nothing
                            score, i, j = align(item, around) if np.isin(item, around).sum() >= threshold * len(item) else (0, 0, 0)
                            if score > best[0]:
                                best = (score, a + i - starts[row], a + j - starts[row])
                            begin = after
                    part = best[0] / (MATCH * len(item))
                    # a part of a short item is chance
                    if part >= (threshold if len(item) >= items.n else 1.0):
                        out.append((low + row, items.ids[k], part, int(best[1]), int(best[2]) - 1))
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; benchmark: ``item_id`` (long), ``text``; other columns are not read.

    Returns one row for each document and item whose best alignment (match 2, mismatch and gap -1) reaches ``threshold`` of
    the item's own: ``doc_id``, ``item_id``, ``score`` (to 1), ``first_word``, ``last_word`` (of the aligned passage, words
    from 0). Null and empty texts hold nothing; items of fewer than ``seed_words`` words match only where all of them stand in a
    row, an item without words nothing. Of equal alignments the first counts. Repeated rows give repeated results; an empty table on
    either side gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        block = Items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), seed_words)
        found = docs.mapInArrow(_align_all(spark.sparkContext.broadcast(block), threshold), _RESULT)
        out = found if out is None else out.union(found)
    return out
