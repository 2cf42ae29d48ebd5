"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 counts which byte follows which, letters lower-cased and white space made one.
The 63 most frequent bytes of the training texts have a class each; any other is coded as the class of the rest and then, at equal
cost, which of them it is. The trees are frozen: method C escapes with exclusion give every (context, class) pair its code length
once, so scoring a text adds up exact code lengths, whatever its length, without state.

The trees are counted over a bounded sample of labelled rows (``TRAIN_BYTES`` a language), which bounds what is broadcast for each
language at any corpus size; every context that occurs in it has code lengths of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import bounded_batches

#: Byte classes, a power of two.
CLASSES = 64
ORDER = 3
#: About so many bytes of text are learned from for each language; whole texts are drawn, in the order of a hash.
TRAIN_BYTES = 4_000_000
#: By how many nats the null model has to code a text shorter than every language does, before it counts as in none.
EVIDENCE = 4.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Byte to class, by descending counts of lower-cased bytes, smaller byte first; class 0 for the rest."""
    counts = counts.copy()
    counts[0] = 0
    for upper in range(65, 91):
        counts[upper + 32] += counts[upper]
        counts[upper] = 0
    for space in (9, 10, 11, 12, 13):
        counts[32] += counts[space]
        counts[space] = 0
    order = np.argsort(-counts, kind="stable")[: CLASSES - 1]
    out = np.zeros(256, np.uint8)
    for k, byte in enumerate(order.tolist()):
        if counts[byte]:
            out[byte] = k + 1
    out[65:91] = out[97:123]
    out[9:14] = out[32]
    return out


def contexts(kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte its three predecessors in the same text and itself, six bits each; class 0 stands before a text."""
    x = kinds.astype(np.int32)
    out = x.copy()
    for back in range(1, ORDER + 1):
        moved = np.zeros_like(x)
        moved[back:] = x[:-back]
        for j in range(back):
            edge = at[:-1] + j
            moved[edge[edge < at[1:]]] = 0
        out |= moved << (6 * back)
    return out


def _escape(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order by method C with exclusion; n, lower: (contexts, classes)."""
    seen = n > 0
    total, kinds = n.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    left = np.maximum(1e-9, 1.0 - (lower * seen).sum(1, keepdims=True))
    scale = np.maximum(1, total + kinds)
    p = np.where(seen, n / scale, kinds / scale * lower / left)
    p = np.where(seen.all(1, keepdims=True), n / np.maximum(1, total), p)
    return np.where(total > 0, p, lower)


class Model:
    """``languages``, byte classes, and code lengths: ``rows`` maps an order-3 context to its row of ``lengths``."""

    def __init__(self, languages: list[str], kinds: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams: for each language the four-class keys and their counts."""
        self.languages, self.kinds = languages, kinds
        # bytes of the rest: those that are neither a class's own nor folded into another
        rest = float(np.log(max(1, 256 - 26 - 5 - len(np.unique(kinds[kinds > 0])))))
        seen = sum((np.bincount(key & (CLASSES - 1), n, CLASSES) for key, n in grams), np.zeros(CLASSES))
        self.plain = (-np.log((seen + 0.5) / (seen.sum() + 0.5 * CLASSES))).astype(np.float32)
        self.plain[0] += rest
        total = np.zeros(CLASSES**ORDER)
        for key, n in grams:
            total += np.bincount(key >> 6, n, CLASSES**ORDER)
        known = np.flatnonzero(total)
        short = CLASSES ** (ORDER - 1)
        self.rows = (np.arange(CLASSES**ORDER) & (short - 1)).astype(np.int32)
        self.rows[known] = short + np.arange(len(known), dtype=np.int32)
        self.lengths, self.own = [], []
        for key, n in grams:
            p = np.full((1, CLASSES), 1.0 / CLASSES)
            for order in range(ORDER):
                size = CLASSES**order
                p = _escape(np.bincount(key & (size * CLASSES - 1), n, size * CLASSES).reshape(size, CLASSES), p if order == 0 else np.tile(p, (CLASSES, 1)))
            # of the known contexts those that this language has; in the others its order 2 holds
            mine, place = np.unique(key >> 6, return_inverse=True)
            deep = self.rows[mine] >= short
            ours = mine[deep]
            at = np.cumsum(deep) - 1
            use = deep[place]
            top = _escape(np.bincount((at[place[use]] << 6) | (key[use] & 63), n[use], len(ours) * CLASSES).reshape(-1, CLASSES), p[ours & (short - 1)])
            own = np.concatenate([np.arange(short), known & (short - 1)]).astype(np.int32)
            own[self.rows[ours]] = short + np.arange(len(ours), dtype=np.int32)
            self.own.append(own)
            lengths = -np.log(np.maximum(1e-12, np.concatenate([p.ravel(), top.ravel()]))).astype(np.float32)
            lengths[::CLASSES] += rest
            self.lengths.append(lengths)

    def nats(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            c = contexts(self.kinds[raw], at)
            row, kind = self.rows[c >> 6], c & 63
            for k, (own, lengths) in enumerate(zip(self.own, self.lengths, strict=True)):
                out[full, k] = np.add.reduceat(lengths[(own[row] << 6) | kind], at[full], dtype=np.float64)
        return out

    def plain_nats(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text by the frequency of bytes alone, in no language's order."""
        out = np.zeros(len(at) - 1)
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            out[full] = np.add.reduceat(self.plain[self.kinds[raw]], at[full], dtype=np.float64)
        return out

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its posterior under equal priors, bits a byte) of each text."""
        nats = self.nats(raw, at)
        best = nats.argmin(1)
        least = nats[np.arange(len(nats)), best]
        score = 1.0 / np.exp(np.maximum(-700.0, least[:, None] - nats)).sum(1)
        return best, score, least / np.log(2) / np.maximum(1, at[1:] - at[:-1])


def _count_grams(names: list[str]):
    """Counts of four consecutive lower-cased bytes, by language; byte 0 stands before a text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(names)}
        for batch in _text.batches(source):
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for low, high, raw, at in _text.chunks(batch.column(1)):
                x = _LOWER[raw].astype(np.int64)
                gram = x | (np.repeat(langs[low:high], np.diff(at)) << 32)
                for back in range(1, ORDER + 1):
                    moved = np.zeros_like(x)
                    moved[back:] = x[:-back]
                    for j in range(back):
                        edge = at[:-1] + j
                        moved[edge[edge < at[1:]]] = 0
                    gram |= moved << (8 * back)
                gram, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram >> 32), pa.array(gram & 0xFFFFFFFF), pa.array(n)], names=["lang", "gram", "n"])

    return run


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """docs: ``lang``, ``text`` of the rows to learn from; rows without either are left out.

    Each language's texts are drawn by a hash of the text until about ``train_bytes``; every label is learned. Without
    rows the model knows no language.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.where("lang is not null and text is not null and text <> ''")
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    rows = docs.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.min(place).alias("first")).collect()
    sizes = {r["lang"]: r["size"] for r in rows}
    if not sizes:
        return Model([], np.zeros(256, np.uint8), [])
    names = sorted(sizes)
    first = {r["lang"]: r["first"] for r in rows}
    # every language has its first text at least, however long
    below = {n: max(first[n] + 1, int(min(1.0, train_bytes / max(1, sizes[n])) * 1_000_003)) for n in names}
    drawn = docs.where(place < F.create_map(*[F.lit(x) for n in names for x in (n, below[n])])[F.col("lang")])
    grams = drawn.mapInArrow(_count_grams(names), "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (grams.column(k).to_numpy() for k in ("lang", "gram", "n"))
    seen = np.zeros(256, np.int64)
    np.add.at(seen, gram & 255, n)
    kinds = classes_of(seen)
    key = np.zeros(len(gram), np.int64)
    for back in range(ORDER + 1):
        key |= kinds[(gram >> (8 * back)) & 255].astype(np.int64) << (6 * back)
    order = np.argsort(lang, kind="stable")
    cut = np.searchsorted(lang[order], np.arange(len(names) + 1))
    return Model(names, kinds, [(key[order[a:b]], n[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read.

    Returns for every row ``doc_id``, ``lang_pred``, ``score``, ``bits_per_byte``. ``und`` with score 0 where the text is
    null or has no letter, or where the model knows no language. ``score`` is the posterior of the shortest code under
    equal priors; ties go to the first language by name. ``bits_per_byte`` is null for empty texts. Repeated rows give
    repeated results, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _text.batches(source):
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for low, high, raw, at in _text.chunks(batch.column(1)):
                ok = letters[low:high] & bool(model.languages)
                if model.languages:
                    best, score, bits = model.predict(raw, at)
                    names = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
                else:
                    score, bits, names = np.zeros(high - low), np.zeros(high - low), ["und"] * (high - low)
                cols = [batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(bits, mask=(at[1:] == at[:-1]) | (not model.languages))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a known language: it has a letter, and the frequencies of bytes alone (a
    null model of all languages) don't code it shorter than its best language by ``EVIDENCE`` or more, so very short texts stay.
    Null and empty texts go; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _text.batches(source):
            letters = pc.fill_null(pc.match_substring_regex(batch.column(place), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            known = np.zeros(batch.num_rows, bool)
            if model.languages:
                for low, high, raw, at in _text.chunks(batch.column(place)):
                    known[low:high] = model.nats(raw, at).min(1) < model.plain_nats(raw, at) + EVIDENCE
            yield batch.filter(pa.array(known & letters))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
