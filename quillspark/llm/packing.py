"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible-function bounds.

Documents are tokenised once and cut into pieces of at most ``capacity`` tokens;
from then on only lengths are handled. Pieces are dealt by a hash into
partitions of about ``ITEMS``, each packed by best-fit decreasing. A partition
that needs no more sequences than its lower bound is certified and done, but for
its emptiest sequence. The others give up all sequences with room left; these are dealt anew into partitions
of about ``ITEMS``, exchanging documents, and packed again; the better packing
stays, for ``ROUNDS`` rounds at most. ``certificate`` holds the whole result against the bound.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import Stage

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
ITEMS = 20_000
ROUNDS = 3
#: Parts of words whose ids a worker keeps, about 35 bytes each; beyond that it starts anew.
KEPT = 1_500_000
#: Bytes of text tokenised at once.
CHUNK = 2_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, part long, open boolean"

# What a byte is to a word: letters of the first two Unicode blocks, then marks, make a word that the tokenizer cuts at just that place.
_OTHER, _SPACE, _LETTER, _MARK = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]] = _SPACE
_KIND[np.r_[65:91, 97:123]] = _LETTER
_KIND[list(b".,!?;:%&#$*|()+=/-")] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_workers: dict[str, Words] = {}


def parts(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts of the texts' words, whether each is of letters or marks alone, how many parts each text has).

    Words are cut at spaces and line feeds; any other white space stays inside and is left to the tokenizer. A word of letters
    and then marks is lower-cased and cut between the two; any other word stays as it is.
    """
    n = len(raw)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, bool), np.zeros(len(at) - 1, np.int64)
    kind = _KIND[raw]
    low = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    lead, after = lead[(after != 0x97) & (after != 0xB7)], after[(after != 0x97) & (after != 0xB7)]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    upper = lead[after < 0x9F] + 1
    low[upper] = raw[upper] + 32
    space = kind == _SPACE
    first = ~space
    first[1:] &= space[:-1]
    edge = at[1:-1]
    edge = edge[edge < n]
    first[edge] = ~space[edge]
    words = np.flatnonzero(first)
    if not len(words):
        return pa.array([], pa.string()), np.zeros(0, bool), np.zeros(len(at) - 1, np.int64)
    mark, letter = kind == _MARK, kind == _LETTER
    odd = (kind == _OTHER) | (first & mark)
    odd[1:] |= letter[1:] & mark[:-1] & ~first[1:]
    odd = np.maximum.reduceat(odd, words)
    cut = first.copy()
    cut[1:] |= mark[1:] & letter[:-1]
    size = np.diff(np.append(words, n))[odd]
    whole = np.repeat(words[odd] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    cut[whole] = first[whole]
    low[whole] = raw[whole]
    starts = np.flatnonzero(cut)
    places = np.zeros(n + 1, np.int32)
    np.cumsum(~space, out=places[1:])
    offsets = np.append(places[starts], places[-1]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[~space]))
    plain = ~odd[np.searchsorted(words, starts, "right") - 1]
    return found, plain, np.diff(np.searchsorted(starts, at))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _keys(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    raw, at = _text.texts(strings)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _text.powers(_BASE, len(raw)), out=sums[1:])
    return _text.mix((sums[at[1:]] - sums[at[:-1]]) * _text.powers(_INVERSE, len(raw) + 1)[at[:-1]] ^ np.diff(at).astype(np.uint64))


class Words:
    """Ids of texts by their parts: each different part of a chunk of texts is looked up once, by its hash, and the tokenizer asked only
    for new ones."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # part 0 is the end of a text
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(1, np.int32), np.ones(1, np.int32)
        self.pool = np.zeros(1, np.uint32)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned 32-bit ids of all texts, each with its end, where each text's ids end)."""
        found, plain, counts = parts(raw, at)
        coded = found.dictionary_encode()
        index, different = coded.indices.to_numpy(), coded.dictionary
        simple = np.zeros(len(different), bool)
        simple[index] = plain
        place = self._places(different, simple)
        n = len(counts)
        ends = np.cumsum(counts) + np.arange(n)
        all_parts = np.zeros(len(index) + n, np.int32)
        inner = np.ones(len(all_parts), bool)
        inner[ends] = False
        all_parts[inner] = place[index]
        size = self.count[all_parts]
        stop = np.cumsum(size, dtype=np.int32)
        ids = self.pool[np.repeat(self.first[all_parts] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        return ids, stop[ends].astype(np.int64)

    def encode_long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for one text, chunk by chunk."""
        spaces, low, out = np.flatnonzero((raw == 32) | (raw == 10)), 0, []
        while low < len(raw):
            high = len(raw)
            if high - low > CHUNK:
                k = np.searchsorted(spaces, low + CHUNK)  # the chunk ends with the space that comes next
                high = int(spaces[k]) + 1 if k < len(spaces) else high
            out.append(self.encode(raw[low:high], np.array([0, high - low]))[0][:-1])
            low = high
        ids = np.concatenate([*out, np.zeros(1, np.uint32)])
        return ids, np.array([len(ids)])

    def _places(self, different: pa.Array, simple: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(different) > KEPT:
            self._forget()
        keys = _keys(different)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        place = np.empty(len(keys), np.int32)
        place[known] = self.places[at[known]]
        for some, ask in ((~known & simple, self._ask_joined), (~known & ~simple, self._ask)):
            some = np.flatnonzero(some)
            names = different.take(pa.array(some)).to_pylist()
            found = [ask(names[low : low + 4096]) for low in range(0, len(names), 4096)]
            if found:
                ids, size = (np.concatenate(x) for x in zip(*found, strict=True))
                place[some] = len(self.first) + np.arange(len(some))
                self.first = np.append(self.first, (len(self.pool) + np.cumsum(size) - size).astype(np.int32))
                self.count = np.append(self.count, size.astype(np.int32))
                self.pool = np.append(self.pool, ids)
        new = np.flatnonzero(~known)
        new = new[np.argsort(keys[new])]
        self.keys, self.places = np.insert(self.keys, at[new], keys[new]), np.insert(self.places, at[new], place[new])
        return place

    def _ask_joined(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them are each part's) of parts that the tokenizer doesn't cut before merging: read as one text, as
        the last id of each marks its end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(names) else self._ask(names)

    def _ask(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for f in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _tokenise(path: str, capacity: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = Words(path)
        words = _workers[path]
        for batch in source:
            for low, high, raw, at in _text.chunks(batch.column(1), CHUNK):
                ids, ends = words.encode_long(raw) if len(raw) > CHUNK else words.encode(raw, at)
                size = np.diff(ends, prepend=0)
                counts = -(-size // capacity)
                owner = np.repeat(np.arange(high - low), counts)
                piece = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                start = piece * capacity
                length = np.minimum(capacity, size[owner] - start)
                view, places = memoryview(ids.astype("<u4").tobytes()), 4 * ((ends - size)[owner] + start)
                crc = [zlib.crc32(view[a : a + b]) for a, b in zip(places.tolist(), (4 * length).tolist(), strict=True)]
                doc = batch.column(0).take(pa.array(owner + low))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing has fewer bins: the best of the dual feasible functions that round sizes near the ends (one for each
    threshold) and of those that round to multiples of 1/k. times: how often each size occurs, else once."""
    if not len(sizes):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, sizes, 1 if times is None else times)
    x = np.arange(capacity + 1)
    at_least = np.cumsum(count[::-1])[::-1]
    volume = np.concatenate([[0], np.cumsum(count * x)])
    eps = np.arange(0, capacity // 2 + 1)
    large = np.where(eps > 0, at_least[np.minimum(capacity, capacity - eps + 1)], 0)
    middle = volume[capacity - eps + 1] - volume[eps]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * x
        # k * capacity times the function, so that everything stays whole
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-(count * value).sum() // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item and the room left in each bin. Each item goes to the fullest bin that takes it;
    equal items in the order given, among equally full bins to the one that became so last."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    left = np.zeros(n, np.int64)
    for room, some in enumerate(by_room):
        left[some] = room
    return bins, offsets, left


def _pack(capacity: int, turn: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", na_position="first")
        sizes = pdf["length"].to_numpy()
        part = int(pdf["part"].iat[0])
        bins, offsets, left = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        if turn and pdf["sequence_id"].nunique() <= len(left):
            old, bins = np.unique(pdf["sequence_id"].to_numpy(), return_inverse=True)
            offsets = pdf["offset"].to_numpy()
            left = capacity - np.bincount(bins, sizes, len(old)).astype(np.int64)
        again = (left > 0) & (len(left) > bound) & (not last)
        if not last and left.max() > 0:  # a certified partition gives up its emptiest sequence, for those of the others
            again[left.argmax()] = True
        return pdf.assign(sequence_id=(turn << 60) + (part << 26) + bins, offset=offsets, open=again[bins])

    return run


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences of a packing, the lower bound of all its pieces together). The lengths are counted, at most ``capacity`` of them."""
    lengths = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    return used, lower_bound(lengths["length"].to_numpy(), capacity, lengths["n"].to_numpy())


def tokenise(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs: ``doc_id`` (long), ``text`` (null: empty). One row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tokenise(tokenizer, capacity), _PIECES)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read.

    Returns one row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    Null and empty texts are one piece of the end id alone. Only documents longer than ``capacity`` are cut. Repeated rows
    are packed each for itself; an empty table gives an empty one. ``tokenizer``: a path, or a name in public_tokenizers;
    it must treat white space as the end of a word.
    """
    stage = Stage(docs.sparkSession, "packing")
    pieces = stage.save(tokenise(docs, tokenizer, capacity), "pieces")
    parts = max(1, -(-pieces.count() // ITEMS))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts))).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    done = None
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS or parts == 1
        packed = stage.save(rows.groupBy("part").applyInPandas(_pack(capacity, turn, last), _PACKED), f"packed-{turn}")
        closed = packed.where("not open")
        done = closed if done is None else done.union(closed)
        if last:
            break
        rows = packed.where("open").drop("open")
        parts = max(1, -(-rows.count() // ITEMS))
        # whole sequences change partitions, so that documents meet others than before
        rows = rows.withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts)))
    stage.drop("pieces")
    return done.drop("part", "open")
