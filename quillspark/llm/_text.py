"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Everything here is a function of single documents, so results don't depend on
how rows are dealt over partitions and batches.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text worked on at once, so that arrays of eight bytes for each fit a core's cache; one longer document is worked on alone.
CHUNK = 250_000

if "pyspark.worker" in sys.modules and sys.platform == "linux":
    # A Python worker lives on between tasks beside the executor's heap: what is freed goes back to the system.
    _libc = ctypes.CDLL(None)
    if hasattr(_libc, "mallopt"):
        for _what, _value in ((-1, 8 << 20), (-3, 4 << 20), (-8, 2)):  # trim threshold, mmap threshold, arenas
            _libc.mallopt(_what, _value)
    pa.set_memory_pool(pa.system_memory_pool())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call unless very long."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out)
        if size <= 2 * CHUNK:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or of one row."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high
        low = high


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of slices of a string column."""
    raw, at = texts(column)
    for low, high in pieces(at, limit):
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs without ASCII white space, A-Z lower-cased: (64-bit hash, row, first byte, end byte) of each."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    edge = at[1:-1]
    edge = edge[edge < len(raw)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    values = low.astype(np.uint64) + np.uint64(1)
    values[~inside] = 0
    values *= powers(_BASE, len(raw))
    sums = np.add.reduceat(values, starts) * powers(_INVERSE, len(raw))[starts]
    rows = np.searchsorted(at, starts, "right") - 1
    return mix(sums ^ (ends - starts).astype(np.uint64)), rows, starts, ends


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words from each word on; only those whose k words are of one row mean anything."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out += hashes[j : j + len(out)] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    return mix(out)


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); a row of fewer words has its whole sequence as one, a row without words none."""
    hashes, rows, _, _ = words(raw, at)
    wide = grams(hashes, rows, k)
    counts = np.bincount(rows, minlength=len(at) - 1) if len(rows) else np.zeros(len(at) - 1, np.int64)
    ends = np.cumsum(counts)
    for row, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n >= k:
            yield row, np.unique(wide[end - n : end - k + 1])
        elif n:
            whole = np.zeros(1, np.uint64)
            for j, h in enumerate(hashes[end - n : end]):
                whole += mix(np.array([h], np.uint64) + np.uint64(j)) * np.uint64(2 * j + 1)
            yield row, mix(whole + np.uint64(n))
        else:
            yield row, np.zeros(0, np.uint64)


def batches(source: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded size, so that what is made from a slice stays small."""
    for batch in source:
        step = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def groups(source: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows with equal first ``keys`` columns (numbers), from rows sorted by them; one group at a time is held."""
    rest: list[pa.RecordBatch] = []
    for batch in source:
        if rest and batch.num_rows and any(rest[0].column(k)[0] != batch.column(k)[0] for k in range(keys)):
            yield pa.concat_batches(rest)
            rest = []
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high < batch.num_rows:
                yield pa.concat_batches([*rest, batch.slice(low, high - low)])
                rest = []
            elif high > low:
                rest.append(batch.slice(low, high - low))
    if rest:
        yield pa.concat_batches(rest)


def squeeze(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The third column's texts as compressed bytes, for the shuffle; other columns stay."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches(source):
        raw, at = texts(batch.column(2))
        view = memoryview(raw)
        packed = [pack.compress(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        others = [batch.column(k) for k in range(3, batch.num_columns)]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), *others], names=[*names[:2], "packed", *names[3:]])
