"""Removal of long byte strings that occur more than once, by a distributed merge sort of suffixes.

Sorting every suffix of a corpus would move hundreds of times its size. Only the
suffixes at anchors are sorted: of each ``span``-byte window the start of its
smallest hashed 48-byte gram. Equal windows have their anchor at the same
offset, so a repeated window always meets its copies at an anchor, and one
suffix in about 180 is enough. Consecutive windows of one anchor form a run.

1. ``runs``: each window run with the hash of its gram and a fingerprint of the run's bytes. Runs whose gram occurs
   once hold no repeated window. Runs with equal gram and fingerprint are equal: whatever they cover is repeated.
2. Runs that share the gram but not all bytes (the borders of copies) are compared once per different run. Tasks sort
   their suffixes, write them as front-coded runs (length of the common prefix, remaining bytes), and exchange
   these. Receivers merge them with a loser tree whose nodes know the common prefix with the last output, so a known
   prefix is never compared again. Neighbours' common prefixes give the extension to the right of the anchor; the
   bytes before it, carried along, that to the left; together they reach ``span`` where windows are equal.
3. A gram with more than ``GROUP`` different runs is too much for pairwise extensions. Its runs are cut into blocks of
   windows, at the same distances from the anchor in all of them. What all windows of a block have in common is its core:
   a block whose core is in no other run holds no repeated window, and one whose bytes are all in another run holds no
   other. Only the blocks between, where copies end, are cut further, down to single windows. The rows that are counted
   are these blocks, and spread over all tasks.

Passages of a number of words go the same way: each word becomes a code of ``CODE`` bytes from its hash, so that as many words
are a string of fixed length whatever their own lengths; of what repeats, whole words count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._stage import Stage

GRAM = 48
#: Different runs of one gram that are extended against each other.
GROUP = 128
#: Windows of a block of a crowded gram's run, from the first cut to the last.
BLOCKS = (64, 8, 1)
#: Bytes (of 7 bits) that stand for a word.
CODE = 5
#: Suffixes that a receiver merges.
MERGED = 40_000
#: Bytes of a document worked on at once; longer ones are cut with an overlap of one window less a byte.
PART = 250_000
_BITS = 26
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_HEAD = struct.Struct(">HHHHqHHq")


def _parts(raw: np.ndarray, at: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, base offset in it, bytes, starts): whole rows together, or a part of a long one."""
    low, n = 0, len(at) - 1
    while low < n:
        if at[low + 1] - at[low] > PART:
            begin = 0
            while True:
                end = min(begin + PART, int(at[low + 1] - at[low]))
                yield low, begin, raw[at[low] + begin : at[low] + end], np.array([0, end - begin])
                if end == at[low + 1] - at[low]:
                    break
                begin = end - span + 1
            low += 1
            continue
        high = low + 1
        while high < n and at[high + 1] - at[low] <= PART:
            high += 1
        yield low, 0, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def _prefix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _text.powers(_BASE, len(raw)), out=out[1:])
    return out


def window_runs(raw: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, gram hash, fingerprint, smallest and largest distance from window start to anchor) of each run."""
    n, wide = len(raw), span - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, none, none
    prefix, back = _prefix(raw), _text.powers(_INVERSE, n + 1)
    gram = _text.mix((prefix[GRAM:] - prefix[:-GRAM]) * back[: n - GRAM + 1])
    key = (gram >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(gram), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: n - span + 1], low[wide - width : wide - width + n - span + 1])
    low = low[: n - span + 1]
    ok = np.zeros(n - span + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= span:
            ok[a : b - span + 1] = True
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, none, none, none
    anchor = (low[starts] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, anchor = starts[first], starts[last], anchor[first]
    seen = (prefix[s1 + span] - prefix[s0]) * back[s0]
    seen = _text.mix(seen ^ _text.mix(((anchor - s0) * 65536 + (s1 - s0)).astype(np.uint64)))
    rows = np.searchsorted(at, s0, "right") - 1
    return rows, anchor - at[rows], gram[anchor].view(np.int64), seen.view(np.int64), anchor - s1, anchor - s0


def _find_runs(span: int):
    names = ["doc_id", "th", "anchor", "gram", "seen", "near", "far"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source, PART):
            raw, at = _text.texts(batch.column(2))
            for low, base, part, starts in _parts(raw, at, span):
                rows, anchor, gram, seen, near, far = window_runs(part, starts, span)
                take = pa.array(rows + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor + base), pa.array(gram), pa.array(seen), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))],
                    names=names,
                )

    return run


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, the first ``known`` bytes being equal."""
    top = min(len(x), len(y))
    if x[known:top] == y[known:top]:
        return top
    low, high = known, top
    while high - low > 8:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    while x[low] == y[low]:
        low += 1
    return low


def write_run(entries: list[tuple]) -> bytes:
    """Front-coded sorted suffixes. entries: (suffix, reversed left bytes, seen, near, far, copies), sorted."""
    out, before, left = [], b"", b""
    for suffix, behind, seen, near, far, copies in entries:
        same, also = common(before, suffix), common(left, behind)
        out += [_HEAD.pack(same, len(suffix) - same, also, len(behind) - also, seen, near, far, copies), suffix[same:], behind[also:]]
        before, left = suffix, behind
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, tuple]]:
    """(common prefix with the entry before, entry)."""
    at, before, left = 0, b"", b""
    while at < len(run):
        same, more, also, rest, seen, near, far, copies = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        before = before[:same] + run[at : at + more]
        left = left[:also] + run[at + more : at + more + rest]
        at += more + rest
        yield same, (before, left, seen, near, far, copies)


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """All entries in order, each with its common prefix with the one before, by a loser tree."""
    k = len(runs)
    sources = [read_run(r) for r in runs]
    heads: list = [None] * k
    known = [0] * k

    def advance(i: int) -> None:
        known[i], heads[i] = next(sources[i], (-1, None))

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        if heads[j] is None or heads[i] is None:
            return (j, i) if heads[i] is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        x, y = heads[i][0], heads[j][0]
        same = common(x, y, known[i])
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            known[j] = same
            return i, j
        known[i] = same
        return j, i

    for i in range(k):
        advance(i)
    losers, level = [0] * max(1, k), {}
    for i in range(k):
        level[k + i] = i
    for node in range(k - 1, 0, -1):
        level[node], losers[node] = play(level[2 * node], level[2 * node + 1])
    winner = level[1] if k > 1 else 0
    while k and heads[winner] is not None:
        yield known[winner], heads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _read_parts(span: int):
    """For each document its packed bytes and the runs to be compared; emits front-coded runs by receiver."""

    def entries(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor()
        for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
            text = unpack.decompress(packed.as_py())
            for w in wanted.as_py():
                yield text, w

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source):
            to: dict[int, list] = {}
            for text, w in entries(batch):
                a = w["anchor"]
                suffix = struct.pack(">Q", w["gram"] % (1 << 64)) + text[a : a + span - w["near"]]
                to.setdefault(w["receiver"], []).append((suffix, text[a - w["far"] : a][::-1], w["seen"], w["near"], w["far"], w["copies"]))
            runs = {k: write_run(sorted(v)) for k, v in to.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(runs), pa.int32()), pa.array(list(runs.values()), pa.binary())], names=["receiver", "run"])

    return run


def _bodies(span: int):
    """For each run of a crowded gram the bytes of all its windows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _text.batches(source, 500_000):
            out: list[tuple] = []
            for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
                text = unpack.decompress(packed.as_py())
                out += [(w["gram"], w["seen"], w["near"], w["far"], text[w["anchor"] - w["far"] : w["anchor"] - w["near"] + span]) for w in wanted.as_py()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["gram", "seen", "near", "far", "body"])

    return run


def _blocks(span: int, wide: int, size: int):
    """For each run of a crowded gram its blocks of ``size`` windows inside those of ``wide`` windows that ``within`` names by their
    smallest distance: fingerprints of the block's core and of all its bytes, largest and smallest distance from window start to anchor."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source, PART):
            gram, seen, near, far, bodies, within = (batch.column(k) for k in range(6))
            bodies = bodies.to_pylist()
            at = np.cumsum([0, *map(len, bodies)])
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            prefix, back = _prefix(raw), _text.powers(_INVERSE, len(raw) + 1)
            near, far = near.to_numpy().astype(np.int64), far.to_numpy().astype(np.int64)
            found = [(k, low) for k, (least, most, blocks) in enumerate(zip(near.tolist(), far.tolist(), within.to_pylist(), strict=True)) for w in blocks for low in range(max(w, least // size * size), min(w + wide, most + 1), size)]
            row, low = np.array(found, np.int64).reshape(-1, 2).T
            # the core ends at the same distance in every run, whatever windows the run has
            high = np.minimum(low + size - 1, span - GRAM)
            most, least = np.minimum(high, far[row]), np.maximum(low, near[row])
            anchor = at[row] + far[row]

            def fingerprint(a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
                return _text.mix((prefix[b] - prefix[a]) * back[a] ^ _text.mix(salt.astype(np.uint64))).view(np.int64)

            core = fingerprint(anchor - low, anchor - high + span, low)
            whole = fingerprint(anchor - most, anchor - least + span, most * 65536 + least)
            cols = [gram.take(pa.array(row)), seen.take(pa.array(row)), pa.array(low.astype(np.int32)), pa.array(core), pa.array(whole), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "seen", "low", "core", "whole", "most", "least"])

    return run


def _crowded(bodies: DataFrame, span: int, stage: Stage) -> DataFrame:
    """bodies: as _bodies makes them, saved. ``gram``, ``seen``, ``most``, ``least`` of runs that hold repeated windows."""
    rows, wide, found = bodies.withColumn("within", F.array(F.lit(0))), span, []
    for size in BLOCKS:
        blocks = rows.select("gram", "seen", "near", "far", "body", "within").mapInArrow(_blocks(span, wide, size), "gram long, seen long, low int, core long, whole long, most int, least int")
        blocks = stage.save(blocks, f"blocks-{size}")
        # of equal blocks one goes on, for those that have a part in common with it
        kinds = blocks.groupBy("gram", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"), F.min("low").alias("low"))
        found.append(blocks.join(kinds.where("n > 1").select("gram", "core", "whole"), ["gram", "core", "whole"]).select("gram", "seen", "most", "least"))
        shared = kinds.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "core")
        within = kinds.join(shared, ["gram", "core"], "left_semi").groupBy("gram", "seen").agg(F.collect_list("low").alias("within"))
        rows, wide = bodies.join(within, ["gram", "seen"]), size
    return reduce(DataFrame.union, found).groupBy("gram", "seen").agg(F.max("most").alias("most"), F.min("least").alias("least"))


def extend(group: list[tuple], same: list[int], span: int) -> list[tuple[int, int, int]]:
    """(seen, largest, smallest distance of a repeated window's start before the anchor) of the single members of one gram.

    group: merged entries; same[i]: common prefix of i and i-1, the 8 bytes of the gram's hash included.
    """
    out = []
    for i, (_, left, seen, near, far, copies) in enumerate(group):
        if copies > 1:  # wholly repeated
            continue
        most, least = -1, span
        for step in (1, -1):
            j, right = i, 1 << 30
            while True:
                j += step
                if not 0 <= j < len(group):
                    break
                right = min(right, same[max(j, j - step)] - 8)
                if right < span - far:
                    break
                before = common(left, group[j][1])
                if before + right >= span:
                    most, least = max(most, before), min(least, span - right)
        if most >= 0:
            out.append((seen, most, max(least, near)))
    return out


def _merge(span: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[bytes] = []
        now = None
        for batch in source:
            for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now and runs:
                    yield resolved(runs)
                    runs = []
                now = k
                runs.append(r)
        if runs:
            yield resolved(runs)

    def resolved(runs: list[bytes]) -> pa.RecordBatch:
        out: list[tuple] = []
        group: list[tuple] = []
        same: list[int] = []

        def close() -> None:
            if len(group) > 1:
                gram = struct.unpack(">q", group[0][0][:8])[0]
                out.extend((gram, *x) for x in extend(group, same, span))

        for shared, entry in merge_runs(runs):
            if shared < 8 + GRAM:
                close()
                group, same = [], []
            group.append(entry)
            same.append(shared)
        close()
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "seen", "most", "least"])

    return run


def union_spans(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans merged, in order."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], min(s["high"], n)) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _in_bytes(spans: list[dict], text: bytes) -> list[dict]:
    """The spans, those of words as the bytes from the first word to the end of the last."""
    if not any(s["words"] for s in spans):
        return spans
    _, _, starts, ends = _text.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return [{"low": int(starts[s["low"]]), "high": int(ends[s["high"] - 1])} if s["words"] else s for s in spans]


def _apply(as_text: bool):
    """Compressed texts and their spans to what is left; as text, what a cut has left of a character goes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source, 500_000):
            yield cut(batch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        cols: list[list] = [[], [], [], []]
        others = [batch.column(k) for k in range(3, batch.num_columns)]
        for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
            text = unpack.decompress(packed.as_py())
            gone = union_spans(_in_bytes(spans.as_py() or [], text), len(text))
            rest, at = [], 0
            for low, high in gone:
                rest.append(text[at:low])
                at = high
            rest.append(text[at:])
            cols[0].append(len(text))
            cols[1].append(sum(b - a for a, b in gone))
            cols[2].append([{"low": a, "high": b} for a, b in gone])
            left = b"".join(rest)
            cols[3].append(left.decode("utf-8", "ignore") if as_text else left)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.string() if as_text else pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", *batch.schema.names[3:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *others], names=names)

    return run


def _through(*steps):
    """Several steps over batches as one, so that a task needs one Python worker for all."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            source = step(source)
        return source

    return run


def _long(span: int):
    """Rows whose third column has so many bytes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pc.greater_equal(pc.binary_length(batch.column(2)), span))

    return run


def repeated_spans(docs: DataFrame, span: int, stage: Stage, *code) -> DataFrame:
    """docs: ``doc_id``, ``th``, ``text`` without nulls. Rows of ``doc_id``, ``th``, ``low``, ``high``, which may overlap. code: steps over
    batches that texts go through first."""
    runs = stage.save(docs.mapInArrow(_through(*code, _find_runs(span)), "doc_id long, th long, anchor long, gram long, seen long, near int, far int"), "runs")
    stage.expect(runs.count() * 60)
    different = runs.groupBy("gram", "seen", "near", "far").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "anchor")).alias("at"))
    grams = different.groupBy("gram").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("members")).where("n > 1").select("gram", "members")
    different = stage.save(different.join(grams, "gram").select("gram", "seen", "near", "far", "copies", "at.*", "members"), "different")
    whole = different.where("copies > 1").select("gram", "seen", F.col("far").alias("most"), F.col("near").alias("least"))
    different = different.where("members > 1")
    receivers = max(1, -(-different.count() // MERGED))
    usual, crowd = different.where(F.col("members") <= GROUP), different.where(F.col("members") > GROUP)

    def at_text(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "gram", "seen", "near", "far", "copies", F.pmod("gram", F.lit(receivers)).cast("int").alias("receiver"))).alias("wanted"))
        # rows that repeat a document meet before they travel
        packed = docs.mapInArrow(_through(*code, _long(span), _text.squeeze), "doc_id long, th long, packed binary").groupBy("doc_id", "th").agg(F.min("packed").alias("packed"))
        return packed.join(wanted, ["doc_id", "th"]).select("packed", "wanted")

    sent = at_text(usual).mapInArrow(_read_parts(span), "receiver int, run binary")
    sent = sent.repartition(min(receivers, 4096), "receiver").sortWithinPartitions("receiver")
    found = whole.union(sent.mapInArrow(_merge(span), "gram long, seen long, most int, least int"))
    if crowd.limit(1).count():
        bodies = stage.save(at_text(crowd).mapInArrow(_bodies(span), "gram long, seen long, near int, far int, body binary"), "bodies")
        few = Stage(docs.sparkSession, "crowded")
        few.files = max(docs.sparkSession.sparkContext.defaultParallelism, receivers)
        found = found.union(_crowded(bodies, span, few).join(whole, ["gram", "seen"], "left_anti"))
    found = stage.save(found.distinct(), "found")
    spans = runs.join(found, ["gram", "seen"])
    return spans.select("doc_id", "th", (F.col("anchor") - F.col("most")).alias("low"), (F.col("anchor") - F.col("least") + span).alias("high"))


def _code(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The third column's words as codes of ``CODE`` bytes each; the other two stay."""
    for batch in _text.batches(source):
        for low, high, raw, at in _text.chunks(batch.column(2)):
            hashes, rows, _, _ = _text.words(raw, at)
            codes = np.stack([(hashes >> np.uint64(7 * k)) & np.uint64(127) for k in range(CODE)], 1).astype(np.uint8)
            offsets = np.searchsorted(rows, np.arange(high - low + 1)).astype(np.int64) * CODE
            text = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), text], names=["doc_id", "th", "text"])


def repeated_words(docs: DataFrame, words: int, stage: Stage) -> DataFrame:
    """docs: ``doc_id``, ``th``, ``text``. Rows of ``doc_id``, ``th``, ``low``, ``high`` in words, which may overlap."""
    spans = repeated_spans(docs, words * CODE, stage, _code)
    # windows that start between two words are of one word less
    spans = spans.select("doc_id", "th", F.ceil(F.col("low") / CODE).alias("low"), F.floor(F.col("high") / CODE).alias("high"))
    return spans.where(F.col("high") - F.col("low") >= words)


def remove_repeats(docs: DataFrame, span: int = 400, carry: tuple[str, ...] = (), words: int | None = None, as_text: bool = False) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read, but for those named in ``carry``.

    Returns for every row ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (array of low, high: maximal removed runs of
    bytes), ``kept`` (the remaining bytes; with ``as_text`` the whole characters of them), and ``carried`` (struct of the columns
    in carry) if there are any. A byte goes if a ``span``-byte string over it also starts elsewhere in the table, the same document
    included; all strings are judged on the input. Null counts as empty text; texts shorter than ``span`` stay whole; rows that
    repeat a document are copies of it like any others. An empty table gives an empty one. With ``words`` a passage of so many
    words in a row (runs without ASCII white space, A-Z lower-cased) goes too if it also starts elsewhere, however few bytes it has.
    """
    if not GRAM < span < 2000:
        raise ValueError("span must be over 48 and under 2000")
    if words is not None and not GRAM < words * CODE < 2000:
        raise ValueError("words must be over 9 and under 400")
    stage = Stage(docs.sparkSession, "suffixes")
    others = [F.struct(*carry).alias("carried")] if carry else []
    # a null doc_id gets a number for the joins, and is null again at the end
    full = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)
    full = full.select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), "text", F.col("id").isNull().alias("none"), *full.columns[2:])
    plain = full.select("doc_id", "th", "text")
    spans = repeated_spans(plain, span, stage).select("doc_id", "th", F.col("low").cast("long"), F.col("high").cast("long"), F.lit(False).alias("words"))
    if words is not None:
        spans = spans.union(repeated_words(plain, words, Stage(docs.sparkSession, "word-suffixes")).withColumn("words", F.lit(True)))
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("low", "high", "words")).alias("found"))
    more = ", none boolean" + (f", carried {full.schema['carried'].dataType.simpleString()}" if carry else "")
    packed = full.mapInArrow(_text.squeeze, "doc_id long, th long, packed binary" + more)
    both = packed.join(spans, ["doc_id", "th"], "left")
    out = both.select("doc_id", "packed", "found", *full.columns[3:])
    out = out.mapInArrow(_apply(as_text), f"doc_id long, n_bytes long, n_removed long, spans array<struct<low:long,high:long>>, kept {'string' if as_text else 'binary'}" + more)
    return out.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")
