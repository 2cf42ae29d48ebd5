"""Near-duplicate documents by min-max hashing.

Every document is the set of its k-word shingles. Each of ``PERMUTATIONS``
hash functions gives two signature values, the smallest and the largest hash of
the set, so a signature of 96 values takes 48 evaluations a shingle. Values are
banded four by four, minima with minima and maxima with maxima, as the two ends
of one permutation depend on each other in small sets. A pair at similarity 0.8
misses all 24 bands with probability 3e-6.

1. Documents with one set of shingles collapse to a class before anything is compared.
2. Each band bucket links its members to one of them, its centre: pairs grow with the rows, not with their square. The
   centre is the member that shares most buckets with others, as an original does among its edited copies.
3. Pairs whose signatures are not far below the threshold are confirmed on the full sets, made again from the whole texts,
   which travel compressed; components are formed.
4. Only buckets whose members are still in several components need more. They are cut by size of set, as sets whose sizes
   differ too much can't be near, and into blocks of bounded length; each pair of blocks is compared in one task: by
   signatures, then, where the estimate is not far below the threshold, by sets of 24-bit hashes, which never miss a
   common shingle. What passes is confirmed likewise, so no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._components import connected_components
from quillspark.llm._stage import Stage

PERMUTATIONS = 48
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a block in step 4, and the shingles of all of them together, about.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: How far an estimate may be below the threshold before a pair is left out: over four standard errors.
SLACK = 0.18

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)

_SKETCH = "doc_id long, th long, n_shingles long, f1 long, f2 long, signature binary"
#: Stands for a missing doc_id in keys of joins.
_NO_ID = -(1 << 63)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 48 minima and 48 maxima (uint32); all sets non-empty."""
    high = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        hashed = (high ^ _XOR[k]) * _MULTIPLY[k]
        out[:, k] = np.minimum.reduceat(hashed, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(hashed, starts)
    return out


def _sketch(k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low, high, raw, at in _text.chunks(batch.column(2)):
                sets = [s for _, s in _text.shingles(raw, at, k)]
                full = [i for i, s in enumerate(sets) if len(s)]
                signs = signature([sets[i] for i in full]) if full else np.zeros((0, 2 * PERMUTATIONS), np.uint32)
                found: list = [None] * len(sets)
                for row, i in enumerate(full):
                    found[i] = signs[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, high - low) for c in (0, 1)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(s.sum().view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(_text.mix(s).sum().view(np.int64)) for s in sets], pa.int64()),
                        pa.array(found, pa.binary()),
                    ],
                    names=["doc_id", "th", "n_shingles", "f1", "f2", "signature"],
                )

    return run


def _unpacked(packed: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(x) for x in packed]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return [s for low, high in _text.pieces(at) for _, s in _text.shingles(raw[at[low] : at[high]], at[low : high + 1] - at[low], k)]


def _narrow(k: int):
    """Sets as sorted distinct 24-bit hashes, three bytes each."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source, 500_000):
            out = []
            for full in _unpacked(batch.column(1).to_pylist(), k):
                short = np.unique((full >> np.uint64(40)).astype("<u4"))
                out.append(np.ascontiguousarray(short.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cid", "narrow"])

    return run


def _widen(narrow: bytes) -> np.ndarray:
    wide = np.zeros((len(narrow) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(narrow, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _estimate(threshold: float):
    """Pairs whose sizes allow the threshold and whose signatures are not far below it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            m, n = (batch.column(k).to_numpy() for k in (2, 3))
            keep = np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-6
            if batch.num_rows:
                keep &= (_signatures(batch.column(4)) == _signatures(batch.column(5))).mean(1) >= threshold - SLACK
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _confirm(numerator: int, denominator: int, k: int):
    """Pairs with two compressed texts; those that reach the threshold on their full sets."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(source, 500_000):
            keep = np.zeros(batch.num_rows, bool)
            sets = _unpacked([*batch.column(2).to_pylist(), *batch.column(3).to_pylist()], k)
            for i, (x, y) in enumerate(zip(sets[: batch.num_rows], sets[batch.num_rows :], strict=True)):
                if len(x) > len(y):
                    x, y = y, x
                if denominator * len(x) < numerator * len(y):
                    continue
                where = np.searchsorted(y, x)
                where[where == len(y)] = 0
                both = int((y[where] == x).sum())
                keep[i] = denominator * both >= numerator * (len(x) + len(y) - both)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _blocks(threshold: float):
    """Rows sorted by bucket, level, i, j; pairs of one group that may reach the threshold and are in different components."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _text.groups(source, 4):
            first, second = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            band = group.column(4)[0].as_py()
            block, guest, ids, comps, sizes = (group.column(c).to_numpy(zero_copy_only=False) for c in range(5, 10))
            signs, narrow = _signatures(group.column(10)), group.column(11)
            wide: dict[int, np.ndarray] = {}
            found = []
            right = np.flatnonzero(block == second)
            for i in np.flatnonzero(block == first).tolist():
                n = sizes[i]
                near = (comps[right] != comps[i]) & (np.minimum(sizes[right], n) >= threshold * np.maximum(sizes[right], n) - 1e-6)
                if first == second:
                    near &= ids[right] > ids[i]
                if guest[i]:  # two guests meet in the level that they come from
                    near &= ~guest[right]
                some = right[near]
                if not len(some):
                    continue
                same = signs[some] == signs[i]
                # a pair belongs to the first band that it shares
                keep = (same.mean(1) >= threshold - SLACK) & (same.reshape(len(some), BANDS, ROWS).all(2).argmax(1) == band)
                for k in some[keep].tolist():
                    for x in (i, k):
                        if x not in wide:
                            wide[x] = _widen(narrow[x].as_py())
                    mine, other = wide[i], wide[k]
                    at = np.searchsorted(other, mine)
                    at[at == len(other)] = 0
                    # 24-bit hashes of one set that fall together take at most so many from the count
                    both = int((other[at] == mine).sum()) + max(n - len(mine), sizes[k] - len(other))
                    if both >= threshold * (n + sizes[k] - both) - 1e-6:
                        found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(p[c]) for p in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _classes(docs: DataFrame, words: int, percent: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(one row a document: doc_id, th, n_shingles, f1, f2; one row a class of equal sets: n_shingles, f1, f2, component, component_id)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sketch = stage.save(docs.mapInArrow(_sketch(words), _SKETCH), "sketch")
    stage.expect(sketch.count() * BANDS * 40)
    key = ["n_shingles", "f1", "f2"]
    d = F.coalesce("doc_id", F.lit(_NO_ID)).alias("d")
    classes = sketch.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min(F.struct(d, "th")).alias("at"), F.max("signature").alias("signature"))
    classes = stage.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = 4 * ROWS
    members = classes.select(
        "cid",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring("signature", F.lit(1) + j * size, F.lit(size))))).alias("band", "bucket"),
    )
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stage.save(members.join(buckets, "bucket"), "shared")
    weight = shared.groupBy("cid").agg(F.sum("members").alias("weight"))
    centres = shared.join(weight, "cid").groupBy("bucket").agg(F.max(F.struct("weight", "cid"))["cid"].alias("centre"))
    filled = stage.save(shared.join(centres, "bucket"), "filled")
    pairs = stage.save(filled.where("cid <> centre").select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct(), "pairs")
    # the texts of all classes that may be compared, compressed before they travel
    wanted = classes.join(weight.select("cid"), "cid", "left_semi").select("cid", "at.*")
    packed = docs.select(d, "th", "text").mapInArrow(_text.squeeze, "d long, th long, packed binary")
    texts = packed.hint("merge").join(wanted, ["d", "th"]).groupBy("cid").agg(F.min("packed").alias("packed"))  # rows that repeat a document
    texts = stage.save(texts, "texts")

    def sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        out = pairs
        for side in "ab":
            out = out.join(table.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return out.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        return stage.save(sides(pairs, texts, "packed").mapInArrow(_confirm(percent, 100, words), "a long, b long"), name)

    threshold = percent / 100
    near = stage.save(sides(pairs, classes, "n_shingles", "signature").mapInArrow(_estimate(threshold), "a long, b long"), "near")
    found = links(near, "links")
    component = stage.save(connected_components(spark, found), "components")
    named = filled.select("bucket", "band", "cid").join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    several = [F.min("component").alias("low"), F.max("component").alias("high")]
    rest = named.join(named.groupBy("bucket").agg(*several).where("low <> high").select("bucket"), "bucket")
    # a set is a guest among those up to one over the threshold times as large
    step = max(1 / threshold, 1.01)
    level = F.floor(F.log("n_shingles") / log(step)).cast("long")
    rest = rest.join(classes.select("cid", "n_shingles"), "cid").withColumn("of", F.explode(F.array(F.struct(level.alias("level"), F.lit(False).alias("guest")), F.struct((level + 1).alias("level"), F.lit(True).alias("guest")))))
    rest = stage.save(rest.select("bucket", "band", "cid", "component", "n_shingles", "of.*"), "rest")
    open_groups = rest.groupBy("bucket", "level").agg(F.count(F.lit(1)).alias("n"), *several, F.min("guest").alias("guests")).where("low <> high and not guests")
    long = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK)), BLOCK_SHINGLES / F.pow(F.lit(step), F.col("level"))))
    rest = rest.join(open_groups.select("bucket", "level", F.ceil(F.col("n") / long).cast("int").alias("blocks")), ["bucket", "level"])
    narrow = texts.join(rest.select("cid").distinct(), "cid", "left_semi").mapInArrow(_narrow(words), "cid long, narrow binary")
    narrow = stage.save(narrow, "narrow")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.join(classes.select("cid", "signature").join(narrow, "cid"), "cid")
    sorted_by = ["bucket", "level", "i", "j"]
    rest = rest.select("bucket", "level", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "guest", "cid", "component", "n_shingles", "signature", "narrow")
    more = rest.repartition(*sorted_by).sortWithinPartitions(*sorted_by).mapInArrow(_blocks(threshold), "a long, b long").distinct()
    more = stage.save(more.join(pairs, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        found = found.union(links(more, "more-links"))
        component = stage.save(connected_components(spark, found), "components-2")
    stage.drop("shared", "filled", "narrow", "rest", "pairs", "near", "texts")
    names = component.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    component = component.join(names, "component").withColumnRenamed("node", "cid")
    named = classes.join(component, "cid", "left").select(*key, F.coalesce("component", "cid").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    return sketch.select("doc_id", "th", *key), named


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs: ``doc_id`` (long), ``text``; other columns are not read, whatever their names.

    Returns ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row. Documents are linked when
    100 * intersection >= percent * union of their sets of ``words``-word shingles (A-Z lower-cased, split at ASCII white
    space); fewer words make one shingle. A null or empty text has no shingle, is linked with nothing and stays.
    Rows that repeat a doc_id are judged each by its own text; ties don't matter, as the smallest doc_id names a component.
    A row without a doc_id takes part; its ``component_id`` is null where no row of the component has one, and it is kept only
    then. An empty table gives an empty one.
    """
    rows, named = _classes(docs, words, percent, Stage(docs.sparkSession, "minmax"))
    out = rows.join(named, ["n_shingles", "f1", "f2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: one row of each component of ``near_duplicates`` stays, that
    with the smallest doc_id (rows without one last, of equal ones the text with the smallest hash). Rows without any word stay."""
    stage = Stage(docs.sparkSession, "minmax")
    rows, named = _classes(docs, words, percent, stage)
    d = F.coalesce("doc_id", F.lit(_NO_ID)).alias("d")
    rows = rows.join(named, ["n_shingles", "f1", "f2"]).groupBy("component", d, "th").agg(F.count(F.lit(1)).alias("n"))
    rows = stage.save(rows, "verdicts")
    first = rows.groupBy("component").agg(F.min(F.struct(F.expr(f"d = {_NO_ID}").alias("last"), "d", "th")).alias("first"))
    rows = rows.join(first, "component")
    stays = (F.col("d") == F.col("first.d")) & (F.col("th") == F.col("first.th"))
    lost = stage.save(rows.where(~stays).select("d", "th"), "lost")
    again = stage.save(rows.where(stays & (F.col("n") > 1)).select("d", "th"), "again")
    full = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    full = full.join(lost, ["d", "th"], "left_anti")
    if again.limit(1).count():
        once = full.join(again, ["d", "th"], "left_semi").groupBy("d", "th").agg(F.first("row").alias("row"))
        full = full.join(again, ["d", "th"], "left_anti").select("row").union(once.select("row"))
    return full.select("row.*")
