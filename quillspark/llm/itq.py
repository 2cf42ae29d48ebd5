"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations that make sign codes balanced are learned by iterative quantisation
on a bounded sample. Codes are cut into substrings, one hash table each. Where there are many vectors the first bits of a
substring deal them into buckets of about ``BUCKET``, and in a bucket those meet whose other bits differ by at most two: a
pair of vectors at the threshold differs in few bits, so it does in some table. There are as many rotations as keep the
chance of a pair at the threshold at ``RECALL``. A vector travels once a table, as two 64-bit words of its code; pairs that
are near enough in both are confirmed by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text
from quillspark.llm._components import connected_components
from quillspark.llm._stage import Stage

#: Vectors that the rotations are learned from, drawn in the order of a hash.
SAMPLE = 10_000
#: Independent rotations at least, each giving 64 bits.
ROTATIONS = 2
#: Chance of a pair at the threshold to share an entry, by the binomial law, at any number of vectors.
RECALL = 0.999
#: Vectors of a bucket, about.
BUCKET = 32_768
#: Microseconds, about, that a row, a look-up and a pair to compare take.
ROW, LOOK, PAIR = 3.0, 0.01, 0.06
#: Bits of a substring within a bucket up to which vectors are looked up in an array of all values.
DENSE = 20
#: Pairs that are compared at once, and rows of entries that a task takes, about.
PAIRS, ENTRIES = 1_000_000, 400_000
ITERATIONS = 30


def iterative_quantisation(vectors: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Projection (dimensions x bits) to the main directions, rotated so that signs lose least."""
    rng = np.random.default_rng(seed)
    dims = vectors.shape[1]
    width = min(bits, dims)
    out = []
    while sum(p.shape[1] for p in out) < bits:
        _, main = np.linalg.eigh(vectors.T @ vectors)
        main = main[:, ::-1][:, :width]
        low = vectors @ main
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(low @ rotation >= 0, 1.0, -1.0).T @ low)
            rotation = v.T @ u.T
        out.append(main @ rotation)
    return np.hstack(out)[:, :bits]


def encode(vectors: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words, the first sign in the lowest bit."""
    signs = vectors @ projections >= 0
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([(signs[:, 64 * k : 64 * k + 64] * weights).sum(1, dtype=np.uint64) for k in range(projections.shape[1] // 64)], 1)


def _unit(column: pa.Array, n: int) -> np.ndarray:
    return units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by its largest component first, so that squares of huge or tiny ones stay in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def flipped(threshold: float) -> float:
    """Chance of a bit to differ between vectors at the threshold."""
    return float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)


def prefix_bits(n: int) -> int:
    """How many bits deal the vectors into buckets."""
    return max(0, ceil(log(n / BUCKET) / log(2))) if n else 0


def rotations(width: int, threshold: float, prefix: int = 0) -> int:
    """How many rotations let a pair at the threshold, in some substring, have the same prefix and differ by two of the other bits at
    most, but for 1 - ``RECALL``."""
    flip, rest = flipped(threshold), width - prefix
    miss = 1 - (1 - flip) ** prefix * sum(comb(rest, k) * flip**k * (1 - flip) ** (rest - k) for k in range(min(2, rest) + 1))
    tables = 1 if miss <= 1 - RECALL else ceil(log(1 - RECALL) / log(miss))
    return max(ROTATIONS, -(-tables // (64 // width)))


def best_width(n: int, threshold: float) -> int:
    """The width with least work: rows, look-ups, and pairs at random to compare."""
    prefix = prefix_bits(n)

    def work(w: int) -> float:
        rest = w - prefix
        masks = 1 + rest + comb(rest, 2)
        return rotations(w, threshold, prefix) * (64 // w) * (ROW + masks * (LOOK + PAIR * n / 2 ** (w + 1)))

    return min(range(prefix + 8, max(prefix + 9, min(33, prefix + DENSE + 1))), key=work)


def substrings(n: int, threshold: float, width: int | None = None) -> list[tuple[int, int]]:
    """(first bit, width) of each table; a substring stays within one 64-bit word."""
    width = width or best_width(n, threshold)
    return [(64 * w + width * k, width) for w in range(rotations(width, threshold, min(prefix_bits(n), width))) for k in range(64 // width)]


def meetings(sub: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """sub: sorted numbers of so many bits. Places of all pairs that differ by two bits at most, each once, in portions."""
    n = len(sub)
    stop = np.cumsum(np.bincount(sub, minlength=1 << width)) if width <= DENSE else None
    bits = [1 << k for k in range(width)]
    for mask in [0, *bits, *(x | y for k, x in enumerate(bits) for y in bits[:k])]:
        at = sub ^ mask
        who = np.flatnonzero(at > sub) if mask else np.arange(n)
        at = at[who]
        if stop is None:
            low, high = np.searchsorted(sub, at, "left"), np.searchsorted(sub, at, "right")
        else:
            low, high = np.where(at > 0, stop[at - 1], 0), stop[at]
        if not mask:
            low = who + 1
        some = np.flatnonzero(high > low)
        who, low, size = who[some], low[some], (high - low)[some]
        ends = np.cumsum(size)
        begin = 0
        while begin < len(who):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            count = size[begin:end]
            first = low[begin:end] - (ends[begin:end] - count - done)
            yield np.repeat(who[begin:end], count), np.repeat(first, count) + np.arange(count.sum())
            begin = end


def _links(classes: DataFrame, n: int, threshold: float, width: int | None, stage: Stage, name: str) -> DataFrame:
    """``a``, ``b``, ``m``, ``n``: linked classes of one length, and how many vectors each holds."""
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    unit = _unit(sample, len(sample))
    tables = substrings(n, threshold, width)
    width = tables[0][1]
    prefix = min(prefix_bits(n), width)
    rest = width - prefix
    turns = tables[-1][0] // 64 + 1
    projections = np.hstack([iterative_quantisation(unit, 64, seed) for seed in range(turns)])
    # Bits that differ at the threshold angle follow a binomial law on average; four deviations more lose next to nothing
    # and still rule out almost all pairs at random.
    flip = flipped(threshold)
    near = int(np.ceil(128 * flip + 4 * np.sqrt(128 * flip * (1 - flip))))
    whole = np.uint64((1 << width) - 1)

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table: its bucket, and the table's word of the code with the first word, or the second with the first."""
        for batch in source:
            if batch.num_rows:
                codes = encode(_unit(batch.column(1), batch.num_rows), projections)
                for t, (low, _) in enumerate(tables):
                    own = codes[:, low // 64]
                    bucket = (own >> np.uint64(low % 64) & whole) >> np.uint64(rest) | np.uint64(t << prefix)
                    cols = [np.ascontiguousarray(x).view(np.int64) for x in (bucket, own, codes[:, 0 if low >= 64 else 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), batch.column(0), pa.array(cols[1]), pa.array(cols[2])], names=["bucket", "rep", "own", "other"])

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _text.groups(source, 1):
            t = rows.column(0)[0].as_py() >> prefix
            low = tables[t][0]
            rep, own, other = (rows.column(k).to_numpy() for k in (1, 2, 3))
            own, other = own.view(np.uint64), other.view(np.uint64)
            sub = (own >> np.uint64(low % 64) & np.uint64((1 << rest) - 1)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            rep, own, other = rep[order], own[order], other[order]
            # a pair that meets in a table before, of the same word or of the first one, was taken there
            before = [k for k, _ in tables[:t] if k // 64 == low // 64], [k for k, _ in tables[:t] if k < 64 <= low]
            for i, j in meetings(sub[order], rest):
                x, y = own[i] ^ own[j], other[i] ^ other[j]
                good = np.flatnonzero(np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= near)
                i, j, x, y = i[good], j[good], x[good], y[good]
                new = np.ones(len(i), bool)
                for word, lows in zip((x, y), before, strict=True):
                    for k in lows:
                        part = word >> np.uint64(k % 64) & whole
                        new &= (part >> np.uint64(rest) > 0) | (np.bitwise_count(part) > 2)
                a, b = rep[i[new]], rep[j[new]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    entries = classes.select("rep", "v").mapInArrow(deal, "bucket long, rep long, own long, other long")
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-n * len(tables) // ENTRIES))
    entries = entries.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    pairs = stage.save(entries.mapInArrow(meet, "a long, b long").distinct(), f"pairs-{name}")

    def rerank(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                u, v = (_unit(batch.column(k), batch.num_rows) for k in (2, 3))
                yield batch.filter(pa.array((u * v).sum(1) >= threshold)).select([0, 1, 4, 5])

    # joins by sorting: what looks small as a file may be large in the driver, through which a broadcast goes
    full = pairs.join(classes.select(F.col("rep").alias("a"), F.col("v").alias("u"), F.col("copies").alias("m")).hint("merge"), "a")
    full = full.join(classes.select(F.col("rep").alias("b"), "v", F.col("copies").alias("n")).hint("merge"), "b").select("a", "b", "u", "v", "m", "n")
    return stage.save(full.mapInArrow(rerank, "a long, b long, m long, n long"), f"links-{name}")


def near_vectors(table: DataFrame, threshold: float = 0.9, width: int | None = None) -> DataFrame:
    """table: ``vec_id`` (long), ``embedding`` (array of float or double); other columns are not read.

    Returns for every row ``vec_id``, ``n_links``, ``component_id``, ``kept``. Vectors are linked at a cosine of at least
    ``threshold`` in double precision; those of different lengths have none, and each length is searched for itself, so lengths
    should be few. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors form one
    class before the search, so copies are counted, not paired. Rows that repeat a vec_id count as rows, a row without one takes
    part but names no component; an empty table gives an empty one. ``width`` sets the bits of a substring (8 to 32; else chosen by
    the number of vectors).
    """
    spark = table.sparkSession
    stage = Stage(spark, "itq")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = rows.where("fine").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # a class has a number of its own, as one vec_id may stand for several vectors
    classes = stage.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    stage.expect(sum(n * d for d, n in sizes.items()) * 40)
    found = [_links(classes.where(F.size("v") == d), n, threshold, width, stage, str(d)) for d, n in sorted(sizes.items()) if n > 1]
    links = spark.createDataFrame([], "a long, b long, m long, n long")
    for some in found:
        links = links.union(some)
    linked = links.select(F.col("a").alias("rep"), F.col("n").alias("other")).union(links.select("b", "m")).groupBy("rep").agg(F.sum("other").alias("others"))
    component = connected_components(spark, links.select("a", "b")).withColumnRenamed("node", "rep")
    names = component.join(classes.select("rep", "first").hint("merge"), "rep").groupBy("component").agg(F.min("first").alias("name"))
    component = component.join(names.hint("merge"), "component")
    named = classes.join(linked.hint("merge"), "rep", "left").join(component.hint("merge"), "rep", "left")
    named = named.select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "first").alias("component_id"))
    out = rows.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x + F.lit(0.0)))).join(named.hint("merge"), "v", "left")
    component_id = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component_id, component_id.isNull())
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), kept.alias("kept"))
