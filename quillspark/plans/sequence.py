"""Document-order windows. Every function takes a DataFrame whose order is given by columns, never by partitions.

``keys`` name one document (or paragraph, or table); a window never spans two, so work is dealt by these keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _names(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _before(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def parents(df: DataFrame, keys: str | list[str], order: str, level: str, levels: int) -> DataFrame:
    """Adds ``parent``: the nearest row before with a smaller level (0 to levels - 1), null at the top. One sort for all levels."""
    w = _before(_names(keys), order)
    last = F.array(*[F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(levels)])
    return df.withColumn("_last", last).withColumn("parent", F.array_max(F.slice("_last", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(levels), F.col(level)))))).drop("_last")


def outline_numbers(df: DataFrame, keys: str | list[str], order: str, level: str, depth: int = 7) -> DataFrame:
    """Adds ``number``: the outline counter at a row of level 1 to depth; a higher row restarts the levels below it.
    Rows of other levels must have been left out."""
    names = _names(keys)
    w = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # of each level L the group is the number of rows above it so far; ranks within (level, group) are the counters
    group = F.array(*[F.count(F.when(F.col(level) < k, 1)).over(w) for k in range(1, depth + 1)])
    df = df.withColumn("_group", F.get(group, (F.col(level) - 1).cast("int")))
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*names, level, "_group").orderBy(order)).cast("long")).drop("_group")


def restarting_counter(df: DataFrame, keys: str | list[str], order: str, restart: Column, value: Column, start: Column) -> DataFrame:
    """Adds ``counter``: from ``start`` on, plus one a row; where ``restart`` holds it takes ``value``."""
    names = _names(keys)
    w = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_run", F.count(F.when(restart, 1)).over(w))
    inside = Window.partitionBy(*names, "_run").orderBy(order)
    first = F.first(F.when(restart, value)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("counter", (F.coalesce(first, start) + F.row_number().over(inside) - 1).cast("long")).drop("_run")


def numbered(df: DataFrame, keys: str | list[str], order: str, name: str = "number", start: int = 1) -> DataFrame:
    """Adds a row number within the keys."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*_names(keys)).orderBy(order)) + (start - 1)).cast("long"))


def vertical_resets(df: DataFrame, keys: str | list[str], order: str, vertical: str) -> DataFrame:
    """Adds ``reset``: a position near the top, or clearly above the last known one; never at the first known position."""
    before = F.last(vertical, ignorenulls=True).over(_before(_names(keys), order))
    now = F.col(vertical)
    reset = before.isNotNull() & now.isNotNull() & ((now < 0.1) | ((before > 0.1) & (now < before - 0.1)))
    return df.withColumn("reset", F.coalesce(reset, F.lit(False)))


def pages(df: DataFrame, keys: str | list[str], order: str, vertical: str, explicit: str, page_change: str, content_height: float | str) -> DataFrame:
    """Adds ``page`` (from 1) and ``reason`` of the break before a row: explicit, page_def_change, vertical_reset or vertical_overflow.
    content_height: a number, or a column that is constant within the keys.

    A break forgets the position before and the maximum since the last break, so the state is folded over each document's rows in
    order: rows are dealt by document and sorted, and one pass over them holds the state of one document and a batch of rows.
    """
    names = _names(keys)
    height = F.col(content_height) if isinstance(content_height, str) else F.lit(float(content_height))
    rows = df.select(*names, order, F.col(vertical).cast("double").alias("_v"), F.coalesce(explicit, F.lit(False)).alias("_e"), F.coalesce(page_change, F.lit(False)).alias("_c"), height.cast("double").alias("_h"))
    schema = T.StructType([rows.schema[n] for n in (*names, order)] + [T.StructField("page", T.LongType()), T.StructField("reason", T.StringType())])
    n = len(names)

    def fold(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page, last, most = None, 0, None, 0.0
        for batch in source:
            key = list(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True))
            found: list[int] = []
            why: list[str | None] = []
            for k, v, told, changed, high in zip(key, *(batch.column(j).to_pylist() for j in range(n + 1, n + 5)), strict=True):
                reason = None
                if k != now:
                    now, page, last, most = k, 1, None, 0.0
                elif told:
                    reason = "explicit"
                elif changed:
                    reason = "page_def_change"
                elif v is not None and last is not None and (v < 0.1 or (last > 0.1 and v < last - 0.1)):
                    reason = "vertical_reset"
                elif v is not None and v > high and most > 0:
                    reason = "vertical_overflow"
                if reason:
                    page, last, most = page + 1, None, 0.0
                last, most = (last, most) if v is None else (v, max(most, v))
                found.append(page)
                why.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(found, pa.int64()), pa.array(why, pa.string())], names=[f.name for f in schema])

    return rows.repartition(*names).sortWithinPartitions(*names, order).mapInArrow(fold, schema)


def segment_ends(df: DataFrame, keys: str | list[str], start: str, length: Column) -> DataFrame:
    """Adds ``end``: the next larger start, else the length of the text; equal starts end together. Starts are distinct before the next
    one is looked up, so no window holds more than a row."""
    names = _names(keys)
    starts = df.select(*names, start).distinct()
    ends = starts.withColumn("_end", F.lead(start).over(Window.partitionBy(*names).orderBy(start)))
    return df.join(ends, [*names, start], "left").withColumn("end", F.coalesce("_end", length)).drop("_end")


def style_segments(texts: DataFrame, shapes: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``start``, ``end``, ``shape_id``: a text cut where its style changes. texts: key, ``length``; shapes: key, ``position``,
    ``shape_id``; positions beyond the end cut nothing, and text before the first position has no style."""
    cuts = shapes.join(texts, key).where(F.col("position").between(F.lit(0), F.col("length"))).select(key, F.col("position").alias("start"))
    ends = texts.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("start"))
    places = cuts.select(key, F.col("start").cast("long").alias("start")).union(ends).distinct()
    w = Window.partitionBy(key).orderBy("start")
    runs = places.withColumn("end", F.lead("start").over(w)).where("end is not null")
    last = shapes.groupBy(key, F.col("position").cast("long").alias("start")).agg(F.max("shape_id").alias("_shape"))
    both = runs.join(last, [key, "start"], "left")
    return both.withColumn("shape_id", F.last("_shape", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_shape")


def overflows(df: DataFrame, keys: str | list[str], order: str, top: str, bottom: Column, content_height: float) -> DataFrame:
    """Adds ``overflow``: a box that ends below the page's content, unless it is the first thing on it."""
    most = F.coalesce(F.max(top).over(_before(_names(keys), order)), F.lit(0.0))
    return df.withColumn("overflow", F.coalesce((bottom > content_height) & (most > 0), F.lit(False)))


def column_addresses(df: DataFrame, keys: str | list[str], order: str, span: str, explicit: str) -> DataFrame:
    """Adds ``address``: the explicit column of a cell, else where the cell before it ends."""
    names = _names(keys)
    w = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_island", F.count(explicit).over(w))
    inside = Window.partitionBy(*names, "_island").orderBy(order)
    base = F.coalesce(F.first(explicit).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    moved = F.coalesce(F.sum(span).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("address", (base + moved).cast("long")).drop("_island")


def recovered_rows(df: DataFrame, keys: str | list[str], order: str, column: str, rows: Column) -> DataFrame:
    """Adds ``row``: a new one whenever the column does not grow, at most the last."""
    names = _names(keys)
    back = F.col(column) <= F.lag(column).over(Window.partitionBy(*names).orderBy(order))
    df = df.withColumn("_new", F.when(back, 1).otherwise(0))
    run = F.sum("_new").over(Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("row", F.least(run, rows - 1).cast("long")).drop("_new")


def gaps(df: DataFrame, keys: str | list[str], low: str, high: str, first: Column, last: Column) -> DataFrame:
    """Maximal parts of [first, last) that no interval covers: keys, ``gap_low``, ``gap_high``. first and last are constant within keys."""
    names = _names(keys)
    w = Window.partitionBy(*names).orderBy(low, high)
    reached = F.greatest(F.coalesce(F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)), first), first)
    inner = df.withColumn("gap_low", reached).withColumn("gap_high", F.least(F.col(low), last)).select(*names, "gap_low", "gap_high")
    tail = df.groupBy(*names).agg(F.greatest(F.max(high), F.max(first)).alias("gap_low"), F.max(last).alias("gap_high"))
    return inner.unionByName(tail).where("gap_low < gap_high")


def cleaned_offsets(df: DataFrame, keys: str | list[str], position: str, size: str, kept: str) -> DataFrame:
    """Adds ``shift``: what earlier control characters take away from later positions, and ``cleaned``: the position without them."""
    w = _before(_names(keys), position)
    shift = F.coalesce(F.sum(F.col(kept) - F.col(size)).over(w), F.lit(0)).cast("long")
    return df.withColumn("shift", shift).withColumn("cleaned", (F.col(position) + F.col("shift")).cast("long"))


def empty_rank(df: DataFrame, keys: str | list[str], order: str, empty: Column) -> DataFrame:
    """Adds ``image_index``: how many empty segments are before this one."""
    return df.withColumn("image_index", F.count(F.when(empty, 1)).over(_before(_names(keys), order)).cast("long"))


def separators(df: DataFrame, keys: str | list[str], order: str, inline: str) -> DataFrame:
    """Adds ``separator`` before each part: a line break between inline parts, else a blank line; none before the first."""
    before = F.lag(inline).over(Window.partitionBy(*_names(keys)).orderBy(order))
    return df.withColumn("separator", F.when(before.isNull(), F.lit("")).when(before & F.col(inline), F.lit("  \n")).otherwise(F.lit("\n\n")))


def joined(df: DataFrame, keys: str | list[str], order: str, text: Column | str, separator: str, name: str) -> DataFrame:
    """Text of each group in order."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("t"))))
    return df.groupBy(*_names(keys)).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(name))
