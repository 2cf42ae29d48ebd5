"""Joins by position: as-of, interval and zone joins without a cross product.

Positions are cut into bins of a width that suits the data; an interval is entered in every bin that it touches, a
point in its own, and the join is an equality on (keys, bin) with the exact bounds as a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def as_of(left: DataFrame, right: DataFrame, keys: str | list[str], at: str, value: str, tie: str | None = None) -> DataFrame:
    """Adds to each left row the ``value`` of the last right row at or before it (column ``at`` on both sides), null if there is none.

    One shuffle and one sort of both sides together. Of right rows at one position the last by ``tie`` counts, or, with a tie of
    ``-name``, the first.
    """
    names = _names(keys)
    order = [F.col(at)]
    right = right.groupBy(*names, at).agg(
        (F.min_by(value, tie[1:]) if tie and tie.startswith("-") else F.max_by(value, tie) if tie else F.max(value)).alias("_value")
    )
    marked = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)["_value"])).withColumn("_side", F.lit(1))
    both = marked.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*names).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_value", "_side")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: str | list[str], at: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of a point and a half-open interval [low, high) that holds it."""
    names = _names(keys)
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    i = intervals.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    i = i.select(*[F.col(n).alias(f"_k_{n}") for n in names], "_bin", *[c for c in i.columns if c not in names and c != "_bin"]).withColumnRenamed("_bin", "_other")
    on = F.col("_bin") == F.col("_other")
    for n in names:
        on = on & (F.col(n) == F.col(f"_k_{n}"))
    on = on & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    return p.join(i, on, how).drop("_bin", "_other", *[f"_k_{n}" for n in names])


def last_zone(cells: DataFrame, zones: DataFrame, key: str, cell_id: list[str], row: str, column: str) -> DataFrame:
    """Adds ``zone_fill`` to cells: the fill of the last zone (by ``zone_ord``) with fill not 0 that covers (row, column), else null.

    zones: key, zone_ord, start_row, end_row, start_col, end_col (inclusive), fill. A zone is entered in each of its rows, so the join
    is an equality on (key, row) with the columns as a filter.
    """
    used = zones.where("fill <> 0 and start_row <= end_row").select(F.col(key).alias("_key"), "zone_ord", "fill", "start_col", "end_col", F.explode(F.sequence("start_row", "end_row")).alias("_row"))
    hit = (F.col("_key") == F.col(key)) & (F.col("_row") == F.col(row)) & F.col(column).between(F.col("start_col"), F.col("end_col"))
    found = cells.select(key, *cell_id, row, column).distinct().join(used, hit).groupBy(key, *cell_id).agg(F.max_by("fill", "zone_ord").alias("zone_fill"))
    return cells.join(found, [key, *cell_id], "left")


def shapes_in_segments(segments: DataFrame, shapes: DataFrame, keys: str | list[str], width: int = 64) -> DataFrame:
    """Styles of a line: keys, ``start``, ``position`` (from the line's start on), ``shape_id``. segments: keys, ``start``, ``end``; shapes:
    keys, ``at``, ``shape_id``. The style that holds at the start stands at 0, if there is one, then those that change inside."""
    names = _names(keys)
    lines = segments.select(*names, "start", "end").distinct()
    inside = points_in_intervals(shapes.select(*names, "at", "shape_id"), lines, names, "at", "start", "end", width).where("at > start")
    inside = inside.select(*names, "start", (F.col("at") - F.col("start")).cast("long").alias("position"), "shape_id")
    carried = as_of(lines.select(*names, F.col("start").alias("at")), shapes.select(*names, "at", "shape_id"), names, "at", "shape_id").where("shape_id is not null")
    return carried.select(*names, F.col("at").alias("start"), F.lit(0).cast("long").alias("position"), "shape_id").unionByName(inside)


def covered_cells(cells: DataFrame, key: str, row: str, column: str, row_span: str, column_span: str) -> DataFrame:
    """Cells whose own place no cell before them, in (row, column) order, claims by its span. Spans are cut into grid places, so
    each place finds its first owner by one aggregation. Claims of hidden cells count, as spans of one table don't overlap."""
    order = F.struct(F.col(row).alias("r"), F.col(column).alias("c"))
    places = cells.select(
        key, order.alias("owner"),
        F.explode(F.sequence(F.col(row), F.col(row) + F.greatest(F.col(row_span), F.lit(1)) - 1)).alias("_r"),
        F.col(column).alias("_c0"), F.greatest(F.col(column_span), F.lit(1)).alias("_cs"),
    )
    places = places.select(key, "owner", "_r", F.explode(F.sequence(F.col("_c0"), F.col("_c0") + F.col("_cs") - 1)).alias("_c"))
    claims = places.groupBy(key, "_r", "_c").agg(F.array_sort(F.collect_set("owner")).alias("_owners"))
    joined = cells.join(claims.select(key, F.col("_r").alias(row), F.col("_c").alias(column), "_owners"), [key, row, column], "left")
    return joined.where(F.element_at("_owners", 1) == order).drop("_owners")


def first_candidate(wanted: DataFrame, streams: DataFrame, keys: list[str], candidate: str, rank: str) -> DataFrame:
    """Of several candidate names a row, in order of rank, the first that exists."""
    w = Window.partitionBy(*keys).orderBy(rank)
    return wanted.join(streams, [keys[0], candidate]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positional(left: DataFrame, right: DataFrame, keys: str | list[str], order: str) -> DataFrame:
    """The n-th left row of each key with the n-th right row; right columns null beyond."""
    names = _names(keys)
    w = Window.partitionBy(*names).orderBy(order)
    a = left.withColumn("ordinal", F.row_number().over(w))
    b = right.withColumn("ordinal", F.row_number().over(w)).drop(order)
    return a.join(b, [*names, "ordinal"], "left")


def not_in_cells(paragraphs: DataFrame, cells: DataFrame, key: str, identity: str, value: str) -> DataFrame:
    """Paragraphs that are not part of a table: neither their identity nor their text is one of the cells'."""
    by_id = cells.select(key, identity).distinct()
    by_text = cells.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value).distinct()
    return paragraphs.join(by_id, [key, identity], "left_anti").join(by_text, [key, value], "left_anti")


def nearest_edges(values: Column, tolerance: float = 0.01) -> Column:
    """Sorted positions, without those within ``tolerance`` of the last one kept."""
    kept = F.aggregate(
        F.array_sort(values), F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return kept
