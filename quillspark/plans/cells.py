"""Tables of cells: places, sizes, edges, and which border a line takes. Lengths are mm unless a name says units.

A table is one key. Everything is an aggregation or a window over its cells, so tables are dealt over tasks and none is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import units

#: Positions nearer than this are one.
NEAR = 0.01


def first_contents(cells: DataFrame, key: str, places: list[str], content: str, order: str) -> DataFrame:
    """One row a place: the first cell there, or, if that is empty, the first that is not."""
    return cells.groupBy(key, *places).agg(F.min_by(content, F.struct(F.col(content) == "", order)).alias(content))


def table_sizes(cells: DataFrame, key: str, row: str, column: str, span: str) -> DataFrame:
    """key, ``n_cols`` (the farthest end of a cell; an unknown column counts as 0), ``n_rows``, ``first_col``, ``merged`` (whether any
    cell spans more than one)."""
    c = F.coalesce(F.col(column), F.lit(0))
    return cells.groupBy(key).agg(F.max(c + F.col(span)).alias("n_cols"), F.count_distinct(row).alias("n_rows"), F.min(c).alias("first_col"), F.bool_or(F.col(span) > 1).alias("merged"))


def from_first(cells: DataFrame, key: str, row: str, column: str) -> DataFrame:
    """Adds ``r``, ``k``: the place counted from the smallest row and column of the table."""
    w = Window.partitionBy(key)
    return cells.withColumn("r", F.col(row) - F.min(row).over(w)).withColumn("k", F.col(column) - F.min(column).over(w))


def row_heights(cells: DataFrame, key: str, row: str, height: str, row_span: str) -> DataFrame:
    """key, row, ``height`` (of the highest cell that spans this row alone, else null), ``top`` (sum of the heights before)."""
    heights = cells.groupBy(key, row).agg(F.max(F.when(F.col(row_span) == 1, F.col(height))).alias("height"))
    w = Window.partitionBy(key).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return heights.withColumn("top", F.coalesce(F.sum("height").over(w), F.lit(0.0)))


def _rows(cells: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """One row for each row of a table: key, ``row``, ``cell`` (highest of the cells in this row alone), ``size`` (as the table says),
    ``share`` (of the whole height)."""
    one = cells.where("row_span = 1").groupBy(key, "row").agg(F.max("height").alias("cell"))
    grid = tables.where("rows > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.expr("row_sizes").alias("_sizes"), (F.col("height") / F.col("rows")).alias("share"))
    grid = grid.withColumn("size", F.get("_sizes", F.col("row").cast("int"))).drop("_sizes")
    return grid.join(one, [key, "row"], "left")


def row_edges(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``edges``: tops of all rows from 0 on and the bottom of the last. A row is as high as its highest cell, else as its share of
    the table's height, else as the table says (units).

    cells: key, ``row``, ``row_span``, ``height``; tables: key, ``rows``, ``height`` (null if unknown), ``row_sizes``."""
    rows = _rows(cells, tables, key)
    high = F.coalesce("cell", F.when(F.col("share") > 0, F.col("share")), units.to_mm("size"), F.lit(0.0))
    w = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("_end", F.sum(high).over(w))
    ends = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "_end"))).alias("_ends"))
    return ends.select(key, F.concat(F.array(F.lit(0.0)), F.transform("_ends", lambda e: e["_end"])).alias("edges"))


def cell_boxes(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """Adds ``left``, ``top``, ``high`` to cells (key, ``row``, ``col``, ``row_span``, ``width``, ``height``).

    Left of a cell is what stands before it in its row; above it are the heights of the rows before, each that of its highest cell or,
    if the table says 100 units or more and that is higher, so much, else its share. A cell without any height takes its own."""
    before = Window.partitionBy(key, "row").orderBy("col").rangeBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("left", F.coalesce(F.sum("width").over(before), F.lit(0.0)))
    rows = _rows(cells, tables, key)
    cell = F.coalesce("cell", F.lit(0.0))
    high = F.when(F.col("size") >= 100, F.greatest(cell, units.to_mm("size"))).when(cell > 0, cell).otherwise(F.coalesce("share", F.lit(0.0)))
    w = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select(key, "row", F.sum(high).over(w).alias("_end"))
    first = ends.select(F.col(key).alias("_k0"), F.col("row").alias("_r0"), F.col("_end").alias("_e0"))
    last = ends.groupBy(F.col(key).alias("_k1")).agg(F.max_by("_end", "row").alias("_whole"), F.max("row").alias("_last"))
    to = ends.select(F.col(key).alias("_k2"), F.col("row").alias("_r2"), F.col("_end").alias("_e2"))
    span = F.greatest(F.lit(1), F.col("row_span"))
    out = placed.join(first, (F.col(key) == F.col("_k0")) & (F.col("row") - 1 == F.col("_r0")), "left").join(last, F.col(key) == F.col("_k1"), "left")
    out = out.join(to, (F.col(key) == F.col("_k2")) & (F.least(F.col("row") + span - 1, F.col("_last")) == F.col("_r2")), "left")
    top = F.when(F.col("row") > F.col("_last"), F.col("_whole")).otherwise(F.coalesce("_e0", F.lit(0.0)))
    out = out.withColumn("top", F.coalesce(top, F.lit(0.0))).withColumn("_h", F.greatest(F.lit(0.0), F.coalesce(F.col("_e2") - F.col("top"), F.lit(0.0))))
    own = (F.col("_h") < 0.1) & (F.col("height") > 0.1)
    return out.withColumn("high", F.when(own, F.col("height")).otherwise(F.col("_h"))).drop("_k0", "_r0", "_e0", "_k1", "_whole", "_last", "_k2", "_r2", "_e2", "_h")


def object_sizes(objects: DataFrame) -> DataFrame:
    """Adds ``box_width``, ``box_height`` to objects (``width``, ``height`` and four margins in units): the size with its margins."""
    mm = units.to_mm
    return objects.withColumn("box_width", units.round2(mm("width") + mm("margin_left") + mm("margin_right"))).withColumn("box_height", units.round2(mm("height") + mm("margin_top") + mm("margin_bottom")))


def content_sizes(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``content_width`` (cells of the first row), ``content_height``: of the rows where that is over a tenth more than the table's own
    height, else that; without a height of its own the rows' heights. Tables without row sizes have no height."""
    rows = _rows(cells, tables, key)
    sized = F.coalesce("cell", F.when(F.col("share") > 0, F.col("share")), units.to_mm("size"), F.lit(0.0))
    by_row = rows.groupBy(key).agg(F.sum(sized).alias("_rows"))
    wide = cells.where("row = 0").groupBy(key).agg(F.sum("width").alias("_wide"))
    out = tables.join(by_row, key, "left").join(wide, key, "left")
    rows_mm, own = F.coalesce("_rows", F.lit(0.0)), F.col("height")
    high = F.when((F.col("rows") == 0) | (F.coalesce(F.size("row_sizes"), F.lit(0)) <= 0), F.lit(0.0)).when(own.isNull() | (rows_mm > own * 1.1), rows_mm).otherwise(own)
    return out.select(key, units.round2(F.coalesce("_wide", F.lit(0.0))).alias("content_width"), units.round2(high).alias("content_height"))


def resolved(width: Column, height: Column, content_width: Column, content_height: Column) -> tuple[Column, Column]:
    """The container's size, or the content's where the container has none."""
    none = (width == 0) | (height == 0)
    return F.when(none, content_width).otherwise(width), F.when(none, content_height).otherwise(height)


def line_height(segments: Column) -> Column:
    """Sum of the heights of a paragraph's lines."""
    return F.aggregate(segments, F.lit(0).cast("long"), lambda acc, s: acc + s["line_height"])


def extents(lines: DataFrame, key: str, top: str, height: str) -> DataFrame:
    """key, ``top``, ``bottom`` of all lines of a cell."""
    return lines.groupBy(key).agg(F.min(top).alias("top"), F.max(F.col(top) + F.col(height)).alias("bottom"))


def column_edges(boxes: DataFrame, key: str) -> DataFrame:
    """key, ``edges``: 0 and both sides of all cells (``left``, ``width``), sorted, without those near the last one kept."""
    from quillspark.plans.intervals import nearest_edges

    sides = boxes.select(key, F.explode(F.array("left", F.col("left") + F.col("width"))).alias("x")).distinct()
    return sides.groupBy(key).agg(F.collect_list("x").alias("_x")).select(key, nearest_edges(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.col("_x")))).alias("edges"))


def segment_lines(segments: DataFrame, boxes: DataFrame, key: str, before: str, after: str, at: str = "x", low: str = "y0", high: str = "y1") -> DataFrame:
    """Adds ``line``: the border of a segment of an edge. Of the cells that end at the edge and overlap the segment the first (by row and
    column) gives its ``before`` border (its right or bottom one), else the first that begins there its ``after`` border.

    segments: key, at, low, high; boxes: key, ``row``, ``col``, ``begin``, ``end`` (across the edge), ``from``, ``to`` (along it), and
    the two borders. Edges are matched by bins twice as wide as ``NEAR``, so that each cell meets the segments near it only."""
    bin_of = lambda c: F.round(c / (2 * NEAR)).cast("long")
    spread = lambda c: F.explode(F.array(bin_of(c) - 1, bin_of(c), bin_of(c) + 1))
    sides = [boxes.select(F.col(key).alias("_key"), "row", "col", F.col("from").alias("_from"), F.col("to").alias("_to"), F.col(side).alias("_edge"), F.lit(rank).alias("_rank"), F.col(line).alias("_line")) for side, rank, line in (("end", 0, before), ("begin", 1, after))]
    ends = sides[0].unionByName(sides[1]).where("_line is not null").withColumn("_bin", spread(F.col("_edge")))
    wanted = segments.select(key, at, low, high).distinct().withColumn("_at", bin_of(F.col(at)))
    near = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & (F.abs(F.col("_edge") - F.col(at)) < NEAR)
    overlap = ~((F.col(high) <= F.col("_from") + NEAR) | (F.col(low) >= F.col("_to") - NEAR))
    hit = wanted.join(ends, near & overlap).groupBy(key, at, low, high).agg(F.min_by("_line", F.struct("_rank", "row", "col")).alias("line"))
    return segments.join(hit, [key, at, low, high], "left")


def pattern_ids(cells: DataFrame, key: str, color: str, order: str) -> DataFrame:
    """key, color, ``pattern``: ``w_00`` on for the colours of a table in the order in which they are first met."""
    first = cells.groupBy(key, color).agg(F.min(order).alias("_first"))
    k = F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1
    return first.select(key, color, F.format_string("w_%02d", k).alias("pattern"))


def boundaries(rows: DataFrame, key: str, positions: Column) -> DataFrame:
    """key, ``edges``: different positions, sorted. positions: array."""
    return rows.select(key, F.explode(positions).alias("_x")).groupBy(key).agg(F.array_sort(F.collect_set("_x")).alias("edges"))


def plausible(row: Column, column: Column, width: Column, height: Column, rows: Column, columns: Column) -> Column:
    """Whether a cell's attributes can be right: inside the table, and of some size."""
    return (row < rows) & (column < columns) & (width != 0) & (height != 0)
