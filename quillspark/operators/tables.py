"""Fills and borders of tables as SVG, by tables of cells: one text a table, every step a join or a window over its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import units
from quillspark.plans import cells as C
from quillspark.plans import sequence

#: How far horizontal lines reach beyond the table, mm.
OFFSET = 0.06
SIDES = ("left", "right", "top", "bottom")


def _boxes(cells: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    boxes = C.cell_boxes(cells, tables, key)
    return boxes.withColumn("right", F.col("left") + F.col("width")).withColumn("bottom", F.col("top") + F.col("high"))


def fills(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``defs``, ``paths``: a pattern for each colour in the order in which cells use it, and a box a filled cell.

    cells: key, ``row``, ``col``, ``row_span``, ``width``, ``height`` (mm), ``background`` (colour; null or 0 is none); tables: as for
    plans.cells.cell_boxes."""
    boxes = _boxes(cells, tables, key).where("background <> 0").withColumn("_o", F.struct("row", "col"))
    patterns = C.pattern_ids(boxes, key, "background", "_o")
    rgb = lambda c: F.format_string("rgb(%d,%d,%d)", units.red(c), units.green(c), units.blue(c))
    define = F.concat(F.lit('<pattern id="'), F.col("pattern"), F.lit('" width="10" height="10" patternUnits="userSpaceOnUse"><rect width="10" height="10" fill="'), rgb("background"), F.lit('" /></pattern>'))
    defs = sequence.joined(patterns.withColumn("_d", define), key, "pattern", "_d", "", "defs")
    n = units.number_text
    corner = lambda x, y: F.concat(n(x), F.lit(","), n(y))
    ring = [corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom"), corner("left", "top")]
    path = F.concat(F.lit('<path fill="url(#'), F.col("pattern"), F.lit(')" d="M'), F.concat_ws("L", *ring), F.lit('Z "></path>'))
    paths = boxes.join(patterns, [key, "background"]).withColumn("_p", path)
    return defs.join(sequence.joined(paths, key, "_o", "_p", "", "paths"), key)


def _segments(edges: DataFrame, boxes: DataFrame, key: str, low: str, high: str, first: str, last: str, length: str) -> DataFrame:
    """key, ``at``, ``y0``, ``y1``: the parts of inner edges that no cell lies across. edges: key, ``at``, and ``length`` of each."""
    across = edges.join(boxes.select(key, F.col(low).alias("_l"), F.col(high).alias("_h"), F.col(first).alias("_f"), F.col(last).alias("_t")), key)
    across = across.where((F.col("_l") < F.col("at")) & (F.col("_h") > F.col("at"))).select(key, "at", length, "_f", "_t")
    # an empty stretch at the start stands for edges that nothing lies across
    covers = across.union(edges.select(key, "at", length, F.lit(0.0).alias("_f"), F.lit(0.0).alias("_t")))
    gaps = sequence.gaps(covers, [key, "at"], "_f", "_t", F.lit(0.0), F.col(length))
    return gaps.select(key, "at", F.col("gap_low").alias("y0"), F.col("gap_high").alias("y1"))


def lines(cells: DataFrame, tables: DataFrame, key: str = "doc", vertical: bool = True) -> DataFrame:
    """key, ``at``, ``y0``, ``y1``, ``line``: borders of a table, whole along its outer edges (the table's own line if it has one), of inner
    edges only where no cell lies across.

    cells: as for fills, with ``left_line``, ``right_line``, ``top_line``, ``bottom_line`` (structs of type, width, color; null without a
    border fill); tables: with the same four columns, null without a border fill."""
    boxes = _boxes(cells, tables, key)
    size = C.content_sizes(cells, tables, key)
    near = lambda a, b: F.abs(a - b) < C.NEAR
    if vertical:
        found = C.column_edges(boxes, key).join(size, key)
        wide = F.when(near(F.element_at("edges", -1), F.col("content_width")), F.col("edges")).otherwise(F.array_sort(F.concat("edges", F.array("content_width"))))
        edges = found.select(key, F.explode(wide).alias("at"), F.col("content_width").alias("_end"), F.col("content_height").alias("_length"))
        across, along, before, after = ("left", "right"), ("top", "bottom"), "right_line", "left_line"
    else:
        found = C.row_edges(cells, tables, key).join(size, key)
        rows = found.select(key, F.posexplode("edges").alias("_r", "_y"))
        span = F.greatest(F.lit(1), F.col("row_span"))
        tops = rows.select(F.col(key).alias("_k0"), F.col("_r").alias("_r0"), F.col("_y").alias("_top"))
        ends = rows.select(F.col(key).alias("_k1"), F.col("_r").alias("_r1"), F.col("_y").alias("_bottom"))
        boxes = boxes.join(tops, (F.col(key) == F.col("_k0")) & (F.col("row") == F.col("_r0"))).join(ends, (F.col(key) == F.col("_k1")) & (F.col("row") + span == F.col("_r1")))
        boxes = boxes.drop("top", "bottom", "_k0", "_r0", "_k1", "_r1").withColumnRenamed("_top", "top").withColumnRenamed("_bottom", "bottom")
        edges = found.select(key, F.explode("edges").alias("at"), F.col("content_height").alias("_end"), F.col("content_width").alias("_length"))
        across, along, before, after = ("top", "bottom"), ("left", "right"), "bottom_line", "top_line"
    outer = near(F.col("at"), F.lit(0.0)) | near(F.col("at"), F.col("_end"))
    inner = _segments(edges.where(~outer).select(key, "at", "_length"), boxes, key, *across, *along, "_length")
    whole = edges.where(outer).select(key, "at", F.lit(0.0).alias("y0"), F.col("_length").alias("y1"))
    placed = boxes.select(key, "row", "col", F.col(across[0]).alias("begin"), F.col(across[1]).alias("end"), F.col(along[0]).alias("from"), F.col(along[1]).alias("to"), before, after)
    drawn = C.segment_lines(inner.union(whole), placed, key, before, after, "at", "y0", "y1").join(edges.select(key, "at", "_end").distinct(), [key, "at"])
    own = tables.select(F.col(key).alias("_k"), F.col(after).alias("_first"), F.col(before).alias("_last"))
    drawn = drawn.join(own, F.col(key) == F.col("_k"), "left")
    line = F.when(near(F.col("at"), F.lit(0.0)), F.coalesce("_first", "line")).when(near(F.col("at"), F.col("_end")), F.coalesce("_last", "line")).otherwise(F.col("line"))
    return drawn.select(key, "at", "y0", "y1", line.alias("line")).where("line is not null")


def _path(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    from quillspark.operators import render

    line = F.col("line")
    return render.svg_line(x1, y1, x2, y2, line["color"], units.border_width(line["width"]))


def border_paths(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``paths``: lines of a table, vertical ones from left to right, then horizontal ones from top to bottom; lines of type 0 or
    width 0 are not drawn."""
    shown = "line.type <> 0 and line.width <> 0"
    x, low, high = F.col("at"), F.col("y0"), F.col("y1")
    upright = lines(cells, tables, key).where(shown).select(key, F.struct(F.lit(0).alias("side"), "at", "y0").alias("_o"), _path(x, low, x, high).alias("_p"))
    flat = lines(cells, tables, key, vertical=False).where(shown).select(key, F.struct(F.lit(1).alias("side"), "at", "y0").alias("_o"), _path(low - OFFSET, x, high + OFFSET, x).alias("_p"))
    # the bottom line is drawn once more over all others
    size = C.content_sizes(cells, tables, key).select(F.col(key).alias("_k"), "content_height", "content_width")
    last = lines(cells, tables, key, vertical=False).join(size, F.col(key) == F.col("_k")).where(shown).where(F.abs(x - F.col("content_height")) < C.NEAR)
    again = last.select(key, F.struct(F.lit(2).alias("side"), "at", "y0").alias("_o"), _path(F.lit(-OFFSET), x, F.col("content_width") + OFFSET, x).alias("_p"))
    return sequence.joined(upright.union(flat).union(again), key, "_o", "_p", "", "paths")


def svgs(cells: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """key, ``svg``: fills and borders of each table in a box with room around it. Columns as for fills and lines."""
    size = C.content_sizes(cells, tables, key)
    box = units.view_box(F.col("content_width"), F.col("content_height"))
    part = lambda k: F.split(box, " ")[k]
    style = F.concat(F.lit("left:"), part(0), F.lit("mm;top:"), part(1), F.lit("mm;width:"), part(2), F.lit("mm;height:"), part(3), F.lit("mm;"))
    rows = size.join(fills(cells, tables, key), key, "left").join(border_paths(cells, tables, key).withColumnRenamed("paths", "borders"), key, "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(key, F.concat(F.lit('<svg class="hs" viewBox="'), box, F.lit('" style="'), style, F.lit('"><defs>'), text("defs"), F.lit("</defs>"), text("paths"), text("borders"), F.lit("</svg>")).alias("svg"))
