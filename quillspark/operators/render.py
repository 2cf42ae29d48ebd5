"""Rendering: plain text, Markdown, tables, CSS. Rows in, one text a document (or table) out, always in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import units
from quillspark.plans import sequence

# Texts of the Markdown shell, labels of placeholders, the default font, open tags.
TITLE = "# HWP 문서"
VERSION_LABEL, FOOTNOTES, ENDNOTES = "**버전**: ", "## 각주", "## 미주"
PAGE_SIZE, PAGE_DIRECTION, PAGE_MARGINS = "**용지 크기**: ", "**용지 방향**: ", "**여백**: "
DEFAULT_FONT = "함초롬바탕"
TABLE_OPEN = '\n<table border="1" cellpadding="5" cellspacing="0" style="border-collapse: collapse;">\n'
_ABSOLUTE, _RELATIVE, _HIDDEN = "margin:0;padding:0;position:absolute;", "margin:0;padding:0;position:relative;", "margin:0;padding:0;position:absolute;overflow:hidden;"
_INLINE = "display:inline-block;margin:0;padding:0;position:relative;"
FIXED_RULES = [
    ("body", "margin:0;padding-left:0;padding-right:0;padding-bottom:0;padding-top:2mm;"), (".hce", _HIDDEN), (".hme", _ABSOLUTE), (".hhe", _RELATIVE), (".hhi", _INLINE + "background-size:contain;"), (".hls", _ABSOLUTE), (".hfS", _ABSOLUTE),
    (".hcD", _ABSOLUTE), (".hcI", _ABSOLUTE), (".hcS", _ABSOLUTE), (".hfN", _RELATIVE), (".hmB", _ABSOLUTE), (".hmO", _ABSOLUTE), (".hmT", _ABSOLUTE), (".hpN", _INLINE + "white-space:nowrap;"), (".htC", _INLINE + "vertical-align:top;overflow:hidden;"),
    (".haN", _INLINE), (".hdu", _RELATIVE), (".hdS", _ABSOLUTE), (".hsC", _ABSOLUTE), (".hsR", _ABSOLUTE), (".hsG", _ABSOLUTE), (".hsL", _ABSOLUTE), (".hsT", _HIDDEN), (".hsE", _HIDDEN), (".hsA", _HIDDEN), (".hsP", _HIDDEN), (".hsV", _HIDDEN),
    (".hsO", _ABSOLUTE), (".hsU", _HIDDEN), (".hpi", _ABSOLUTE), (".hch", _ABSOLUTE), (".hcG", _ABSOLUTE), (".heq", _ABSOLUTE), (".heG", _ABSOLUTE), (".htA", _ABSOLUTE), (".hvi", _ABSOLUTE), (".htb", _ABSOLUTE), (".htG", _ABSOLUTE), (".hfJ", _ABSOLUTE),
    (".hfG", _ABSOLUTE), (".hfB", _ABSOLUTE), (".hfR", _ABSOLUTE), (".hfC", _ABSOLUTE), (".hfO", _ABSOLUTE), (".hfL", _ABSOLUTE), (".hfM", _ABSOLUTE), (".hfE", _ABSOLUTE), (".hpl", _ABSOLUTE), (".hs", _ABSOLUTE + "overflow:visible;"),
    (".hpa", "position:relative;padding:0;overflow:hidden;margin-left:2mm;margin-right:0mm;margin-bottom:2mm;margin-top:0mm;border:1px black solid;box-shadow:1mm 1mm 0 #AAAAAA;"),
    (".hpa::after", "content:'';position:absolute;margin:0;padding:0;left:0;right:0;top:0;bottom:0;background-color:white;z-index:-2;"), (".hrt", _INLINE + "white-space:inherit;vertical-align:middle;line-height:1.1;"), (".hco", _INLINE + "white-space:inherit;"),
    (".hcc", _ABSOLUTE), (".hls", "clear:both;"), ("[onclick]", "cursor:pointer;"),
]
FIXED_CSS = "".join(f"{names} {{{rules}}}\n" for names, rules in FIXED_RULES)
PRINT_CSS = "@media print {\n.hpa {margin:0;border:0 black none;box-shadow:none;}\nbody {padding:0;}\n}\n"
PARTS = ("headers", "body", "footers", "footnotes", "endnotes")


def plain_text(paragraphs: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """key, ``text``: trimmed paragraphs that are not blank, one a line."""
    rows = paragraphs.select(key, order, T.trim(line).alias("_t")).where("_t <> ''")
    return sequence.joined(rows, key, order, "_t", "\n", "text")


def page_info(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column, direction: Column) -> Column:
    """The three lines of page information, from lengths in document units."""
    mm = lambda c: F.format_string("%.2f", units.to_mm(c))
    return F.array(
        F.concat(F.lit(PAGE_SIZE), mm(width), F.lit("mm x "), mm(height), F.lit("mm")),
        F.concat(F.lit(PAGE_DIRECTION), direction),
        F.concat(F.lit(PAGE_MARGINS + "좌 "), mm(left), F.lit("mm / 우 "), mm(right), F.lit("mm / 상 "), mm(top), F.lit("mm / 하 "), mm(bottom), F.lit("mm")),
    )


def markdown(parts: DataFrame, key: str, version: Column | None = None, info: Column | None = None) -> DataFrame:
    """parts: key, ``part`` (one of PARTS), ``ord``, ``line``, and the columns of version and info, constant within a key.

    Returns key, ``markdown``: the shell around headers, body, footers, footnotes and endnotes, joined by blank lines.
    """
    named = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("ord", "line")))).alias(p) for p in PARTS]
    once = [F.first(version).alias("_version")] if version is not None else []
    once += [F.first(info).alias("_info")] if info is not None else []
    rows = parts.groupBy(key).agg(*named, *once)
    text = {p: F.transform(F.col(p), lambda x: x["line"]) for p in PARTS}
    gap = F.array(F.lit(""))

    def after(lines: Column, title: str | None, more: Column) -> Column:
        """A blank entry unless there is one, the title, and the lines; nothing without lines."""
        head = F.when(F.element_at(lines, -1) == "", F.array().cast("array<string>")).otherwise(gap)
        titled = F.array(F.lit(title), F.lit("")) if title else F.array().cast("array<string>")
        return F.when(F.size(more) > 0, F.concat(lines, head, titled, more)).otherwise(lines)

    out = F.array(F.lit(TITLE), F.lit(""))
    if version is not None:
        out = F.concat(out, F.array(F.concat(F.lit(VERSION_LABEL), F.col("_version")), F.lit("")))
    if info is not None:
        out = F.when(F.col("_info").isNotNull(), F.concat(out, F.col("_info"), gap)).otherwise(out)
    out = F.when(F.size("headers") > 0, F.concat(out, text["headers"], gap)).otherwise(out)
    rows = rows.withColumn("_l", F.concat(out, text["body"]))
    for p, title in (("footers", None), ("footnotes", FOOTNOTES), ("endnotes", ENDNOTES)):
        rows = rows.withColumn("_l", after(F.col("_l"), title, text[p]))
    return rows.select(key, F.array_join("_l", "\n\n").alias("markdown"))


def page_breaks(lines: DataFrame, key: str, order: str, breaks: str) -> DataFrame:
    """A ``---`` line before a row with a break, unless it is the first. Lines of one row keep their order by ``sub``."""
    first = F.min(order).over(Window.partitionBy(key))
    marked = lines.withColumn("_first", first)
    rules = marked.where(F.col(breaks) & (F.col(order) > F.col("_first"))).select(key, order, F.lit(0).alias("sub"), F.lit("---\n").alias("line"))
    return marked.select(key, order, F.lit(1).alias("sub"), "line").unionByName(rules)


def pipe_table(cells: DataFrame, key: str, row: str, column: str, content: str, rows: Column, columns: Column) -> DataFrame:
    """key, ``table``: a Markdown grid of rows x columns (constant within a key); addresses count from the smallest of each table.
    Of several cells at one place one with content counts, the smallest text."""
    cells = cells.withColumn("_rows", rows).withColumn("_cols", columns)
    cells = cells.groupBy(key, row, column).agg(F.min_by(content, F.struct(F.col(content) == "", F.col(content))).alias(content), F.max("_rows").alias("_rows"), F.max("_cols").alias("_cols"))
    grid = cells.groupBy(key).agg(
        F.min(row).alias("_r0"), F.min(column).alias("_c0"), F.max("_rows").cast("int").alias("_rows"), F.max("_cols").cast("int").alias("_cols"),
        F.collect_list(F.struct(F.col(row).cast("int").alias("r"), F.col(column).cast("int").alias("c"), F.col(content).alias("t"))).alias("_cells"),
    )
    # a grid place is looked up in a map, so a table costs its places and its cells, not their product
    place = F.map_from_entries(F.transform("_cells", lambda x: F.struct(F.concat_ws(":", (x["r"] - F.col("_r0")).cast("string"), (x["c"] - F.col("_c0")).cast("string")).alias("k"), x["t"].alias("v"))))
    grid = grid.withColumn("_at", place)

    def cell(r: Column, c: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("_at"), F.concat_ws(":", r.cast("string"), c.cast("string"))), F.lit(" "))

    across = F.sequence(F.lit(0), F.col("_cols") - 1)
    body = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(across, lambda c: cell(r, c)), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(across, lambda c: F.lit("---")), "|"), F.lit("|"))
    lines = F.concat(F.array(F.lit("")), F.slice("_b", 1, 1), F.array(rule), F.slice("_b", F.lit(2), F.greatest(F.lit(0), F.size("_b") - 1)), F.array(F.lit("")))
    return grid.withColumn("_b", body).select(key, F.array_join(lines, "\n").alias("table"))


def html_table(cells: DataFrame, key: str, row: str, column: str, row_span: str, column_span: str, content: str) -> DataFrame:
    """key, ``table``: rows with content as an HTML table. Hidden cells must have been left out (plans.intervals.covered_cells)."""
    attrs = F.concat(
        F.when(F.col(column_span) > 1, F.format_string(' colspan="%d"', F.col(column_span).cast("long"))).otherwise(F.lit("")),
        F.when(F.col(row_span) > 1, F.format_string(' rowspan="%d"', F.col(row_span).cast("long"))).otherwise(F.lit("")),
    )
    shown = F.when(F.contains(F.col(content), F.lit("<table")), F.col(content)).otherwise(F.replace(F.col(content), F.lit("\n"), F.lit("<br>")))
    tds = cells.select(key, row, column, T.meaningful(content).alias("_some"), F.concat(F.lit("    <td"), attrs, F.lit(">"), shown, F.lit("</td>\n")).alias("_td"))
    by_row = tds.groupBy(key, row).agg(F.bool_or("_some").alias("_some"), F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), "_td"))).alias("_tds"))
    by_row = by_row.withColumn("_tr", F.when(F.col("_some"), F.concat(F.lit("  <tr>\n"), F.array_join(F.transform("_tds", lambda x: x["_td"]), ""), F.lit("  </tr>\n"))).otherwise(F.lit("")))
    whole = by_row.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "_tr"))), lambda x: x["_tr"]), "").alias("_all"))
    return whole.select(key, F.concat(F.lit(TABLE_OPEN), F.col("_all"), F.lit("</table>\n")).alias("table"))


def placeholder(rows: Column, columns: Column, n_cells: Column) -> Column:
    """What stands for a table without a grid or without cells; else null."""
    size = F.concat(rows.cast("string"), F.lit("x"), columns.cast("string"))
    return F.when((rows == 0) | (columns == 0), F.concat(F.lit("\n\n[Table: "), size, F.lit("]\n\n"))).when(n_cells == 0, F.concat(F.lit("\n\n[Empty Table: "), size, F.lit("]\n\n")))


def char_rule(idx: Column, base_size: Column, color: Column, font: Column, bold: Column, italic: Column, spacing: Column) -> Column:
    """CSS of one character style; base_size in hundredths of a point."""
    space = F.when(spacing != 0, F.format_string("letter-spacing:%.2fem;", spacing / 2.0 / 100.0)).otherwise(F.lit(""))
    return F.concat(
        F.format_string(".cs%d {\n", idx.cast("long")), F.lit("  font-size:"), units.number_text(base_size / 100.0), F.lit("pt;color:"), units.rgb(color), F.lit(';font-family:"'),
        F.coalesce(font, F.lit(DEFAULT_FONT)), F.lit('";'), F.when(bold, F.lit("font-weight:bold;")).otherwise(F.lit("")), F.when(italic, F.lit("font-style:italic;")).otherwise(F.lit("")), space, F.lit("\n}\n"),
    )


def para_rule(idx: Column, align: Column) -> Column:
    """CSS of one paragraph style; other alignments are justified."""
    shown = F.when(align.isin("left", "right", "center"), align).otherwise(F.lit("justify"))
    return F.concat(F.format_string(".ps%d {\n", idx.cast("long")), F.lit("  text-align:"), shown, F.lit(";\n}\n"))


def text_run(run: Column, style: Column, base_size: Column, color: Column, italic: Column, underline: Column, strike: Column, above: Column | None = None, below: Column | None = None, escape: bool = False) -> Column:
    """An HTML run of one style; not escaped unless asked for, as documents may hold entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) if escape else ():
        run = F.replace(run, F.lit(mark), F.lit(entity))
    inner = T.hard_edges(run)
    marks = ((italic, "em"), (underline, "u"), (strike, "s"), (above, "sup"), (below, "sub"))
    for flag, tag in ((f, t) for f, t in marks if f is not None):
        inner = F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)
    head = F.concat(F.lit('<span class="hrt cs'), style.cast("string"), F.lit('" style="font-size:'), units.number_text(base_size / 100.0), F.lit("pt;color:"), units.rgb(color), F.lit(';">'))
    return F.when(style.isNotNull(), F.concat(head, inner, F.lit("</span>"))).otherwise(F.concat(F.lit('<span class="hrt">'), inner, F.lit("</span>")))


def line_box(
    vertical: Column, line_height: Column, text_height: Column, baseline: Column, column_start: Column, width: Column, style: Column, body: Column, line_grid: Column | None = None, indentation: Column | None = None
) -> Column:
    """A positioned line of text from a line segment's lengths (document units): as high as its baseline distance, or as the line
    on a line grid, and centred in it. ``indentation`` (document units, null for none) pads the left."""
    mm = lambda c: units.round2(units.int_to_mm(c))
    height = mm(baseline) if line_grid is None else F.when(line_grid, mm(line_height)).otherwise(mm(baseline))
    top = units.round2(units.int_to_mm(vertical) + (height - mm(text_height)) / 2.0)
    pad = F.lit("") if indentation is None else F.when(indentation.isNotNull(), F.format_string("padding-left:%.2fmm;", mm(indentation))).otherwise(F.lit(""))
    box = F.format_string("line-height:%.2fmm;white-space:nowrap;left:%.2fmm;top:%.2fmm;height:%.2fmm;width:%.2fmm;", height, mm(column_start), top, mm(line_height), mm(width))
    return F.concat(F.lit('<div class="hls '), style, F.lit('" style="'), box, pad, F.lit('">'), body, F.lit("</div>"))


def object_line(vertical: Column, height: Column, column_start: Column, width: Column, style: Column, body: Column) -> Column:
    """A line that holds an object instead of text: as high as the object, not centred."""
    mm = lambda c: units.round2(units.int_to_mm(c))
    box = F.format_string("line-height:%.2fmm;white-space:nowrap;left:%.2fmm;top:%.2fmm;height:%.2fmm;width:%.2fmm;", mm(height), mm(column_start), mm(vertical), mm(height), mm(width))
    return F.concat(F.lit('<div class="hls '), style, F.lit('" style="'), box, F.lit('">'), body, F.lit("</div>"))


def image_box(url: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """An image as the background of a box; lengths in document units."""
    mm = lambda c: units.number_text(units.int_to_mm(c))
    return F.concat(F.lit('<div class="hsR" style="top:'), mm(top), F.lit("mm;left:"), mm(left), F.lit("mm;width:"), mm(width), F.lit("mm;height:"), mm(height), F.lit("mm;background-repeat:no-repeat;background-size:contain;background-image:url('"), url, F.lit("');\"></div>"))


def page_number(position: Column, page: Column, start: Column, prefix: Column, suffix: Column) -> Column:
    """Text of a page's number, null without a place for it; NULs in prefix and suffix stand for nothing."""
    clean = lambda c: T.no_nul(F.coalesce(c, F.lit("")))
    return F.when(position != "none", F.concat(clean(prefix), (start + page - 1).cast("string"), clean(suffix)))


# What stands before the styles, between them and the pages, and after these.
HTML_HEAD = '<!DOCTYPE html>\n<html>\n<meta http-equiv="X-UA-Compatible" content="IE=edge,chrome=1">\n\n<head>\n  <title></title>\n  <meta http_quiv="content-type" content="text/html; charset=utf-8">\n  <style>\n'
HTML_BODY = "  </style>\n</head>\n\n\n<body>\n"
HTML_END = "</body>\n\n</html>\n"


def html_document(rows: DataFrame, key: str, page: str, order: str, body: str, css: Column, width: Column, height: Column, left: Column, top: Column) -> DataFrame:
    """rows: positioned lines with the page they are on. key, ``html``: a whole document of page boxes; css and the page's lengths (mm)
    are constant within a key."""
    rows = rows.select(key, page, order, body, css.alias("_css"), *[c.alias(n) for c, n in ((width, "_w"), (height, "_h"), (left, "_l"), (top, "_t"))])
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body])
    pages = rows.groupBy(key, page).agg(F.array_join(line, "").alias("_body"), *[F.first(n).alias(n) for n in ("_css", "_w", "_h", "_l", "_t")])
    pages = pages.withColumn("_page", F.concat(page_box(F.col("_w"), F.col("_h"), F.col("_l"), F.col("_t"), F.col("_body")), F.lit("\n")))
    whole = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "_page"))), lambda x: x["_page"]), "").alias("_all"), F.first("_css").alias("_css"))
    return whole.select(key, F.concat(F.lit(HTML_HEAD), F.col("_css"), F.lit(HTML_BODY), F.col("_all"), F.lit(HTML_END)).alias("html"))


def page_box(width: Column, height: Column, left: Column, top: Column, body: Column) -> Column:
    n = units.number_text
    return F.concat(F.lit('<div class="hpa" style="width:'), n(width), F.lit("mm;height:"), n(height), F.lit('mm;"><div class="hcD" style="left:'), n(left), F.lit("mm;top:"), n(top), F.lit('mm;"><div class="hcI">'), body, F.lit("</div></div></div>"))


def svg_line(x1: Column, y1: Column, x2: Column, y2: Column, color: Column, width: Column) -> Column:
    n = units.number_text
    return F.concat(F.lit('<path d="M'), n(x1), F.lit(","), n(y1), F.lit(" L"), n(x2), F.lit(","), n(y2), F.lit('" style="stroke:'), units.hex_color(color), F.lit(";stroke-linecap:butt;stroke-width:"), n(width), F.lit(';"></path>'))
