"""Whole compound documents as paged HTML: styles, lines of text at their places, images, page numbers' boxes.

Lines come from operators.assembly, one pass a document; pages are the fold of plans.sequence over paragraphs; every box is a column
expression of operators.render.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import units
from quillspark.operators import assembly, render
from quillspark.plans import sequence

#: Controls that HTML renders; sections, columns, headers, footers and notes show nothing of their own.
SHOWN = ("tbl ", "gso ")


def shows_control(ident: Column) -> Column:
    """Whether HTML renders a control of this identifier."""
    return ident.isin(*SHOWN)


def paragraph_runs(runs: Column) -> Column:
    """A line's runs as spans."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    one = lambda r: render.text_run(r["text"], r["style"], r["size"].cast("double"), r["color"], yes(r["italic"]), yes(r["underline"]), yes(r["strikethrough"]), yes(r["superscript"]), yes(r["subscript"]))
    return F.array_join(F.transform(F.filter(runs, lambda r: r["text"] != ""), one), "")


def line_boxes(lines: DataFrame) -> DataFrame:
    """Adds ``box`` to assembly.lines(): the line's text, or the image in its place, at its place on the page."""
    s, i = F.col("segment"), F.col("image")
    indentation = F.when(s["indented"], F.col("outdent"))
    text = render.line_box(s["vertical"], s["line_height"], s["text_height"], s["baseline"], s["column_start"], s["width"], F.col("class"), paragraph_runs(F.col("runs")), F.col("line_grid"), indentation)
    zero = F.lit(0)
    inner = render.image_box(i["url"], zero, zero, i["width"], i["height"])
    inline = render.object_line(s["vertical"], i["height"], s["column_start"], s["width"], F.col("class"), inner)
    alone = render.image_box(i["url"], i["x"], F.coalesce(F.col("first"), zero) + i["y"], i["width"], i["height"])
    return lines.withColumn("box", F.when(s.isNull(), alone).when(i.isNotNull(), inline).otherwise(text))


def style_sheets(styles: DataFrame) -> DataFrame:
    """doc, ``css``: the fixed rules, one of each character style and one of each paragraph style."""
    c = lambda x, k: render.char_rule(k, x["size"].cast("double"), x["color"], x["font"], x["bold"], x["italic"], _spacing(x["spacing"]))
    chars = F.array_join(F.transform("char_shapes", c), "")
    paras = F.array_join(F.transform("para_shapes", lambda a, k: render.para_rule(k, a)), "")
    return styles.select("doc", F.concat(F.lit(render.FIXED_CSS), chars, paras, F.lit(render.PRINT_CSS)).alias("css"))


def _spacing(by_language: Column) -> Column:
    """The first spacing that is not 0."""
    return F.coalesce(F.get(F.filter(by_language, lambda v: v != 0), 0), F.lit(0))


def paged(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds ``page`` to lines: pages break before paragraphs, by what they say and where they begin."""
    p = F.col("page")
    mm = lambda c: units.to_mm(p[c])
    known = p.isNotNull()
    high = units.content_height(*[F.when(known, mm(c)) for c in ("paper_height", "top_margin", "bottom_margin", "header_margin", "footer_margin")])
    heights = styles.select("doc", high.alias("content_height"))
    paragraphs = lines.groupBy("doc", "paragraph").agg(F.first("first").alias("first"), F.first("breaks").alias("breaks")).join(heights, "doc")
    paragraphs = paragraphs.withColumn("vertical", units.int_to_mm("first")).withColumn("changes", F.lit(False))
    pages = sequence.pages(paragraphs, "doc", "paragraph", "vertical", "breaks", "changes", "content_height")
    return lines.join(pages.select("doc", "paragraph", "page"), ["doc", "paragraph"])


def documents(files: DataFrame, folder: str | None = "images") -> DataFrame:
    """files: ``path``, ``content``. doc, ``html`` of compound documents with at least one line."""
    lines, styles = assembly.lines(files, folder), assembly.styles(files)
    p = F.col("page_def")
    length = lambda c, default: F.when(p.isNotNull(), units.round2(c)).otherwise(F.lit(default))
    mm = lambda c: units.to_mm(p[c])
    about = styles.withColumnRenamed("page", "page_def").join(style_sheets(styles), "doc")
    about = about.select("doc", "css", length(mm("paper_width"), 210.0).alias("w"), length(mm("paper_height"), 297.0).alias("h"), length(mm("left_margin") + mm("binding_margin"), 20.0).alias("l"), length(mm("top_margin") + mm("header_margin"), 24.99).alias("t"))
    rows = line_boxes(paged(lines, styles)).withColumn("ord", F.struct("paragraph", "line")).join(about, "doc")
    return render.html_document(rows, "doc", "page", "ord", "box", F.col("css"), F.col("w"), F.col("h"), F.col("l"), F.col("t"))
