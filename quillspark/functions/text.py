"""Text: control characters, trimming, escaping, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the control characters 0 to 31; the others are reserved.
CONTROL_NAMES = {
    0: "NULL", 4: "FIELD_END", 8: "TITLE_MARK", 9: "TAB", 10: "LINE_BREAK", 11: "SHAPE_OBJECT", 13: "PARA_BREAK", 15: "HIDDEN_DESC", 16: "HEADER_FOOTER",
    17: "FOOTNOTE", 18: "AUTO_NUMBER", 21: "PAGE_CONTROL", 22: "BOOKMARK", 23: "COMMENT_OVERLAP", 24: "HYPHEN", 30: "BOUND_SPACE", 31: "FIXED_SPACE",
}
SINGLE = (0, 10, 13, 24, 30, 31)
CONVERTIBLE = (9, 10, 13, 24, 30, 31)
_WHITE = r"[\t-\r \u0085   -     　]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(s: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(s), f"^{_WHITE}|{_WHITE}$", "")


def meaningful(s: Column | str) -> Column:
    return F.coalesce(trim(s) != "", F.lit(False))


def control_size(code: Column | str) -> Column:
    """UTF-16 units that a character takes: most control characters take eight."""
    code = _c(code)
    return F.when(code > 31, 1).when(code.isin(*SINGLE), 1).otherwise(8)


def control_text(code: Column | str) -> Column:
    code = _c(code)
    return F.when(code == 9, F.lit("\t")).when(code.isin(10, 13), F.lit("\n")).when(code == 24, F.lit("-")).when(code.isin(30, 31), F.lit(" "))


def is_convertible(code: Column | str) -> Column:
    return _c(code).isin(*CONVERTIBLE)


def control_name(code: Column | str) -> Column:
    code = _c(code)
    out = F.when(code > 31, F.concat(F.lit("UNKNOWN_"), code.cast("string")))
    for k, name in CONTROL_NAMES.items():
        out = out.when(code == k, F.lit(name))
    return out.otherwise(F.concat(F.lit("RESERVED_"), code.cast("string")))


def inline_name(data: Column | str) -> Column:
    """The identifier in the first four bytes after an inline control, if they are printable; else null."""
    head = F.substring(_c(data), 1, 4)
    text = F.regexp_replace(F.decode(head, "ISO-8859-1"), "\\x00+$", "")
    return F.when((F.octet_length(_c(data)) >= 12) & F.decode(head, "ISO-8859-1").rlike("^[\\x00\\x20-\\x7E]{4}$") & (text != ""), text)


def tab_text(leader: Column | str, width: Column | str) -> Column:
    """A tab with a leader as characters."""
    leader, width = _c(leader), _c(width).cast("long")

    def filled(mark: str, unit: int, low: int, high: int) -> Column:
        return F.repeat(F.lit(mark), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(width / unit))).cast("int"))

    return F.when(leader == 3, filled(".", 1200, 3, 80)).when(leader == 2, filled("-", 2400, 2, 40)).when(leader == 1, filled("_", 2400, 2, 40)).otherwise(F.lit("\t"))


def local_name(tag: Column | str) -> Column:
    """An XML name without its prefix."""
    return F.regexp_extract(_c(tag), "([^:]+)$", 1)


def with_breaks(s: Column | str, breaks: Column | str) -> Column:
    """A paragraph cut at character positions (sorted array), pieces trimmed, joined by Markdown line breaks."""
    s, breaks = _c(s), _c(breaks)
    starts = F.concat(F.array(F.lit(0)), breaks)
    ends = F.concat(breaks, F.array(F.length(s)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: trim(F.substring(s, p["a"] + 1, p["b"] - p["a"])))
    return F.array_join(pieces, "  \n")


def markdown_style(s: Column | str, italic: Column, bold: Column, strike: Column) -> Column:
    """Marks around text, innermost first; blank text gives nothing."""
    out = _c(s)
    for flag, mark in ((italic, "*"), (bold, "**"), (strike, "~~")):
        out = F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(mark), out, F.lit(mark))).otherwise(out)
    return F.when(meaningful(s), out).otherwise(F.lit(""))


def hard_edges(s: Column | str) -> Column:
    """One leading and one trailing space as ``&nbsp;``."""
    return F.regexp_replace(F.regexp_replace(_c(s), "^ ", "&nbsp;"), " $", "&nbsp;")


def cell_text(s: Column | str) -> Column:
    """Text of a pipe table's cell."""
    return F.replace(F.replace(_c(s), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def caption(s: Column | str) -> Column:
    """struct(label, number, body) of a caption such as ``표 3 body``; the label is ``표`` where none is written."""
    s = _c(s)
    found = F.regexp_extract(s, "^표 ([0-9]+)", 1)
    return F.struct(F.lit("표").alias("label"), F.nullif(found, F.lit("")).alias("number"), trim(F.regexp_replace(s, "^표( [0-9]+)?", "")).alias("body"))


def no_nul(s: Column | str) -> Column:
    return F.replace(_c(s), F.lit("\0"), F.lit(""))


def blank_format(s: Column | str) -> Column:
    """Whether an outline format is only NULs; an empty one is not."""
    return (F.length(_c(s)) > 0) & (no_nul(s) == "")


# Beginnings of parts that stand alone, controls that Markdown shows, and what stands for those that it can't.
BLOCKS = ("![이미지]", "|", "---")
SHOWN_CONTROLS = ("tbl ", "gso ", "head", "foot")
PLACEHOLDERS = {"head": "## 머리말", "foot": "## 꼬리말", "fn  ": "## 각주", "en  ": "## 미주"}
TABLE_LABEL, TABLE_MISSING = "**표**", "\n\n*[표 내용은 추출되지 않았습니다]*"


def is_block(part: Column | str) -> Column:
    """Whether a part of a paragraph stands alone: an image, a table or a rule."""
    part = _c(part)
    return part.startswith(BLOCKS[0]) | part.startswith(BLOCKS[1]) | part.startswith(BLOCKS[2])


def shows_control(ident: Column | str) -> Column:
    """Whether Markdown renders a control of this identifier itself."""
    return _c(ident).isin(*SHOWN_CONTROLS)


def control_placeholder(ident: Column | str, description: Column | str, has_table: Column) -> Column:
    """What stands for a control in Markdown: a title for headers, footers and notes, a note for a table that was not read; else nothing."""
    ident, about = _c(ident), trim(_c(description))
    label = F.concat(F.lit(TABLE_LABEL), F.when(F.coalesce(about, F.lit("")) != "", F.concat(F.lit(": "), about)).otherwise(F.lit("")), F.lit(TABLE_MISSING))
    out = F.when(ident == "tbl ", F.when(has_table, F.lit("")).otherwise(label))
    for known, title in PLACEHOLDERS.items():
        out = out.when(ident == known, F.lit(title))
    return out.otherwise(F.lit(""))


def byte_index(s: Column | str, index: Column | str) -> Column:
    """Where the character at an index (from 0) begins among the text's UTF-8 bytes; null beyond the last one."""
    s, index = _c(s), _c(index).cast("int")
    return F.when(index < F.length(s), F.octet_length(F.substring(s, F.lit(1), index)).cast("long"))
