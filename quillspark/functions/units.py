"""Lengths, colours and positions on a page. Lengths are 1/7200 inch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of a border in mm by its code.
BORDER_WIDTHS = [0.10, 0.12, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 1.00, 1.50, 2.00, 3.00, 4.00, 5.00]
PAGE_DEFAULTS = {"height": 297.0, "top": 24.99, "bottom": 10.0, "header": 0.0, "footer": 0.0}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_mm(v: Column | str) -> Column:
    return _c(v).cast("double") / 7200.0 * 25.4


def to_inches(v: Column | str) -> Column:
    return _c(v).cast("double") / 7200.0


def from_mm(mm: Column | str) -> Column:
    """Truncated to whole units."""
    return (_c(mm) / 25.4 * 7200.0).cast("long")


def from_inches(inches: Column | str) -> Column:
    return (_c(inches) * 7200.0).cast("long")


def int_to_mm(v: Column | str) -> Column:
    """The order of operations that styles use; it differs from to_mm in the last bit."""
    return _c(v).cast("double") * 25.4 / 7200.0


def round2(x: Column | str) -> Column:
    """Two decimals, halves away from zero, on doubles."""
    x = _c(x).cast("double") * 100
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double") / 100


def number_text(x: Column | str) -> Column:
    """A double without superfluous zeros: 12.5, 10; for up to two decimals."""
    x = round2(x)
    cents = F.round(x * 100).cast("long")
    size = F.abs(cents)
    sign = F.when(cents < 0, F.lit("-")).otherwise(F.lit(""))
    whole, rest = F.floor(size / 100).cast("string"), size % 100
    tail = F.when(rest == 0, F.lit("")).when(rest % 10 == 0, F.concat(F.lit("."), (rest / 10).cast("long").cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    return F.concat(sign, whole, tail)


def red(c: Column | str) -> Column:
    return _c(c).cast("long").bitwiseAND(F.lit(255))


def green(c: Column | str) -> Column:
    return F.shiftright(_c(c).cast("long"), 8).bitwiseAND(F.lit(255))


def blue(c: Column | str) -> Column:
    return F.shiftright(_c(c).cast("long"), 16).bitwiseAND(F.lit(255))


def rgb(c: Column | str) -> Column:
    """0x00BBGGRR as ``rgb(r,g,b)``."""
    return F.format_string("rgb(%d,%d,%d)", red(c), green(c), blue(c))


def hex_color(c: Column | str) -> Column:
    return F.format_string("#%02X%02X%02X", red(c), green(c), blue(c))


def border_width(code: Column | str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(w) for w in BORDER_WIDTHS]), _c(code).cast("int")), F.lit(0.12))


def letter_spacing(*by_language: Column | str) -> Column:
    """em: the first spacing that is not 0, by half per cent; null if all are 0."""
    return F.coalesce(*[F.nullif(_c(c).cast("double"), F.lit(0.0)) for c in by_language]) / 2.0 / 100.0


def content_height(height: Column, top: Column, bottom: Column, header: Column, footer: Column) -> Column:
    """mm that a page leaves for its body; nulls take the defaults."""
    d = PAGE_DEFAULTS
    parts = [F.coalesce(c, F.lit(d[k])) for c, k in ((height, "height"), (top, "top"), (bottom, "bottom"), (header, "header"), (footer, "footer"))]
    return parts[0] - parts[1] - parts[2] - parts[3] - parts[4]


def aligned(reference: Column, extent: Column, size: Column, offset: Column, mode: Column) -> Column:
    """Left edge of a box in a reference area: mode ``left``, ``center`` or ``right``; the offset counts inward."""
    return F.when(mode == "center", reference + (extent - size) / 2 + offset).when(mode == "right", reference + extent - size - offset).otherwise(reference + offset)


def view_box(width: Column | str, height: Column | str, padding: float = 2.5) -> Column:
    """SVG view box around a table of this size in mm."""
    parts = [F.lit(-padding), F.lit(-padding), _c(width) + 2 * padding, _c(height) + 2 * padding]
    return F.concat_ws(" ", *[number_text(p) for p in parts])


#: Where a page number stands if the page is unknown.
PLACE_DEFAULTS = {"width": 210.0, "height": 297.0, "left": 20.0, "right": 190.0, "top": 10.0, "below": 10.0}


def page_number_place(position: Column, width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column, binding: Column) -> tuple[Column, Column]:
    """(left, top) in mm of a page's number, by its position and the page's lengths in units (nulls: an unknown page). Positions that
    change from page to page stand in the bottom centre."""
    d, known = PLACE_DEFAULTS, height.isNotNull()
    wide, high = F.coalesce(round2(to_mm(width)), F.lit(d["width"])), F.coalesce(round2(to_mm(height)), F.lit(d["height"]))
    at_left = F.when(known, round2(to_mm(left) + to_mm(binding))).otherwise(F.lit(d["left"]))
    at_right = F.when(known, round2(wide - to_mm(right) - to_mm(binding))).otherwise(F.lit(d["right"]))
    above = F.when(known, round2(to_mm(top))).otherwise(F.lit(d["top"]))
    below = F.when(known, round2(high - to_mm(bottom))).otherwise(round2(high - d["below"]))
    x = F.when(position.isin("top_left", "bottom_left"), at_left).when(position.isin("top_right", "bottom_right"), at_right).otherwise(round2(wide / 2.0))
    y = F.when(position.isin("top_left", "top_center", "top_right"), above).otherwise(below)
    none = position == "none"
    return F.when(~none, x), F.when(~none, y)
