"""Integers, flags and bit fields of binary records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the bits from 0 on.
DOCUMENT_FLAGS = [
    "compressed", "encrypted", "distribution", "script", "drm", "xml_template", "history", "electronic_signature", "certificate_encryption",
    "signature_preview", "certificate_drm", "ccl", "mobile_optimized", "privacy_security", "track_change", "kogl", "video_control", "table_of_contents",
]
CONTROL_FLAGS = {
    2: "section_column_definition", 3: "field_start", 4: "field_end", 8: "title_mark", 9: "tab", 10: "line_break", 11: "gso_table", 13: "paragraph_break", 15: "hidden_comment", 16: "header_footer", 17: "footnote_endnote",
    18: "auto_number", 21: "page_control", 22: "bookmark", 23: "additional_text_overlapping_letter", 24: "hyphen", 30: "bundle_blank", 31: "fix_width_blank",
}
LICENSE_FLAGS = ["ccl_kogl", "copy_restricted", "copy_allowed_same_condition"]


def little_endian(data: Column | str, offset: int, size: int, signed: bool = False) -> Column:
    """Integer of ``size`` bytes (at most 7, or 8 signed) at a byte offset of a binary column; null beyond its end."""
    data = F.col(data) if isinstance(data, str) else data
    part = F.substring(data, offset + 1, size)
    value = F.lit(0).cast("long")
    for k in range(size):
        byte = F.conv(F.hex(F.substring(part, k + 1, 1)), 16, 10).cast("long")
        value = value.bitwiseOR(F.shiftleft(byte, 8 * k))
    if signed and size < 8:
        value = F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)
    return F.when(F.octet_length(part) == size, value)


def field(value: Column | str, low: int, width: int) -> Column:
    """Bits from ``low`` on as a number."""
    value = (F.col(value) if isinstance(value, str) else value).cast("long")
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def has_bit(value: Column | str, bit: int) -> Column:
    return field(value, bit, 1) == 1


def flag_names(value: Column | str, names: list[str]) -> Column:
    """Names of the bits that are set, in order."""
    return F.array_compact(F.array(*[F.when(has_bit(value, k), F.lit(name)) for k, name in enumerate(names)]))


def has_control(mask: Column | str, name: str) -> Column:
    """Whether a paragraph's control mask says that it holds controls of this kind."""
    return has_bit(mask, next(bit for bit, known in CONTROL_FLAGS.items() if known == name))


def control_flags(mask: Column | str) -> Column:
    """Names of the kinds of controls in a paragraph's mask, in order of their bits."""
    return F.array_compact(F.array(*[F.when(has_bit(mask, bit), F.lit(name)) for bit, name in CONTROL_FLAGS.items()]))


def record_header(value: Column | str) -> tuple[Column, Column, Column]:
    """(tag, level, size) of a record's first 32 bits; size 4095 says that the size follows."""
    return field(value, 0, 10), field(value, 10, 10), field(value, 20, 12)


def auto_number_kind(attributes: Column | str) -> Column:
    return field(attributes, 0, 4)


def auto_number_shape(attributes: Column | str) -> Column:
    return field(attributes, 4, 8)
