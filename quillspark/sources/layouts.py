"""Byte layouts of records, as data. All numbers are little-endian.

A layout names its fields in order with a code: u8 i8 u16 i16 u32 i32 f64; ``u16*7`` an array; ``str`` UTF-16 text after its
length in units (u16); ``ch`` one UTF-16 unit as text; ``raw`` the rest; ``skip*n``. A ``?`` makes a field and all after it
null where the record ends before it. ``bits`` derives fields from others: name -> (field, lowest bit, width, values or None);
with values the number picks a name (the last one stands for all beyond), a width of 1 without values is a boolean.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

_CODES = {"u8": ("B", "int"), "i8": ("b", "int"), "u16": ("H", "int"), "i16": ("h", "int"), "u32": ("I", "long"), "i32": ("i", "int"), "f64": ("d", "double")}


class RecordError(ValueError):
    pass


@dataclass
class Layout:
    least: int
    fields: list[tuple[str, str]]
    bits: dict[str, tuple] = field(default_factory=dict)

    def ddl(self) -> str:
        out = []
        for name, code in self.fields:
            code = code.rstrip("?")
            kind, _, n = code.partition("*")
            if kind == "skip":
                continue
            base = {"str": "string", "ch": "string", "raw": "binary"}.get(kind) or _CODES[kind][1]
            out.append(f"`{name}` {f'array<{base}>' if n else base}")
        for name, (_, _, width, values) in self.bits.items():
            out.append(f"`{name}` {'string' if values else 'boolean' if width == 1 else 'int'}")
        return ", ".join(out)

    def decode(self, data: bytes) -> dict:
        if len(data) < self.least:
            raise RecordError(f"{len(data)} bytes, at least {self.least} needed")
        out: dict = {}
        at = 0
        for name, code in self.fields:
            optional = code.endswith("?")
            value, at, ok = read(data, at, code.rstrip("?"))
            if not ok:
                if not optional:
                    raise RecordError(f"{name} at {at} is cut off")
                at = len(data) + 1
            if not code.startswith("skip"):
                out[name] = value
        for name, (source, low, width, values) in self.bits.items():
            number = out.get(source)
            if number is None:
                out[name] = None
                continue
            number = (number >> low) & ((1 << width) - 1)
            out[name] = values[min(number, len(values) - 1)] if values else bool(number) if width == 1 else number
        return out


    def record_type(self) -> np.dtype | None:
        """The layout as one numpy record, if all its fields have a fixed size."""
        parts = [(f"{name}-{k}" if code.startswith("skip") else name, *code.rstrip("?").partition("*")[::2]) for k, (name, code) in enumerate(self.fields)]
        if not parts or not all(kind in _CODES or kind == "skip" for _, kind, _ in parts):
            return None
        return np.dtype([(name, f"V{n}") if kind == "skip" else (name, f"<{'f' if kind[0] == 'f' else kind[0]}{int(kind[1:]) // 8}", *([(int(n),)] if n else [])) for name, kind, n in parts])

    def decode_all(self, payloads: pa.Array, skip: int = 0) -> dict[str, pa.Array] | None:
        """Columns of all rows at once, where every payload holds all fields; else None."""
        kind = self.record_type()
        if kind is None or not len(payloads) or payloads.null_count:
            return None
        _, offsets, data = payloads.buffers()
        at = np.frombuffer(offsets, np.int32)[payloads.offset : payloads.offset + len(payloads) + 1]
        if (np.diff(at) - skip < max(kind.itemsize, self.least)).any():
            return None
        raw = np.frombuffer(data, np.uint8)[(at[:-1] + skip)[:, None] + np.arange(kind.itemsize)]
        rows = np.ascontiguousarray(raw).view(kind).ravel()
        out = {}
        for name, code in self.fields:
            if code.startswith("skip"):
                continue
            values = np.ascontiguousarray(rows[name])
            if values.ndim == 2:
                ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
                out[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
            else:
                out[name] = pa.array(values)
        for name, (source, low, width, values) in self.bits.items():
            number = (rows[source].astype(np.int64) >> low) & ((1 << width) - 1)
            out[name] = pa.array(values, pa.string()).take(pa.array(np.minimum(number, len(values) - 1))) if values else pa.array(number.astype(bool) if width == 1 else number)
        return out


def read(data: bytes, at: int, code: str):
    """(value, next offset, whether it was there)."""
    kind, _, n = code.partition("*")
    if kind == "skip":
        return None, at + int(n), at + int(n) <= len(data)
    if kind == "raw":
        return data[at:], max(at, len(data)), at <= len(data)
    if kind == "str":
        if at + 2 > len(data):
            return None, at, False
        size = 2 * struct.unpack_from("<H", data, at)[0]
        if at + 2 + size > len(data):
            return None, at, False
        return utf16(data[at + 2 : at + 2 + size]), at + 2 + size, True
    if kind == "ch":
        if at + 2 > len(data):
            return None, at, False
        return (utf16(data[at : at + 2]) or "").replace("\0", ""), at + 2, True
    letter = _CODES[kind][0]
    size = struct.calcsize(letter) * int(n or 1)
    if at + size > len(data):
        return None, at, False
    values = struct.unpack_from(f"<{n or 1}{letter}", data, at)
    return (list(values) if n else values[0]), at + size, True


def utf16(data: bytes) -> str | None:
    """Null for what is no UTF-16."""
    try:
        return data.decode("utf-16-le")
    except UnicodeDecodeError:
        return None


# Record tags from the first tag (16) on.
FIRST = 16
DOC_TAGS = {
    "document_properties": 0, "id_mappings": 1, "bin_data": 2, "face_name": 3, "border_fill": 4, "char_shape": 5, "tab_def": 6, "numbering": 7, "bullet": 8, "para_shape": 9, "style": 10,
    "doc_data": 11, "distribute_doc_data": 12, "compatible_document": 14, "layout_compatibility": 15, "track_change_info": 16, "memo_shape": 76, "forbidden_char": 78,
    "track_change_content": 80, "track_change_author": 81,
}
#: Level at which a record of a document-wide table counts.
DOC_LEVELS = {kind: 0 if kind in ("document_properties", "id_mappings", "doc_data", "distribute_doc_data", "compatible_document", "forbidden_char") else 1 for kind in DOC_TAGS if kind != "memo_shape"}
BODY_TAGS = {
    "para_header": 50, "para_text": 51, "para_char_shape": 52, "para_line_seg": 53, "para_range_tag": 54, "ctrl_header": 55, "list_header": 56, "page_def": 57, "footnote_shape": 58,
    "page_border_fill": 59, "shape_component": 60, "table": 61, "line": 62, "rectangle": 63, "ellipse": 64, "arc": 65, "polygon": 66, "curve": 67, "ole": 68, "picture": 69, "container": 70,
    "ctrl_data": 71, "equation": 72, "textart": 74, "form_object": 75, "memo_shape": 76, "memo_list": 77, "chart_data": 79, "video_data": 82, "unknown_shape": 99,
}

_LANGUAGES = 7
_ALIGN = ["justify", "left", "right", "center", "distribute", "divide"]
_OPAQUE = Layout(0, [("data", "raw")])
_XY = lambda name: [(f"{name}_x", "i32"), (f"{name}_y", "i32")]

LAYOUTS: dict[str, Layout] = {
    "file_header": Layout(256, [("signature", "skip*32"), ("version", "u32"), ("document_flags", "u32"), ("license_flags", "u32"), ("encrypt_version", "u32"), ("kogl_country", "u8")]),
    "document_properties": Layout(26, [("area_count", "u16"), ("page_start", "u16"), ("footnote_start", "u16"), ("endnote_start", "u16"), ("image_start", "u16"), ("table_start", "u16"), ("formula_start", "u16"), ("list_id", "u32"), ("paragraph_id", "u32"), ("character_position", "u32")]),
    "id_mappings": Layout(60, [("counts", "i32*15"), ("memo_shapes", "i32?"), ("track_changes", "i32?"), ("track_change_authors", "i32?")]),
    "face_name": Layout(3, []),
    "char_shape": Layout(
        68,
        [("font_ids", f"u16*{_LANGUAGES}"), ("stretch", f"u8*{_LANGUAGES}"), ("spacing", f"i8*{_LANGUAGES}"), ("relative_size", f"u8*{_LANGUAGES}"), ("position", f"i8*{_LANGUAGES}"), ("base_size", "i32"), ("attributes", "u32"),
         ("shadow_x", "i8"), ("shadow_y", "i8"), ("text_color", "u32"), ("underline_color", "u32"), ("shading_color", "u32"), ("shadow_color", "u32"), ("border_fill_id", "u16?"), ("strikethrough_color", "u32?")],
        {"italic": ("attributes", 0, 1, None), "bold": ("attributes", 1, 1, None), "underline_type": ("attributes", 2, 2, None), "underline_style": ("attributes", 4, 4, None), "outline": ("attributes", 8, 3, None),
         "shadow": ("attributes", 11, 2, None), "emboss": ("attributes", 13, 1, None), "engrave": ("attributes", 14, 1, None), "superscript": ("attributes", 15, 1, None), "subscript": ("attributes", 16, 1, None),
         "strikethrough": ("attributes", 18, 3, None), "emphasis": ("attributes", 21, 4, None), "font_spacing": ("attributes", 25, 1, None), "strikethrough_style": ("attributes", 26, 4, None), "kerning": ("attributes", 30, 1, None)},
    ),
    "para_shape": Layout(
        46,
        [("attributes1", "u32"), ("left_margin", "i32"), ("right_margin", "i32"), ("indent", "i32"), ("outdent", "i32"), ("top_spacing", "i32"), ("bottom_spacing", "i32"), ("tab_def_id", "u16"), ("number_bullet_id", "u16"),
         ("border_fill_id", "u16"), ("border_spacing", "i16*4"), ("attributes2", "u32?"), ("attributes3", "u32?"), ("line_spacing", "i32?")],
        {"align": ("attributes1", 2, 3, _ALIGN), "line_grid": ("attributes1", 8, 1, None), "with_next": ("attributes1", 17, 1, None), "protect": ("attributes1", 18, 1, None), "page_break_before": ("attributes1", 19, 1, None),
         "vertical_align": ("attributes1", 20, 2, None), "header_shape": ("attributes1", 23, 2, ["none", "outline", "number", "bullet"]), "level": ("attributes1", 25, 3, None)},
    ),
    "style": Layout(12, [("local_name", "str"), ("english_name", "str"), ("attribute", "u8"), ("next_style_id", "u8"), ("lang_id", "i16"), ("para_shape_id", "u16"), ("char_shape_id", "u16")], {"kind": ("attribute", 0, 3, ["paragraph", "character", "other"])}),
    "bullet": Layout(12, [("attributes", "u32"), ("width", "i16"), ("space", "i16"), ("char_shape_id", "i32"), ("bullet_char", "ch?"), ("image_id", "i32?"), ("image", "u8*4?"), ("check_char", "ch?")]),
    "distribute_doc_data": Layout(256, [("data", "raw")]),
    "layout_compatibility": Layout(20, [("character", "u32"), ("paragraph", "u32"), ("section", "u32"), ("object", "u32"), ("field", "u32")]),
    "track_change_info": Layout(1032, [("data", "raw")]),
    "memo_shape": _OPAQUE, "forbidden_char": _OPAQUE, "track_change_content": _OPAQUE, "track_change_author": _OPAQUE,
    "para_header": Layout(
        22, [("chars", "u32"), ("control_mask", "u32"), ("para_shape_id", "u16"), ("style_id", "u8"), ("divide", "u8"), ("n_char_shapes", "u16"), ("n_range_tags", "u16"), ("n_line_segs", "u16"), ("instance_id", "u32"), ("section_merge", "u16?")],
        {"text_char_count": ("chars", 0, 31, None), "divide_section": ("divide", 0, 1, None), "divide_columns": ("divide", 1, 1, None), "divide_page": ("divide", 2, 1, None), "divide_column": ("divide", 3, 1, None)},
    ),
    "page_def": Layout(
        40, [("paper_width", "u32"), ("paper_height", "u32"), ("left_margin", "u32"), ("right_margin", "u32"), ("top_margin", "u32"), ("bottom_margin", "u32"), ("header_margin", "u32"), ("footer_margin", "u32"), ("binding_margin", "u32"), ("attributes", "u32")],
        {"direction": ("attributes", 0, 1, ["vertical", "horizontal"]), "binding": ("attributes", 1, 2, ["single", "facing", "top"])},
    ),
    "footnote_shape": Layout(
        26, [("attributes", "u32"), ("user_symbol", "ch"), ("prefix", "ch"), ("suffix", "ch"), ("start_number", "u16"), ("divider", "i16*4"), ("divider_type", "u8"), ("divider_thickness", "u8"), ("divider_color", "u32")],
        {"number_shape": ("attributes", 0, 8, None), "position": ("attributes", 8, 2, None), "numbering": ("attributes", 10, 2, ["continue", "restart", "per_page"]), "superscript": ("attributes", 12, 1, None), "show_prefix": ("attributes", 13, 1, None)},
    ),
    "page_border_fill": Layout(14, [("attributes", "u32"), ("spacing", "i16*4"), ("border_fill_id", "u16")], {"from_paper": ("attributes", 0, 1, None), "with_header": ("attributes", 1, 1, None), "with_footer": ("attributes", 2, 1, None)}),
    "line": Layout(18, [*_XY("start"), *_XY("end"), ("flag", "u16")]),
    "rectangle": Layout(33, [("corner_curvature", "u8"), ("x", "i32*4"), ("y", "i32*4")]),
    "ellipse": Layout(60, [("attributes", "u32"), *_XY("center"), *_XY("axis1"), *_XY("axis2"), *_XY("start"), *_XY("end"), *_XY("start2"), *_XY("end2")], {"recalculate": ("attributes", 0, 1, None), "is_arc": ("attributes", 1, 1, None), "arc_type": ("attributes", 2, 8, None)}),
    "arc": Layout(28, [("attributes", "u32"), *_XY("center"), *_XY("axis1"), *_XY("axis2")], {"recalculate": ("attributes", 0, 1, None), "is_arc": ("attributes", 1, 1, None), "arc_type": ("attributes", 2, 8, None)}),
    "ole": Layout(24, [("attributes", "u16"), ("extent_x", "i32"), ("extent_y", "i32"), ("bindata_id", "u16"), ("border_color", "u32"), ("border_width", "i32"), ("border_attributes", "u32")], {"aspect": ("attributes", 0, 8, None), "moniker": ("attributes", 8, 1, None), "baseline": ("attributes", 9, 7, None)}),
    "picture": Layout(
        78, [("border_color", "u32"), ("border_width", "i32"), ("border_attributes", "u32"), ("x", "i32*4"), ("y", "i32*4"), ("crop", "i32*4"), ("padding", "i16*4"), ("brightness", "i8"), ("contrast", "i8"), ("effect", "u8"), ("bindata_id", "u16"),
             ("opacity", "u8"), ("instance_id", "u32"), ("effects", "raw")],
    ),
    "textart": _OPAQUE, "unknown_shape": _OPAQUE, "form_object": _OPAQUE, "memo_list": _OPAQUE, "chart_data": _OPAQUE,
    "equation": Layout(16, [("attributes", "u32"), ("script", "str"), ("size", "u32"), ("color", "u32"), ("baseline", "i16?"), ("version", "str?"), ("font", "str?")]),
}

# Control identifiers, as read after their bytes are turned round, and the layout of each.
CONTROLS = {
    "tbl ": "object_common", "gso ": "object_common", "cold": "column_definition", "fn  ": "footnote_endnote", "en  ": "footnote_endnote", "head": "header_footer", "foot": "header_footer", "pgno": "page_number_position",
    "pgnp": "page_number_position", "%%%%": "field", "secd": "section_definition", "autn": "auto_number", "atno": "auto_number", "newn": "new_number", "pghd": "hide", "pgad": "page_adjust", "bkmk": "bookmark_marker",
    "over": "overlap", "cmtt": "comment", "hide": "hidden_description",
}
_POSITIONS = ["none", "top_left", "top_center", "top_right", "bottom_left", "bottom_center", "bottom_right", "outside_top", "outside_bottom", "inside_top", "inside_bottom", "none"]
CONTROL_LAYOUTS: dict[str, Layout] = {
    "object_common": Layout(
        40, [("attributes", "u32"), ("offset_y", "i32"), ("offset_x", "i32"), ("width", "u32"), ("height", "u32"), ("z_order", "i32"), ("margin_bottom", "i16"), ("margin_left", "i16"), ("margin_right", "i16"), ("margin_top", "i16"),
             ("instance_id", "u32"), ("page_divide", "i32"), ("description", "str?")],
        {"like_letters": ("attributes", 0, 1, None), "affect_line_spacing": ("attributes", 2, 1, None), "vert_rel_to": ("attributes", 3, 2, ["paper", "page", "para"]), "vert_relative": ("attributes", 5, 3, None),
         "horz_rel_to": ("attributes", 8, 2, ["paper", "page", "column", "para"]), "horz_relative": ("attributes", 10, 3, None), "para_limit": ("attributes", 13, 1, None), "overlap": ("attributes", 14, 1, None),
         "width_standard": ("attributes", 15, 3, ["paper", "page", "column", "para", "absolute"]), "height_standard": ("attributes", 18, 2, ["paper", "page", "absolute"]), "size_protect": ("attributes", 20, 1, None),
         "text_option": ("attributes", 21, 3, ["square", "tight", "through", "top_and_bottom", "behind_text", "in_front_of_text", "square"]), "text_position": ("attributes", 24, 2, ["both_sides", "left_only", "right_only", "largest_only"]),
         "category": ("attributes", 26, 3, ["none", "figure", "table", "equation", "none"])},
    ),
    "footnote_endnote": Layout(8, [("number", "u8"), ("reserved", "skip*5"), ("attribute", "u8"), ("reserved2", "u8")]),
    "header_footer": Layout(4, [("attributes", "u32"), ("text_width", "u32?"), ("text_height", "u32?"), ("text_ref", "u8?"), ("number_ref", "u8?")], {"apply_page": ("attributes", 0, 2, ["both", "even_only", "odd_only", "both"])}),
    "page_number_position": Layout(12, [("flags", "u32"), ("user_symbol", "ch"), ("prefix", "ch"), ("suffix", "ch")], {"shape": ("flags", 0, 8, None), "position": ("flags", 8, 4, _POSITIONS)}),
    "field": Layout(15, [("field_type", "u8*4"), ("attribute", "u32"), ("other_attribute", "u8"), ("command", "str?"), ("id", "u32?")]),
    "section_definition": Layout(24, [("attributes", "u32"), ("column_spacing", "u16"), ("vertical_alignment", "u16"), ("horizontal_alignment", "u16"), ("tip_spacing", "u32"), ("number_para_shape_id", "u16"), ("page_number", "u16"), ("figure_number", "u16"), ("table_number", "u16"), ("equation_number", "u16"), ("language", "u16?")]),
    "auto_number": Layout(12, [("attributes", "u32"), ("number", "u16"), ("user_symbol", "ch"), ("prefix", "ch"), ("suffix", "ch")], {"kind": ("attributes", 0, 4, None), "shape": ("attributes", 4, 8, None)}),
    "new_number": Layout(8, [("attributes", "u32"), ("number", "u16"), ("reserved", "skip*2")], {"kind": ("attributes", 0, 4, None)}),
    "hide": Layout(2, [("attributes", "u16")]),
    "page_adjust": Layout(4, [("attributes", "u32")]),
    "bookmark_marker": Layout(6, [("keyword1", "str"), ("keyword2", "str?")]),
    "overlap": Layout(10, [("ctrl_id", "skip*4"), ("text", "str"), ("border_type", "u8?"), ("text_size", "i8?"), ("spread", "u8?")]),
    "comment": Layout(18, [("main_text", "str"), ("sub_text", "str?"), ("position", "u32?"), ("size_ratio", "u32?"), ("option", "u32?"), ("style_number", "u32?"), ("alignment", "u32?")]),
    "hidden_description": Layout(0, []),
    "other": Layout(0, [("data", "raw")]),
}
