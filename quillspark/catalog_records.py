"""Queries that decode one kind of record each.

Payloads are packed in the JVM from columns of ``part``, by a layout that is written down here once more, field after field, framed into
a stream a part, read back by the library's decoders, and held against SQL over the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.catalog import query, table
from quillspark.catalog_binary import ONE_DOWN, framed, le, utf16_units
from quillspark.sources import records


def _bytes(code: str, value: str) -> Column:
    """u1 to u8 and i1 to i4: a number; str: text after its length; ch: one UTF-16 unit; id: a control's letters, turned round; hex: bytes."""
    if code == "hex":
        return F.unhex(F.lit(value))
    e = F.expr(value)
    if code == "str":
        return F.concat(le(F.length(e), 2), utf16_units(e))
    if code == "ch":
        return utf16_units(F.substring(e, 1, 1))
    if code == "id":
        return F.reverse(e).cast("binary")
    return le(e, int(code[1:]))


def payload(fields: list[tuple]) -> Column:
    """fields: (code, value in SQL, or a condition for it to be there besides)."""
    parts = []
    for code, value, *when in fields:
        part = _bytes(code, value)
        parts.append(F.when(F.expr(when[0]), part).otherwise(F.unhex(F.lit(""))) if when else part)
    return F.concat(*parts)


def record(name: str, kind: str, fields: list[tuple], out: list[tuple[str, str, str]], control: bool = False) -> None:
    """Registers a query. out: (name, expression over the decoded row, SQL over part); numbers are compared as 64-bit integers."""
    sql = ", ".join(f"{s} as \"{n}\"" for n, _, s in out)

    @query(name, f"select p_partkey, {sql} from part")
    def _(spark, d):
        level = 1 if control or kind in ONE_DOWN else 0
        rows = framed(table(spark, d, "part").withColumn("o", F.lit(0)), F.col("p_partkey"), "o", "ctrl_header" if control else kind, level, payload(fields))
        got = records.controls(rows, kind) if control else records.typed(rows, kind)
        return got.select(F.col("doc").cast("long").alias("p_partkey"), *[F.expr(e).alias(n) for n, e, _ in out])


def num(name: str, column: str | None = None, sql: str = "") -> tuple[str, str, str]:
    """A number as the decoder gives it and as SQL has it."""
    return name, f"cast({column or name} as bigint)", f"({sql})::bigint"


def same(name: str, sql: str, column: str | None = None) -> tuple[str, str, str]:
    return name, column or name, sql


def pick(number: str, values: list[str]) -> str:
    """SQL that names a number; the last value stands for all others."""
    return f"case {number} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values[:-1])) + f" else '{values[-1]}' end"


# ---------------------------------------------------------------- tables of the whole document

record(
    "d10_document_properties", "document_properties",
    [("u2", "p_size"), ("u2", "p_size + 1"), ("u2", "2"), ("u2", "3"), ("u2", "4"), ("u2", "p_partkey % 60000"), ("u2", "6"), ("u4", "p_partkey"), ("u4", "p_partkey * 2"), ("u4", "9")],
    [num("area_count", sql="p_size"), num("page_start", sql="p_size + 1"), num("footnote_start", sql="2"), num("table_start", sql="p_partkey % 60000"), num("formula_start", sql="6"), num("list_id", sql="p_partkey"), num("paragraph_id", sql="p_partkey * 2")],
)
record(
    "d11_id_mappings", "id_mappings", [*[("i4", f"p_size + {k}") for k in range(15)], ("i4", "p_partkey", "p_size % 2 = 0")],
    [num("first", "counts[0]", "p_size"), num("last", "counts[14]", "p_size + 14"), num("memo_shapes", sql="case when p_size % 2 = 0 then p_partkey end")],
)
record(
    "d12_bin_data", "bin_data", [("u2", "p_size % 3 + p_size % 2 * 16 + p_size % 4 * 256"), ("str", "p_name", "p_size % 3 = 0"), ("u2", "p_partkey % 65536", "p_size % 3 > 0"), ("str", "p_brand")],
    [
        same("kind", pick("p_size % 3", ["link", "embedding", "storage"])), same("compression", pick("p_size % 2", ["default", "compress"])), same("access", pick("p_size % 4", ["never", "success", "error", "ignored"])),
        same("absolute_path", "case when p_size % 3 = 0 then p_name end"), same("relative_path", "case when p_size % 3 = 0 then p_brand end"), num("binary_id", sql="case when p_size % 3 > 0 then p_partkey % 65536 end"),
        same("extension", "case when p_size % 3 = 1 then p_brand end"),
    ],
)
record(
    "d13_face_name", "face_name", [("u1", "p_size % 8 * 32"), ("str", "p_name"), ("u1", "p_size % 3", "p_size % 8 >= 4"), ("str", "p_brand", "p_size % 8 >= 4"), *[("u1", f"p_size % 7 + {k}", "p_size % 4 >= 2") for k in range(10)], ("str", "p_type", "p_size % 2 = 1")],
    [same("name", "p_name"), num("alternative_type", sql="case when p_size % 8 >= 4 then p_size % 3 end"), same("alternative_name", "case when p_size % 8 >= 4 then p_brand end"), num("family", "type_info[9]", "case when p_size % 4 >= 2 then p_size % 7 + 9 end"), same("default_name", "case when p_size % 2 = 1 then p_type end")],
)
_COLOR = "15790320 + p_size"
_SPLIT, _MIXED = "p_size % 2 = 0", "p_size % 2 = 1"
_BORDERS = [
    ("u2", "p_partkey % 16384"), *[x for k in range(4) for x in (("u1", f"p_size % 13 + {k}", _MIXED), ("u1", f"p_size % 11 + {k}", _MIXED), ("u4", f"{_COLOR} + {k}", _MIXED))],
    *[("u1", f"p_size % 13 + {k}", _SPLIT) for k in range(4)], *[("u1", f"p_size % 11 + {k}", _SPLIT) for k in range(4)], *[("u4", f"{_COLOR} + {k}", _SPLIT) for k in range(4)], ("u1", "p_size % 5"), ("u1", "p_size % 6"), ("u4", "p_partkey"),
]
record(
    "d14_border_fill", "border_fill", _BORDERS,
    [
        num("left", "line_types[0]", "p_size % 13"), num("bottom", "line_types[3]", "p_size % 13 + 3"), num("top_width", "widths[2]", "p_size % 11 + 2"), num("right_color", "colors[1]", f"{_COLOR} + 1"), num("diagonal_type", sql="p_size % 5"),
        num("diagonal_width", sql="p_size % 6"), num("diagonal_color", sql="p_partkey"), same("shadow", "(p_partkey & 2) <> 0"), num("diagonal_slash", sql="(p_partkey >> 2) & 7"), num("slash_broken", sql="(p_partkey >> 8) & 3"), same("center_line", "(p_partkey & 8192) <> 0"),
        same("fill", "'none'"),
    ],
)
_HEAD = [("u2", "0"), *[("u1", "1")] * 4, *[("u1", "2")] * 4, *[("u4", "15790320")] * 4, ("hex", "010200000000")]
record(
    "d15_fills", "border_fill",
    [
        *_HEAD, ("u4", "case p_size % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 4 end"), ("u4", "p_partkey", "p_size % 4 = 1"), ("u4", "p_size", "p_size % 4 = 1"), ("i4", "-p_size", "p_size % 4 = 1"),
        ("u1", "p_size % 16", "p_size % 4 = 2"), ("u1", "1", "p_size % 4 = 2"), ("u1", "2", "p_size % 4 = 2"), ("u1", "3", "p_size % 4 = 2"), ("u2", "p_partkey % 65536", "p_size % 4 = 2"),
        *[("i2", e, "p_size % 4 = 3") for e in ("p_size % 4 - 1", "p_size", "-p_size", "7", "50", "3")], *[("i4", f"p_size * {k}", "p_size % 4 = 3") for k in range(3)], *[("u4", f"p_partkey + {k}", "p_size % 4 = 3") for k in range(3)],
    ],
    [
        same("fill", pick("p_size % 4", ["none", "solid", "image", "gradient"])), num("background_color", sql="case when p_size % 4 = 1 then p_partkey end"), num("pattern_type", sql="case when p_size % 4 = 1 then -p_size end"),
        num("image_id", sql="case when p_size % 4 = 2 then p_partkey % 65536 end"), num("angle", sql="case when p_size % 4 = 3 then p_size end"), num("center_x", sql="case when p_size % 4 = 3 then -p_size end"), num("place", "positions[2]", "case when p_size % 4 = 3 then p_size * 2 end"),
        num("border_color", "colors[1]", "15790320"), num("color", "gradient_colors[1]", "case when p_size % 4 = 3 then p_partkey + 1 end"),
    ],
)
_B = [f"(case when p_size % 10 = 0 then 255 else (p_partkey * {2 * k + 3} + {5 * k}) % 41 end)" for k in range(24)]


def _score(types: list[int], widths: list[int], colors: list[list[int]]) -> str:
    out = [f"(case when {_B[w]} <= 15 then 3 else -10 end)" for w in widths] + [f"(case when {_B[t]} <= 32 then 2 else -5 end)" for t in types]
    return " + ".join(out + [f"(case when {' and '.join(f'{_B[k]} = 255' for k in c)} then -2 else 0 end)" for c in colors])


_BY_TURNS = _score([0, 6, 12, 18], [1, 7, 13, 19], [[2, 3, 4, 5], [8, 9, 10, 11], [14, 15, 16, 17], [20, 21, 22, 23]])
_IN_BLOCKS = _score([0, 1, 2, 3], [4, 5, 6, 7], [[8, 9, 10, 11], [12, 13, 14, 15], [16, 17, 18, 19], [20, 21, 22, 23]])
_BETTER = f"({_BY_TURNS}) >= ({_IN_BLOCKS})"
record(
    "a18_better_layout", "border_fill", [("u2", "0"), *[("u1", b) for b in _B], ("hex", "010200000000")],
    [num("second_type", "line_types[1]", f"case when {_BETTER} then {_B[6]} else {_B[1]} end"), num("third_width", "widths[2]", f"case when {_BETTER} then {_B[13]} else {_B[6]} end"), num("last_color_low", "colors[3] & 255", _B[20])],
)
record(
    "d17_tab_def", "tab_def", [("u4", "p_partkey % 4"), ("i2", "p_size % 3"), *[x for k in range(2) for x in (("u4", f"p_partkey * {k + 1}", f"p_size % 3 > {k}"), ("u1", "p_size % 5", f"p_size % 3 > {k}"), ("u1", "p_size % 17", f"p_size % 3 > {k}"), ("u2", "0", f"p_size % 3 > {k}"))], ("hex", "FFFF")],
    [
        same("left_auto", "(p_partkey & 1) <> 0"), same("right_auto", "(p_partkey & 2) <> 0"), num("n", "size(items)", "p_size % 3"), num("position", "get(items, 1).position", "case when p_size % 3 = 2 then p_partkey * 2 end"),
        same("kind", f"case when p_size % 3 > 0 then {pick('p_size % 5', ['left', 'right', 'center', 'decimal', 'left'])} end", "get(items, 0).kind"), num("leader", "get(items, 0).leader", "case when p_size % 3 > 0 then p_size % 17 end"),
    ],
)
record(
    "d18_numbering", "numbering",
    [*[x for k in range(7) for x in (("u4", "p_partkey"), ("i2", f"-{k}"), ("i2", "p_size"), ("u4", f"p_partkey + {k}"), ("str", "p_brand" if k % 2 else "p_name"), ("u2", f"p_size + {k}"), ("u4", f"p_size * {k}"))], ("str", "p_type"), ("str", "p_brand", "p_size % 2 = 0")],
    [
        num("n", "size(levels)", "7"), same("first", "p_name", "levels[0].format"), same("second", "p_brand", "levels[1].format"), num("width", "levels[6].width", "-6"), num("start", "levels[6].start", "p_size + 6"), num("level_start", "levels[3].level_start", "p_size * 3"),
        num("shape", "levels[2].char_shape_id", "p_partkey + 2"), num("more", "size(extended)", "case when p_size % 2 = 0 then 2 else 1 end"), same("eighth", "p_type", "extended[0]"),
    ],
)
record(
    "d19_bullet", "bullet", [("u4", "p_partkey"), ("i2", "-p_size"), ("i2", "p_size"), ("i4", "p_size - 1"), ("ch", "p_brand", "p_size % 2 = 0")],
    [num("attributes", sql="p_partkey"), num("width", sql="-p_size"), num("space", sql="p_size"), num("char_shape_id", sql="p_size - 1"), same("bullet_char", "case when p_size % 2 = 0 then substr(p_brand, 1, 1) end")],
)
_SHAPE1 = "(p_size % 6) * 4 + (p_size % 4) * 8388608 + (p_size % 7) * 33554432 + (p_size % 2) * 524288"
record(
    "d20_para_shape", "para_shape",
    [("u4", _SHAPE1), ("i4", "p_partkey"), ("i4", "-p_size"), ("i4", "p_size"), ("i4", "3"), ("i4", "4"), ("i4", "5"), ("u2", "p_size"), ("u2", "p_size % 9"), ("u2", "p_size % 8"), *[("i2", f"{k} - p_size") for k in range(4)], ("u4", "0"), ("u4", "0", "p_size % 2 = 0"), ("i4", "p_size * 10", "p_size % 2 = 0")],
    [
        same("align", pick("p_size % 6", ["justify", "left", "right", "center", "distribute", "divide"])), same("header_shape", pick("p_size % 4", ["none", "outline", "number", "bullet"])), num("level", sql="p_size % 7"), same("page_break_before", "p_size % 2 = 1"),
        num("left_margin", sql="p_partkey"), num("right_margin", sql="-p_size"), num("tab_def_id", sql="p_size"), num("number_bullet_id", sql="p_size % 9"), num("border_fill_id", sql="p_size % 8"), num("last_spacing", "border_spacing[3]", "3 - p_size"), num("line_spacing", sql="case when p_size % 2 = 0 then p_size * 10 end"),
    ],
)
_BAG = [("u2", "p_size"), ("i2", "3"), ("u2", "1"), ("u2", "4"), ("i4", "-p_size"), ("u2", "2"), ("u2", "1"), ("str", "p_brand"), ("u2", "3"), ("u2", "32768"), ("u2", "9"), ("i2", "1"), ("u2", "5"), ("u2", "8"), ("u4", "p_partkey")]
_BAG_SQL = "'{\"id\":' || p_size || ',\"items\":[{\"id\":1,\"type\":\"i4\",\"value\":' || -p_size || '},{\"id\":2,\"type\":\"bstr\",\"value\":\"' || p_brand || '\"},{\"id\":3,\"type\":\"set\",\"value\":{\"id\":9,\"items\":[{\"id\":5,\"type\":\"ui4\",\"value\":' || p_partkey || '}]}}]}'"
record("d22_doc_data", "doc_data", _BAG, [same("parameters", _BAG_SQL)])
record("d23_distribute", "distribute_doc_data", [("u4", "p_partkey"), ("hex", "00" * 252)], [num("size", "octet_length(data)", "256"), same("head", "upper(lpad(to_hex(p_partkey % 256), 2, '0'))", "hex(substring(data, 1, 1))")])
record("d24_compatible", "compatible_document", [("u4", "p_size % 4")], [same("target", "case p_size % 4 when 0 then 'current' when 1 then '2007' when 2 then 'ms_word' end"), same("unknown", "p_size % 4 = 3", "error is not null")])
record("d25_layout_compatibility", "layout_compatibility", [("u4", f"p_partkey * {k}") for k in range(1, 6)], [num(n, sql=f"p_partkey * {k}") for k, n in enumerate(("character", "paragraph", "section", "object", "field"), 1)])
record("d26_track_change", "track_change_info", [("u4", "p_partkey"), ("hex", "00" * 1028)], [num("size", "octet_length(data)", "1032")])
record("d27_opaque", "track_change_author", [("str", "p_name")], [num("size", "octet_length(data)", "2 + 2 * length(p_name)")])

# ---------------------------------------------------------------- paragraphs and tables

record("d33_para_char_shape", "para_char_shape", [("u4", "0"), ("u4", "p_size"), ("u4", "p_partkey"), ("u4", "p_size + 1")], [num("n", "size(shapes)", "2"), num("position", "shapes[1].position", "p_partkey"), num("first", "shapes[0].shape_id", "p_size"), num("second", "shapes[1].shape_id", "p_size + 1")])
record(
    "d35_range_tags", "para_range_tag", [("u4", "p_size"), ("u4", "p_size + 7"), ("u4", "p_size * 16777216 + p_partkey"), ("hex", "01", "p_size % 5 = 0")],
    [num("start", "tags[0].start", "case when p_size % 5 > 0 then p_size end"), num("end_at", "tags[0].end", "case when p_size % 5 > 0 then p_size + 7 end"), num("kind", "tags[0].tag_type", "case when p_size % 5 > 0 then p_size end"), num("data", "tags[0].tag_data", "case when p_size % 5 > 0 then p_partkey end"), same("broken", "p_size % 5 = 0", "error is not null")],
)
record(
    "d37_table", "table",
    [("u4", "p_partkey"), ("u2", "2"), ("u2", "p_size"), ("i2", "-3"), *[("i2", f"{k}") for k in range(4)], ("u2", "p_size % 5"), ("u2", "p_size % 6"), ("u2", "p_size % 7"), ("u2", "p_size % 3"), *[x for k in range(2) for x in (("u2", f"{k}", f"p_size % 3 > {k}"), ("u2", "1", f"p_size % 3 > {k}"), ("u2", "p_size", f"p_size % 3 > {k}"), ("u2", "3", f"p_size % 3 > {k}"), ("u2", "p_partkey % 100", f"p_size % 3 > {k}"))]],
    [num("rows", sql="2"), num("cols", sql="p_size"), num("cell_spacing", sql="-3"), num("top", "padding[2]", "2"), num("second_row", "row_sizes[1]", "p_size % 6"), num("border_fill_id", sql="p_size % 7"), num("n_zones", "size(zones)", "p_size % 3"), num("zone_end", "get(zones, 1).end_col", "case when p_size % 3 = 2 then p_size end"), num("zone_fill", "get(zones, 0).fill", "case when p_size % 3 > 0 then p_partkey % 100 end")],
)
record(
    "d40_footnote_shape", "footnote_shape", [("u4", "p_size % 17 + (p_size % 3) * 1024 + (p_size % 2) * 4096"), ("ch", "p_brand"), ("u2", "0"), ("ch", "p_name"), ("u2", "p_size"), *[("i2", f"{k} - p_size") for k in range(4)], ("u1", "p_size % 17"), ("u1", "p_size % 16"), ("u4", "p_partkey")],
    [num("number_shape", sql="p_size % 17"), same("numbering", pick("p_size % 3", ["continue", "restart", "per_page"])), same("superscript", "p_size % 2 = 1"), same("user_symbol", "substr(p_brand, 1, 1)"), same("prefix", "''"), same("suffix", "substr(p_name, 1, 1)"), num("start_number", sql="p_size"), num("below", "divider[2]", "2 - p_size"), num("divider_color", sql="p_partkey")],
)
record("d41_page_border_fill", "page_border_fill", [("u4", "p_size % 8"), *[("i2", f"p_size + {k}") for k in range(4)], ("u2", "p_partkey % 65536")], [same("from_paper", "p_size % 2 = 1"), same("with_header", "(p_size & 2) <> 0"), same("with_footer", "(p_size & 4) <> 0"), num("bottom", "spacing[3]", "p_size + 3"), num("border_fill_id", sql="p_partkey % 65536")])
record(
    "d73_caption", "list_header", [("i2", "1"), ("u2", "0"), ("u4", "0"), ("u4", "p_size % 8"), ("u4", "p_partkey"), ("i2", "-p_size"), ("u4", "p_partkey * 2")],
    [same("align", pick("p_size % 4", ["left", "right", "top", "bottom"]), "caption.align"), same("include_margin", "(p_size & 4) <> 0", "caption.include_margin"), num("width", "caption.width", "p_partkey"), num("gap", "caption.gap", "-p_size"), num("last_width", "caption.last_width", "p_partkey * 2"), same("no_cell", "true", "cell is null")],
)

# ---------------------------------------------------------------- shapes

_ONE = "000000000000F03F"  # 1.0
record(
    "d42_shape_component", "shape_component",
    [("id", "'$pic'"), ("id", "'$pic'", "p_size % 2 = 0"), ("i4", "-p_size"), ("i4", "p_size"), ("u2", "1"), ("u2", "2"), ("u4", "p_partkey"), ("u4", "4"), ("u4", "p_partkey * 2"), ("u4", "6"), ("u4", "0"), ("i2", "90"), ("i4", "-7"), ("i4", "8"), ("u2", "1"), ("hex", _ONE * 18)],
    [same("control_id", "'$pic'"), num("group_x", sql="-p_size"), num("group_y", sql="p_size"), num("initial_width", sql="p_partkey"), num("width", sql="p_partkey * 2"), num("rotation", sql="90"), num("center_x", sql="-7"), num("n", "size(matrices)", "3"), same("scale", "1.0::double", "matrices[2][5]")],
)
record("d43_line", "line", [("i4", "p_size"), ("i4", "-p_size"), ("i4", "p_partkey"), ("i4", "4"), ("u2", "5")], [num("start_x", sql="p_size"), num("start_y", sql="-p_size"), num("end_x", sql="p_partkey"), num("end_y", sql="4"), num("flag", sql="5")])
record("d43_rectangle", "rectangle", [("u1", "p_size"), *[("i4", f"p_partkey * {k}") for k in range(4)], *[("i4", f"-p_size * {k}") for k in range(4)]], [num("corner_curvature", sql="p_size"), num("x_last", "x[3]", "p_partkey * 3"), num("y_last", "y[3]", "-p_size * 3")])
record("d43_ellipse", "ellipse", [("u4", "p_size % 4 + 8"), *[("i4", f"p_partkey + {k}") for k in range(14)]], [same("recalculate", "p_size % 2 = 1"), same("is_arc", "(p_size & 2) <> 0"), num("arc_type", sql="2"), num("center_x", sql="p_partkey"), num("end2_y", sql="p_partkey + 13")])
record("d43_arc", "arc", [("u4", "p_size % 4"), *[("i4", f"p_partkey + {k}") for k in range(6)]], [same("is_arc", "(p_size & 2) <> 0"), num("center_y", sql="p_partkey + 1"), num("axis2_y", sql="p_partkey + 5")])
record("d44_polygon", "polygon", [("i2", "3"), *[("i4", f"p_size * {k}") for k in range(3)], *[("i4", f"-p_partkey + {k}") for k in range(3)]], [num("n", "size(points)", "3"), num("x", "points[2].x", "p_size * 2"), num("y", "points[1].y", "-p_partkey + 1")])
record("d44_curve", "curve", [("i2", "2"), ("i4", "p_size"), ("i4", "2"), ("i4", "3"), ("i4", "p_partkey"), ("u1", "p_size % 2")], [num("x", "points[0].x", "p_size"), num("y", "points[1].y", "p_partkey"), num("segment", "segments[0]", "p_size % 2")])
record(
    "d45_picture", "picture", [("u4", "p_partkey"), ("i4", "p_size"), ("u4", "0"), *[("i4", f"{k}") for k in range(4)], *[("i4", f"{k} + p_size") for k in range(4)], *[("i4", "5")] * 4, *[("i2", "-6")] * 4, ("i1", "-p_size"), ("i1", "p_size"), ("u1", "2"), ("u2", "p_partkey % 65536"), ("u1", "255"), ("u4", "p_partkey * 3"), ("hex", "0102")],
    [num("border_color", sql="p_partkey"), num("border_width", sql="p_size"), num("y_last", "y[3]", "3 + p_size"), num("padding_left", "padding[0]", "-6"), num("brightness", sql="-p_size"), num("contrast", sql="p_size"), num("bindata_id", sql="p_partkey % 65536"), num("opacity", sql="255"), num("instance_id", sql="p_partkey * 3"), num("more", "octet_length(effects)", "2")],
)
record("d46_ole", "ole", [("u2", "p_size % 8 + 256 + 512 * 3"), ("i4", "p_partkey"), ("i4", "-p_size"), ("u2", "p_size"), ("u4", "1"), ("i4", "2"), ("u4", "3")], [num("aspect", sql="p_size % 8"), same("moniker", "true"), num("baseline", sql="3"), num("extent_x", sql="p_partkey"), num("extent_y", sql="-p_size"), num("bindata_id", sql="p_size")])
record("d46_container", "container", [("u2", "2"), ("id", "'$pic'"), ("id", "'$rec'")], [same("first", "'$pic'", "control_ids[0]"), same("second", "'$rec'", "control_ids[1]")])
record("d47_textart", "textart", [("str", "p_name")], [same("head", "upper(lpad(to_hex(length(p_name)), 2, '0'))", "hex(substring(data, 1, 1))")])
record("d48_ctrl_data", "ctrl_data", _BAG, [same("parameters", _BAG_SQL)])
record("d49_equation", "equation", [("u4", "p_size % 2"), ("str", "p_name"), ("u4", "p_size"), ("u4", "p_partkey"), ("i2", "-p_size", "p_size % 3 > 0"), ("str", "p_brand", "p_size % 3 > 0")], [same("script", "p_name"), num("size", sql="p_size"), num("color", sql="p_partkey"), num("baseline", sql="case when p_size % 3 > 0 then -p_size end"), same("version", "case when p_size % 3 > 0 then p_brand end")])
record("d50_video", "video_data", [("i4", "p_size % 2"), ("u2", "p_size", "p_size % 2 = 0"), ("u2", "7", "p_size % 2 = 0"), ("str", "p_name", "p_size % 2 = 1"), ("u2", "8", "p_size % 2 = 1")], [same("kind", "case when p_size % 2 = 0 then 'local' else 'web' end"), num("video_id", sql="case when p_size % 2 = 0 then p_size end"), same("tag", "case when p_size % 2 = 1 then p_name end"), num("thumbnail_id", sql="case when p_size % 2 = 0 then 7 else 8 end")])
record("d52_form_object", "form_object", [("str", "p_brand")], [num("size", "octet_length(data)", "2 + 2 * length(p_brand)")])


@query("d53_other", "select p_partkey, (900 + p_size)::bigint as tag, (2 * length(p_name))::bigint as size from part")
def _(spark, d):
    rows = table(spark, d, "part").withColumn("o", F.lit(0))
    head = le(F.expr("900 + p_size + 2 * length(p_name) * 1048576"), 4)
    streams = rows.select(F.col("p_partkey").cast("string").alias("doc"), F.lit("s").alias("name"), F.concat(head, utf16_units(F.col("p_name"))).alias("data"))
    out = records.others(records.records(streams))
    return out.select(F.col("doc").cast("long").alias("p_partkey"), F.col("tag").cast("long").alias("tag"), F.octet_length("data").cast("long").alias("size"))


@query("d31_control_mask", "select p_partkey, concat_ws(',', " + ", ".join(f"case when (p_partkey * 8191 >> {b}) & 1 = 1 then '{n}' end" for b, n in ((2, "section_column_definition"), (3, "field_start"), (4, "field_end"), (8, "title_mark"), (9, "tab"), (10, "line_break"), (11, "gso_table"), (13, "paragraph_break"), (15, "hidden_comment"), (16, "header_footer"), (17, "footnote_endnote"), (18, "auto_number"), (21, "page_control"), (22, "bookmark"), (23, "additional_text_overlapping_letter"), (24, "hyphen"), (30, "bundle_blank"), (31, "fix_width_blank"))) + ") as flags from part")
def _(spark, d):
    fields = [("u4", "1"), ("u4", "p_partkey * 8191"), ("u2", "0"), ("u1", "0"), ("u1", "0"), ("u2", "0"), ("u2", "0"), ("u2", "0"), ("u4", "0")]
    rows = framed(table(spark, d, "part").withColumn("o", F.lit(0)), F.col("p_partkey"), "o", "para_header", 0, payload(fields))
    from quillspark.functions import bits

    out = records.typed(rows, "para_header")
    return out.select(F.col("doc").cast("long").alias("p_partkey"), F.array_join(bits.control_flags("control_mask"), ",").alias("flags"))


# ---------------------------------------------------------------- controls


def control(name: str, kind: str, ident: str, fields: list[tuple], out: list[tuple[str, str, str]]) -> None:
    record(name, kind, [("id", f"'{ident}'"), *fields], [same("ctrl_id", f"'{ident}'"), *out], control=True)


control("d61_column_definition", "column_definition", "cold", [("u2", "p_size % 4 + (p_size % 3 + 1) * 4 + (p_size % 2) * 4096"), ("i2", "-p_size"), *[("i2", f"p_size + {k}", f"p_size % 2 = 0 and p_size % 3 >= {k}") for k in range(3)], ("u2", "0"), ("u1", "p_size % 17"), ("u1", "2"), ("u4", "p_partkey")],
        [same("column_type", pick("p_size % 4", ["normal", "distributed", "parallel", "normal"])), num("column_count", sql="p_size % 3 + 1"), same("equal_width", "p_size % 2 = 1"), num("column_spacing", sql="-p_size"), num("widths", "size(column_widths)", "case when p_size % 2 = 0 then p_size % 3 + 1 else 0 end"), num("divider_type", sql="p_size % 17"), num("divider_color", sql="p_partkey")])
control("d62_footnote", "footnote_endnote", "fn  ", [("u1", "p_size"), ("hex", "0000000000"), ("u1", "p_size % 4"), ("u1", "9")], [num("number", sql="p_size"), num("attribute", sql="p_size % 4")])
control("d63_header_footer", "header_footer", "head", [("u4", "p_size % 4"), ("u4", "p_partkey", "p_size % 2 = 0"), ("u4", "8", "p_size % 2 = 0")], [same("apply_page", pick("p_size % 4", ["both", "even_only", "odd_only", "both"])), num("text_width", sql="case when p_size % 2 = 0 then p_partkey end")])
control("d64_page_number_position", "page_number_position", "pgnp", [("u4", "p_size % 17 + p_size % 12 * 256"), ("ch", "p_brand"), ("ch", "p_name"), ("u2", "0"), ("u2", "0")],
        [num("shape", sql="p_size % 17"), same("position", pick("p_size % 12", ["none", "top_left", "top_center", "top_right", "bottom_left", "bottom_center", "bottom_right", "outside_top", "outside_bottom", "inside_top", "inside_bottom", "none"])), same("user_symbol", "substr(p_brand, 1, 1)"), same("prefix", "substr(p_name, 1, 1)"), same("suffix", "''")])
control("d65_field", "field", "%%%%", [("u4", "1"), ("u4", "p_partkey"), ("u1", "p_size"), ("str", "p_name"), ("u4", "p_partkey * 2")], [num("attribute", sql="p_partkey"), num("other_attribute", sql="p_size"), same("command", "p_name"), num("id", sql="p_partkey * 2")])
control("d66_section_definition", "section_definition", "secd", [("u4", "p_partkey"), *[("u2", f"p_size + {k}") for k in range(3)], ("u4", "p_partkey * 2"), *[("u2", f"p_size * {k}") for k in range(1, 6)], ("u2", "7", "p_size % 2 = 0")],
        [num("column_spacing", sql="p_size"), num("horizontal_alignment", sql="p_size + 2"), num("tip_spacing", sql="p_partkey * 2"), num("page_number", sql="p_size * 2"), num("equation_number", sql="p_size * 5"), num("language", sql="case when p_size % 2 = 0 then 7 end")])
control("d67_auto_number", "auto_number", "atno", [("u4", "p_size % 6 + p_size % 17 * 16"), ("u2", "p_partkey % 65536"), ("ch", "p_brand"), ("u2", "0"), ("ch", "p_name")], [num("kind", sql="p_size % 6"), num("shape", sql="p_size % 17"), num("number", sql="p_partkey % 65536"), same("suffix", "substr(p_name, 1, 1)")])
control("d67_new_number", "new_number", "newn", [("u4", "p_size % 6"), ("u2", "p_size"), ("u2", "0")], [num("kind", sql="p_size % 6"), num("number", sql="p_size")])
control("d68_hide", "hide", "pghd", [("u2", "p_size")], [num("attributes", sql="p_size")])
control("d68_page_adjust", "page_adjust", "pgad", [("u4", "p_partkey")], [num("attributes", sql="p_partkey")])
control("d69_bookmark", "bookmark_marker", "bkmk", [("str", "p_name"), ("str", "p_brand", "p_size % 2 = 0"), ("hex", "0000")], [same("keyword1", "p_name"), same("keyword2", "case when p_size % 2 = 0 then p_brand else '' end")])
control("d70_overlap", "overlap", "over", [("u4", "0"), ("str", "p_name"), ("u1", "p_size"), ("i1", "-p_size"), ("u1", "3")], [same("text", "p_name"), num("border_type", sql="p_size"), num("text_size", sql="-p_size"), num("spread", sql="3")])
control("d71_comment", "comment", "cmtt", [("str", "p_name"), ("str", "p_brand"), *[("u4", f"p_partkey + {k}") for k in range(5)]], [same("main_text", "p_name"), same("sub_text", "p_brand"), num("position", sql="p_partkey"), num("alignment", sql="p_partkey + 4")])
control("d72_hidden_description", "hidden_description", "hide", [("u4", "0")], [same("read", "true", "error is null")])
