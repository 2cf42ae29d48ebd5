"""Record streams: framing, the tree of levels, and typed tables of each kind of record."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions.text import SINGLE
from quillspark.plans import sequence
from quillspark.sources.batches import bounded
from quillspark.sources.layouts import BODY_TAGS, CONTROL_LAYOUTS, CONTROLS, DOC_LEVELS, DOC_TAGS, FIRST, LAYOUTS, Layout, RecordError, read, utf16

FRAMED = "doc string, stream string, seq long, tag int, level int, parent long, size long, payload binary, error string"


def frame(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of each record; RecordError where one is cut off."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise RecordError("record header is cut off")
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                raise RecordError("record size is cut off")
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            raise RecordError(f"record needs {size} bytes, {len(data) - at} are left")
        yield head & 0x3FF, (head >> 10) & 0x3FF, data[at : at + size]
        at += size


def records(streams: DataFrame) -> DataFrame:
    """streams: ``doc``, ``name``, ``data`` (inflated), and ``error`` if they have one. One row a record in stream order, with
    ``parent``: the ``seq`` of the nearest record before it with a smaller level, null at the top. A stream that is cut off gives its
    whole records and one row with an error, one that has an error that row alone. Null data gives nothing."""
    schema = to_arrow_schema(T.StructType.fromDDL(FRAMED))

    def rows_of(doc: str, name: str, data: bytes | None, error: str | None) -> Iterator[tuple]:
        above: list[tuple[int, int]] = []  # (level, seq) of the records that are still open
        seq = 0
        try:
            if error is not None:
                raise RecordError(error)
            for seq, (tag, level, payload) in enumerate(frame(data or b""), 1):
                while above and above[-1][0] >= level:
                    above.pop()
                yield doc, name, seq - 1, tag, level, above[-1][1] if above else None, len(payload), payload, None
                above.append((level, seq - 1))
        except RecordError as e:
            yield doc, name, seq, None, None, None, None, None, str(e)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for stream in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows = rows_of(*stream)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    bounded(streams.sparkSession)
    error = "error" if "error" in streams.columns else F.lit(None).cast("string").alias("error")
    return streams.select("doc", "name", "data", error).mapInArrow(run, FRAMED)


def tree(framed: DataFrame) -> DataFrame:
    """The records that were read, without rows of errors; ``parent`` makes them a tree, whatever their levels."""
    return framed.where("error is null")


# ---------------------------------------------------------------- records whose layout depends on their content


def _face_name(data: bytes) -> dict:
    if len(data) < 3:
        raise RecordError("face name is cut off")
    flags, at = data[0], 1
    out: dict = {}
    out["name"], at, ok = read(data, at, "str")
    if not ok:
        raise RecordError("font name is cut off")
    if flags & 0x80 and at < len(data):
        out["alternative_type"] = data[at]
        out["alternative_name"], at, _ = read(data, at + 1, "str")
    if flags & 0x40 and at + 10 <= len(data):
        out["type_info"] = list(data[at : at + 10])
        at += 10
    if flags & 0x20:
        out["default_name"], at, _ = read(data, at, "str")
    return out


def _bin_data(data: bytes) -> dict:
    if len(data) < 2:
        raise RecordError("2 bytes needed")
    attributes = struct.unpack_from("<H", data)[0]
    kind = {0: "link", 1: "embedding", 2: "storage"}.get(attributes & 15, "link")
    out = {"kind": kind, "compression": ["default", "compress", "none"][min(2, attributes >> 4 & 3)], "access": ["never", "success", "error", "ignored"][attributes >> 8 & 3]}
    at = 2
    if kind == "link":
        out["absolute_path"], at, _ = read(data, at, "str")
        out["relative_path"], at, _ = read(data, at, "str")
        return out
    if at + 2 <= len(data):
        out["binary_id"] = struct.unpack_from("<H", data, at)[0]
        if kind == "embedding":
            out["extension"], at, _ = read(data, at + 2, "str")
    return out


def fill(data: bytes) -> dict:
    """A fill: none, solid, image or gradient, in this order of the type's bits 0, 1, 2."""
    if len(data) < 4:
        return {"fill": "none"}
    kind, at = struct.unpack_from("<I", data)[0], 4
    if kind & 1:
        if len(data) < at + 12:
            raise RecordError("solid fill is cut off")
        a, b, c = struct.unpack_from("<IIi", data, at)
        return {"fill": "solid", "background_color": a, "pattern_color": b, "pattern_type": c}
    if kind & 2:
        if len(data) < at + 6:
            raise RecordError("image fill is cut off")
        return {"fill": "image", "image_type": data[at], "image_id": struct.unpack_from("<H", data, at + 4)[0]}
    if kind & 4:
        if len(data) < at + 12:
            raise RecordError("gradient is cut off")
        style, angle, x, y, spread, n = struct.unpack_from("<6h", data, at)
        at += 12
        places = None
        if n > 2:
            if len(data) < at + 4 * n:
                raise RecordError("gradient places are cut off")
            places = list(struct.unpack_from(f"<{n}i", data, at))
            at += 4 * n
        if len(data) < at + 4 * max(0, n):
            raise RecordError("gradient colours are cut off")
        return {"fill": "gradient", "gradient_type": style, "angle": angle, "center_x": x, "center_y": y, "spread": spread, "positions": places, "gradient_colors": list(struct.unpack_from(f"<{max(0, n)}I", data, at))}
    return {"fill": "none"}


def _borders(data: bytes, split: bool) -> tuple[dict, int]:
    """Four borders and the diagonal, either as a type, a width and a colour each, or all types, all widths, all colours."""
    if split:
        types, widths = list(data[2:6]), list(data[6:10])
        colors = list(struct.unpack_from("<4I", data, 10))
    else:
        parts = [struct.unpack_from("<BBI", data, 2 + 6 * k) for k in range(4)]
        types, widths, colors = ([p[j] for p in parts] for j in range(3))
    kind, width, color = struct.unpack_from("<BBI", data, 26)
    # a width has 16 codes, a type 33 at most; every colour is possible, but all bits set is unlikely
    score = sum(3 if w < 16 else -10 for w in widths) + sum(2 if t < 33 else -5 for t in types) - sum(2 for c in colors if c == 0xFFFFFFFF)
    return {"line_types": types, "widths": widths, "colors": colors, "diagonal_type": kind, "diagonal_width": width, "diagonal_color": color}, score


def _border_fill(data: bytes) -> dict:
    if len(data) < 32:
        raise RecordError("32 bytes needed")
    attributes = struct.unpack_from("<H", data)[0]
    (a, score), (b, other) = _borders(data, False), _borders(data, True)
    out = {"effect_3d": bool(attributes & 1), "shadow": bool(attributes & 2), "diagonal_slash": attributes >> 2 & 7, "diagonal_backslash": attributes >> 5 & 7, "slash_broken": attributes >> 8 & 3, "backslash_broken": bool(attributes >> 10 & 1), "slash_rotated": bool(attributes >> 11 & 1), "backslash_rotated": bool(attributes >> 12 & 1), "center_line": bool(attributes >> 13 & 1)}
    return out | (a if score >= other else b) | fill(data[32:])


def _tab_def(data: bytes) -> dict:
    if len(data) < 6:
        raise RecordError("6 bytes needed")
    attributes, n = struct.unpack_from("<Ih", data)
    if len(data) < 6 + 8 * n:
        raise RecordError(f"{n} items need {6 + 8 * n} bytes, {len(data)} are there")
    parts = [struct.unpack_from("<IBB", data, 6 + 8 * k) for k in range(max(0, n))]
    items = [{"position": at, "kind": ["left", "right", "center", "decimal"][kind] if kind < 4 else "left", "leader": leader} for at, kind, leader in parts]
    return {"left_auto": bool(attributes & 1), "right_auto": bool(attributes & 2), "items": items}


def _compatible(data: bytes) -> dict:
    if len(data) < 4:
        raise RecordError("4 bytes needed")
    program = struct.unpack_from("<I", data)[0]
    if program > 2:
        raise RecordError(f"unknown program {program}")
    return {"program": program, "target": ["current", "2007", "ms_word"][program]}


def _text_or_none(data: bytes, at: int) -> tuple[str, int]:
    """Text after its length; the empty one, behind the length, where its units are cut off."""
    text, after, whole = read(data, at, "str")
    if whole and text is None:
        raise RecordError("number format is no UTF-16")
    return (text, after) if whole else ("", min(len(data), at + 2))


def _numbering(data: bytes, version: int = 0x05000000) -> dict:
    """Seven levels, as far as there are bytes, then up to three more formats. Levels have a start of their own from 0.2.5.0 on."""
    levels, at = [], 0
    while len(levels) < 7 and at + 12 <= len(data):
        attributes, width, distance, shape = struct.unpack_from("<IhhI", data, at)
        text, at = _text_or_none(data, at + 12)
        start, first = 0, None
        if at + 2 <= len(data):
            start, at = struct.unpack_from("<H", data, at)[0], at + 2
        if version >= 0x00020500 and at + 4 <= len(data):
            first, at = struct.unpack_from("<I", data, at)[0], at + 4
        levels.append({"level": len(levels) + 1, "attributes": attributes, "width": width, "distance": distance, "char_shape_id": shape, "format": text, "start": start, "level_start": first})
    extended = []
    while len(extended) < 3:
        text, at, whole = read(data, at, "str")
        if not whole:
            break
        if text is None:
            raise RecordError("number format is no UTF-16")
        extended.append(text)
    return {"levels": levels, "extended": extended}


# Types of the items of a parameter set, and how each is stored.
_PARAMETERS = {0: "null", 1: "bstr", 2: "i1", 3: "i2", 4: "i4", 5: "i", 6: "ui1", 7: "ui2", 8: "ui4", 9: "ui", 0x8000: "set", 0x8001: "array", 0x8002: "bindata"}


def parameter_set(data: bytes, at: int = 0, depth: int = 0) -> tuple[dict, int]:
    """A bag of numbered items, which may hold bags; an item of unknown type takes four bytes."""
    if depth > 32 or at + 4 > len(data):
        raise RecordError("parameter set is cut off or too deep")
    ident, n = struct.unpack_from("<Hh", data, at)
    at += 4
    items = []
    for _ in range(max(0, n)):
        if at + 4 > len(data):
            break
        item, kind = struct.unpack_from("<HH", data, at)
        value, at = _parameter(data, at + 4, _PARAMETERS.get(kind, "unknown"), depth)
        items.append({"id": item, "type": _PARAMETERS.get(kind, "unknown"), "value": value})
    return {"id": ident, "items": items}, at


def _parameter(data: bytes, at: int, kind: str, depth: int):
    if kind == "bstr":
        value, after, ok = read(data, at, "str")
        if not ok:
            raise RecordError("parameter text is cut off")
        return value, after
    if kind == "set":
        return parameter_set(data, at, depth + 1)
    if kind == "array":
        if at + 4 > len(data):
            raise RecordError("parameter array is cut off")
        n, of = struct.unpack_from("<hH", data, at)
        out, at = [], at + 4
        for _ in range(max(0, n)):
            value, at = _parameter(data, at, _PARAMETERS.get(of, "unknown"), depth + 1)
            out.append(value)
        return out, at
    if at + 4 > len(data):
        raise RecordError("parameter is cut off")
    code = {"i1": "b", "i2": "h", "i4": "i", "i": "i", "ui1": "B", "ui2": "H", "ui4": "I", "ui": "I", "bindata": "H"}.get(kind)
    return (struct.unpack_from(f"<{code}", data, at)[0] if code else None), at + 4


def _bag(data: bytes) -> dict:
    import json

    return {"parameters": json.dumps(parameter_set(data)[0], ensure_ascii=False, separators=(",", ":"), sort_keys=True)}


def text_runs(data: bytes) -> list[dict]:
    """Paragraph text as runs of text and control characters. Positions count UTF-16 units; controls of eight units carry
    the same code at their end. Text that is no UTF-16 is left out."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, at, begin = [], 0, 0

    def close(end: int) -> None:
        if end > begin:
            text = utf16(data[2 * begin : 2 * end])
            if text is not None:
                out.append({"kind": "text", "position": begin, "text": text})

    while at < len(units):
        code = units[at]
        if code > 31:
            at += 1
            continue
        close(at)
        size = 1 if code in SINGLE else 8
        run = {"kind": "control", "position": at, "code": code, "size": size}
        rest = data[2 * at + 2 : 2 * at + 14]
        if size == 8 and len(rest) == 12:
            if code == 9:
                run["width"] = struct.unpack_from("<I", rest)[0]
            elif all(b == 0 or 32 <= b <= 126 for b in rest[:4]) and rest[:4].strip(b"\0"):
                run["chid"] = rest[:4].rstrip(b"\0").decode()
        out.append(run)
        at += size
        begin = at
    close(len(units))
    return out


def _several(size: int, code: str, names: tuple[str, ...], as_name: str) -> Callable[[bytes], dict]:
    def run(data: bytes) -> dict:
        if len(data) % size:
            raise RecordError(f"{len(data)} bytes are no multiple of {size}")
        return {as_name: [dict(zip(names, x, strict=True)) for x in struct.iter_unpack(code, data)]}

    return run


def _range_tags(data: bytes) -> dict:
    out = _several(12, "<III", ("start", "end", "tag"), "tags")(data)
    return {"tags": [{"start": t["start"], "end": t["end"], "tag_type": t["tag"] >> 24, "tag_data": t["tag"] & 0xFFFFFF} for t in out["tags"]]}


def _list_header(data: bytes) -> dict:
    if len(data) < 6:
        raise RecordError("6 bytes needed")
    n = struct.unpack_from("<h", data)[0]
    value = struct.unpack_from("<I", data, 4 if len(data) >= 8 else 2)[0]
    out = {"paragraph_count": n, "text_direction": "vertical" if value & 7 == 1 else "horizontal", "line_break": ["normal", "keep_one_line", "expand", "normal"][value >> 3 & 3], "vertical_align": ["top", "center", "bottom", "top"][value >> 5 & 3]}
    if len(data) >= 34:
        names = ("col", "row", "col_span", "row_span", "width", "height", "margin_left", "margin_right", "margin_top", "margin_bottom", "border_fill_id")
        out["cell"] = dict(zip(names, struct.unpack_from("<4H2I4hH", data, 8), strict=True))
    elif len(data) >= 22:
        attributes, width, gap, last = struct.unpack_from("<IIhI", data, 8)
        out["caption"] = {"align": ["left", "right", "top", "bottom"][attributes & 3], "include_margin": bool(attributes & 4), "width": width, "gap": gap, "last_width": last}
    return out


def _table(data: bytes) -> dict:
    if len(data) < 22:
        raise RecordError("22 bytes needed")
    attributes, rows, cols, spacing, left, right, top, bottom = struct.unpack_from("<IHHh4h", data)
    at = 18 + 2 * rows
    if at + 2 > len(data):
        raise RecordError("row sizes are cut off")
    out = {"attributes": attributes, "rows": rows, "cols": cols, "cell_spacing": spacing, "padding": [left, right, top, bottom], "row_sizes": list(struct.unpack_from(f"<{rows}H", data, 18)), "border_fill_id": struct.unpack_from("<H", data, at)[0], "zones": []}
    at += 2
    if at + 2 <= len(data):
        n = struct.unpack_from("<H", data, at)[0]
        at += 2
        names = ("start_col", "start_row", "end_col", "end_row", "fill")
        out["zones"] = [dict(zip(names, struct.unpack_from("<5H", data, at + 10 * k), strict=True)) for k in range(n) if at + 10 * k + 10 <= len(data)]
    return out


def _shape_component(data: bytes) -> dict:
    names = ("group_x", "group_y", "group_count", "local_version", "initial_width", "initial_height", "width", "height", "flip", "rotation", "center_x", "center_y")
    if len(data) < 50:
        raise RecordError("50 bytes needed")
    for at in (8, 4):  # the control identifier stands once or twice
        if data[:4] == data[4:8] or at == 4:
            break
    if len(data) < at + 44:
        raise RecordError("shape is cut off")
    out = {"control_id": data[:4][::-1].decode("latin-1")} | dict(zip(names, struct.unpack_from("<iiHHIIIIIhii", data, at), strict=True))
    at += 42
    n = struct.unpack_from("<H", data, at)[0]
    at += 2
    matrices = []
    while len(matrices) < 1 + 2 * n and at + 48 <= len(data):
        matrices.append(list(struct.unpack_from("<6d", data, at)))
        at += 48
    return out | {"matrices": matrices}


def _points(curve: bool) -> Callable[[bytes], dict]:
    def run(data: bytes) -> dict:
        if len(data) < 2:
            raise RecordError("2 bytes needed")
        n = max(0, struct.unpack_from("<h", data)[0])
        if len(data) < 2 + 8 * n:
            raise RecordError("points are cut off")
        x, y = list(struct.unpack_from(f"<{n}i", data, 2)), list(struct.unpack_from(f"<{n}i", data, 2 + 4 * n))
        out: dict = {"points": [{"x": a, "y": b} for a, b in zip(x, y, strict=True)]}
        if curve:
            out["segments"] = list(data[2 + 8 * n : 2 + 8 * n + max(0, n - 1)])
        return out

    return run


def _container(data: bytes) -> dict:
    if len(data) < 2:
        raise RecordError("2 bytes needed")
    n = struct.unpack_from("<H", data)[0]
    if len(data) < 2 + 4 * n:
        raise RecordError("identifiers are cut off")
    return {"control_ids": [data[2 + 4 * k : 6 + 4 * k][::-1].decode("latin-1") for k in range(n)]}


def _video(data: bytes) -> dict:
    if len(data) < 4:
        raise RecordError("4 bytes needed")
    kind = struct.unpack_from("<i", data)[0]
    if kind == 0 and len(data) >= 8:
        a, b = struct.unpack_from("<HH", data, 4)
        return {"kind": "local", "video_id": a, "thumbnail_id": b}
    text, at, _ = read(data, 4, "str")
    thumbnail = struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else None
    return {"kind": "web", "tag": text, "thumbnail_id": thumbnail}


def _column_definition(data: bytes) -> dict:
    if len(data) < 12:
        raise RecordError("12 bytes needed")
    low, spacing = struct.unpack_from("<Hh", data)
    n = low >> 2 & 255 or 1
    equal = bool(low & 0x1000)
    out = {"column_type": ["normal", "distributed", "parallel", "normal"][low & 3], "column_count": n, "direction": ["left", "right", "both", "left"][low >> 10 & 3], "equal_width": equal, "column_spacing": spacing, "column_widths": []}
    at = 4
    if not equal:
        while len(out["column_widths"]) < n and at + 2 <= len(data):
            out["column_widths"].append(struct.unpack_from("<h", data, at)[0])
            at += 2
    at += 2
    if at + 6 <= len(data):
        out["divider_type"], out["divider_thickness"], out["divider_color"] = struct.unpack_from("<BBI", data, at)
    return out


SPECIAL: dict[str, tuple[str, Callable[[bytes], dict]]] = {
    "face_name": ("name string, alternative_type int, alternative_name string, type_info array<int>, default_name string", _face_name),
    "bin_data": ("kind string, compression string, access string, absolute_path string, relative_path string, binary_id int, extension string", _bin_data),
    "border_fill": (
        "effect_3d boolean, shadow boolean, diagonal_slash int, diagonal_backslash int, slash_broken int, backslash_broken boolean, slash_rotated boolean, backslash_rotated boolean, center_line boolean, line_types array<int>, widths array<int>, colors array<long>, diagonal_type int, diagonal_width int, diagonal_color long, fill string, "
        "background_color long, pattern_color long, pattern_type int, image_type int, image_id int, gradient_type int, angle int, center_x int, center_y int, spread int, positions array<int>, gradient_colors array<long>",
        _border_fill,
    ),
    "tab_def": ("left_auto boolean, right_auto boolean, items array<struct<position:long,kind:string,leader:int>>", _tab_def),
    "compatible_document": ("program long, target string", _compatible),
    "numbering": ("levels array<struct<level:int,attributes:long,width:int,distance:int,char_shape_id:long,format:string,start:int,level_start:long>>, extended array<string>", _numbering),
    "doc_data": ("parameters string", _bag),
    "ctrl_data": ("parameters string", _bag),
    "para_text": ("runs array<struct<kind:string,position:int,text:string,code:int,size:int,width:long,chid:string>>", lambda data: {"runs": text_runs(data)}),
    "para_char_shape": ("shapes array<struct<position:long,shape_id:long>>", _several(8, "<II", ("position", "shape_id"), "shapes")),
    "para_line_seg": (
        "segments array<struct<text_start:long,vertical:int,line_height:int,text_height:int,baseline:int,spacing:int,column_start:int,width:int,tag:long>>",
        _several(36, "<IiiiiiiiI", ("text_start", "vertical", "line_height", "text_height", "baseline", "spacing", "column_start", "width", "tag"), "segments"),
    ),
    "para_range_tag": ("tags array<struct<start:long,end:long,tag_type:int,tag_data:int>>", _range_tags),
    "list_header": (
        "paragraph_count int, text_direction string, line_break string, vertical_align string, cell struct<col:int,row:int,col_span:int,row_span:int,width:long,height:long,margin_left:int,margin_right:int,margin_top:int,margin_bottom:int,border_fill_id:int>, "
        "caption struct<align:string,include_margin:boolean,width:long,gap:int,last_width:long>",
        _list_header,
    ),
    "table": ("attributes long, rows int, cols int, cell_spacing int, padding array<int>, row_sizes array<int>, border_fill_id int, zones array<struct<start_col:int,start_row:int,end_col:int,end_row:int,fill:int>>", _table),
    "shape_component": ("control_id string, group_x int, group_y int, group_count int, local_version int, initial_width long, initial_height long, width long, height long, flip long, rotation int, center_x int, center_y int, matrices array<array<double>>", _shape_component),
    "polygon": ("points array<struct<x:int,y:int>>", _points(False)),
    "curve": ("points array<struct<x:int,y:int>>, segments array<int>", _points(True)),
    "container": ("control_ids array<string>", _container),
    "video_data": ("kind string, video_id int, tag string, thumbnail_id int", _video),
    "column_definition": ("column_type string, column_count int, direction string, equal_width boolean, column_spacing int, column_widths array<int>, divider_type int, divider_thickness int, divider_color long", _column_definition),
}


def decoder(kind: str, layouts: dict[str, Layout] = LAYOUTS) -> tuple[str, Callable[[bytes], dict]]:
    """(columns as DDL, function from bytes to a row) of a kind of record."""
    if kind in SPECIAL:
        return SPECIAL[kind]
    layout = layouts[kind]
    return layout.ddl(), layout.decode


def _decoded(rows: DataFrame, ddl: str, decode: Callable[..., dict], skip: int = 0, versioned: bool = False, layout: Layout | None = None) -> DataFrame:
    """Keys of rows and the columns of their payloads; with ``versioned`` decode gets the column ``version`` too, if there is one. Batches
    of whole records of a layout of fixed size are decoded at once."""
    keys = [c for c in rows.columns if c not in ("payload", "size", "error", "tag", "level", "parent", "version")]
    columns = f"{ddl}, error string" if ddl else "error string"
    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            whole = layout.decode_all(batch.column(len(keys)), skip) if layout is not None else None
            if whole is not None:
                made = [whole[f.name].cast(f.type) if f.name in whole else pa.nulls(batch.num_rows, f.type) for f in list(arrow)[len(keys) :]]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], schema=arrow)
                continue
            out = []
            for payload, version in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                try:
                    out.append(decode(payload[skip:]) if version is None else decode(payload[skip:], version))
                except (RecordError, struct.error) as e:
                    out.append({"error": str(e)})
            made = [pa.array([r.get(f.name) for r in out], f.type) for f in arrow][len(keys) :]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], schema=arrow)

    bounded(rows.sparkSession)
    version = F.col("version").cast("long") if versioned and "version" in rows.columns else F.lit(None).cast("long")
    return rows.select(*keys, "payload", version.alias("_version")).mapInArrow(run, schema)


def typed(framed: DataFrame, kind: str, versions: DataFrame | None = None) -> DataFrame:
    """Rows of one kind of record: keys, its columns, ``error`` where it is too short or broken. Records of document-wide tables
    count only at the level where they belong. versions: doc, ``version``, for kinds whose layout depends on it (numbering)."""
    number = FIRST + (DOC_TAGS | BODY_TAGS)[kind]
    ddl, decode = decoder(kind)
    rows = framed.where((F.col("tag") == number) & F.col("error").isNull())
    if kind in DOC_LEVELS:
        rows = rows.where(F.col("level") == DOC_LEVELS[kind])
    if versions is not None:
        rows = rows.join(versions.select("doc", "version"), "doc", "left")
    return _decoded(rows, ddl, decode, versioned=kind == "numbering", layout=None if kind in SPECIAL else LAYOUTS[kind])


def controls(framed: DataFrame, kind: str) -> DataFrame:
    """Control headers of one layout: keys, ``ctrl_id``, its columns, ``error``. Identifiers without a layout are ``other``."""
    number = FIRST + BODY_TAGS["ctrl_header"]
    rows = framed.where((F.col("tag") == number) & F.col("error").isNull())
    rows = rows.withColumn("ctrl_id", F.reverse(F.decode(F.substring("payload", 1, 4), "ISO-8859-1")))
    names = [k for k, v in CONTROLS.items() if v == kind]
    rows = rows.where(~F.col("ctrl_id").isin(list(CONTROLS))) if kind == "other" else rows.where(F.col("ctrl_id").isin(names))
    ddl, decode = decoder(kind, CONTROL_LAYOUTS)
    return _decoded(rows, ddl, decode, skip=4, layout=None if kind in SPECIAL else CONTROL_LAYOUTS[kind])


def others(framed: DataFrame) -> DataFrame:
    """Records of no known kind: keys, ``tag``, ``data``."""
    known = sorted({FIRST + n for n in (DOC_TAGS | BODY_TAGS).values()})
    return framed.where(F.col("error").isNull() & ~F.col("tag").isin(known)).select("doc", "stream", "seq", "tag", "level", F.col("payload").alias("data"))


def dictionary(framed: DataFrame, kind: str) -> DataFrame:
    """typed() of a document-wide table with ``idx``, its place from 0 in each document."""
    return sequence.numbered(typed(framed, kind), "doc", "seq", "idx", start=0)


def file_headers(streams: DataFrame) -> DataFrame:
    """doc, the columns of the file header, ``error`` where it is short or has another signature."""
    ddl, decode = decoder("file_header")

    def checked(data: bytes) -> dict:
        if data[:17] != SIGNATURE:
            raise RecordError("unknown signature")
        return decode(data)

    rows = streams.where("name = 'FileHeader' and data is not null").select("doc", F.col("data").alias("payload"))
    return _decoded(rows, ddl, checked)


# Fixed value: the signature at the start of the header stream.
SIGNATURE = b"HWP Document File"


def area_counts(info: DataFrame) -> DataFrame:
    """info: records of the DocInfo streams. doc, ``area_count``: how many sections a document says that it has."""
    return typed(info, "document_properties").where("error is null").groupBy("doc").agg(F.max("area_count").alias("area_count"))


def sections(streams: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Inflated body streams with ``section``; where two paths name one section, that without the root counts. areas: area_counts();
    of a document only sections below its count are there (one where the count is unknown)."""
    from quillspark.sources.compound import inflated, nested

    found = nested(streams, "BodyText", "Section[0-9]+").withColumn("section", F.regexp_extract("name", "([0-9]+)$", 1).cast("int"))
    if areas is not None:
        found = found.join(areas, "doc", "left").where(F.col("section") < F.coalesce("area_count", F.lit(1))).drop("area_count")
    return inflated(found)
