"""Whole compound documents as Markdown parts: body, headers, footers, notes, with tables, images and outline numbers.

A document is one row of files, and what it shows depends on its own records alone, so each is put together where it is read: one
Arrow pass, no shuffle, one document in memory at a time. The shell around the parts is render.markdown.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions import numbers
from quillspark.operators import render
from quillspark.sources import compound, records
from quillspark.sources.batches import bounded
from quillspark.sources.layouts import CONTROL_LAYOUTS, DOC_LEVELS, DOC_TAGS, FIRST, LAYOUTS, RecordError, utf16

PARA, TEXT, SHAPES, SEGMENTS, CONTROL, LIST, PAGE, FOOTNOTE_SHAPE, COMPONENT, TABLE, PICTURE = 66, 67, 68, 69, 71, 72, 73, 74, 76, 77, 85
_BREAKS, _SHOWN = (10, 13), {9: "\t", 24: "-", 30: " ", 31: " "}
_NOTES = ("head", "foot", "fn  ", "en  ")
#: Bits of a paragraph's mask that say that it carries headers and footers, or notes.
_CARRIES = 1 << 16 | 1 << 17
PARTS = "doc string, version long, part string, ord int, line string, error string"


@dataclass
class Node:
    tag: int
    level: int
    data: bytes
    children: list[Node] = field(default_factory=list)

    def of(self, tag: int) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def ident(self) -> str:
        return self.data[:4][::-1].decode("latin-1")


def tree(stream: bytes) -> Node:
    """The records of a stream below a root."""
    root = Node(0, -1, b"")
    above = [root]
    for tag, level, payload in records.frame(stream):
        while above[-1].level >= level:
            above.pop()
        node = Node(tag, level, payload)
        above[-1].children.append(node)
        above.append(node)
    return root


def listed(parent: Node, at: int) -> list[Node]:
    """Paragraphs of the list that the child at a place opens: those below it, else those that follow it, as many as it says."""
    opener = parent.children[at]
    below, todo = [], list(opener.children)
    while todo:
        node = todo.pop(0)
        if node.tag == PARA:
            below.append(node)
        else:
            todo += node.children
    count = struct.unpack_from("<h", opener.data)[0] if len(opener.data) >= 2 else 0
    if len(below) >= count:
        return below
    out = []
    for node in parent.children[at + 1 :]:
        if node.tag == LIST or len(out) == count:
            break
        if node.tag == PARA:
            out.append(node)
    return out


class Document:
    """The tables of one document, and its numbering as far as it has come."""

    def __init__(self, found: dict[str, bytes], folder: str | None):
        header = found.get("FileHeader", b"")
        if header[:17] != records.SIGNATURE or len(header) < 40:
            raise RecordError("unknown signature")
        self.version = struct.unpack_from("<I", header, 32)[0]
        self.packed, self.folder, self.found = compound.is_compressed(header), folder, found
        self.dictionaries: dict[str, list[dict]] = {k: [] for k in ("document_properties", "face_name", "char_shape", "para_shape", "style", "numbering", "bin_data")}
        by_tag = {FIRST + DOC_TAGS[k]: k for k in self.dictionaries}
        for tag, level, payload in records.frame(self.open("DocInfo")):
            kind = by_tag.get(tag)
            if kind and level == DOC_LEVELS[kind]:
                decode = records.decoder(kind)[1]
                self.dictionaries[kind].append(decode(payload, self.version) if kind == "numbering" else decode(payload))
        self.counters = [0] * 7

    def open(self, name: str) -> bytes:
        raw = self.found.get(name, self.found.get(f"Root Entry/{name}", b""))
        return compound.inflate(raw) if self.packed and raw else raw

    def sections(self) -> Iterator[Node]:
        known = self.dictionaries["document_properties"]
        for k in range(known[0]["area_count"] if known else 1):
            if f"BodyText/Section{k}" in self.found or f"Root Entry/BodyText/Section{k}" in self.found:
                yield tree(self.open(f"BodyText/Section{k}"))

    def entry(self, kind: str, at: int) -> dict | None:
        rows = self.dictionaries[kind]
        return rows[at] if 0 <= at < len(rows) else None

    def image(self, ident: int) -> str | None:
        """Markdown of a binary item: the name of its file, or, without a folder, its bytes."""
        item = next((r for r in self.dictionaries["bin_data"] if r["kind"] != "link" and r.get("binary_id") == ident), None)
        if item is None:
            return None
        bare, ending = f"BIN{ident:04X}", item.get("extension")
        names = [f"BinData/{bare}", f"Root Entry/BinData/{bare}", bare] + ([f"BinData/{bare}.{ending}", f"Root Entry/BinData/{bare}.{ending}"] if ending is not None else [])
        data = next((self.found[n] for n in names if self.found.get(n)), None)
        if data is None:
            return None
        if self.folder is not None:
            return f"![이미지]({self.folder}/{bare}.{ending or 'jpg'})"
        try:
            data = compound.inflate(data)
        except compound.CompoundError:
            pass  # some items are stored bare
        text = base64.b64encode(data).decode()
        kinds = {"iVBORw": "image/png", "/9j/": "image/jpeg", "Qk": "image/bmp"}
        mime = next((m for k, m in kinds.items() if text.startswith(k)), "image/jpeg")
        return f"![이미지](data:{mime};base64,{text})"

    def pictures(self, nodes: list[Node]) -> list[int]:
        return [r["bindata_id"] for r in (LAYOUTS["picture"].decode(n.data) for n in nodes if n.tag == PICTURE)]

    # ------------------------------------------------------------ text

    def text(self, node: Node) -> tuple[str, list[int]]:
        """(text without controls, but for those that have a character of their own; positions of breaks)."""
        shown, breaks = [], []
        for run in records.text_runs(node.data):
            if run["kind"] == "text":
                shown.append(run["text"])
            else:
                shown.append(_SHOWN.get(run["code"], ""))
                if run["code"] in _BREAKS:
                    breaks.append(run["position"])
        return "".join(shown), breaks

    def styled(self, text: str, breaks: list[int], shapes: list[tuple[int, int]]) -> str:
        """Text with marks of its styles and line breaks at breaks inside a style's run; blank text gives nothing."""
        if not text.strip():
            return ""
        if not shapes:
            return _plain(text, breaks)
        cuts = sorted({0, len(text), *(p for p, _ in shapes if p <= len(text))})
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            held = [s for p, s in shapes if p == low][:1] or [s for p, s in shapes if p < low][-1:]
            shape = self.entry("char_shape", held[0]) if held else None
            edges = [low, *(b for b in breaks if low <= b < high), high]
            pieces = [_marked(text[a:b], shape) if text[a:b].strip() else "" for a, b in zip(edges, edges[1:], strict=False)]
            out.append("  \n".join(pieces))
        return "".join(out).strip()

    def numbered(self, text: str, head: dict) -> str:
        """Text of a paragraph behind its outline number, if it has one."""
        shape = self.entry("para_shape", head["para_shape_id"])
        if shape is None or shape["header_shape"] != "outline":
            return text
        level = shape["level"] + 1
        spacing = shape.get("line_spacing")
        if level == 7 and spacing is not None and 7 <= spacing <= 10:
            level = spacing + 1  # deeper levels are told by the line spacing, whatever the style's name says
        formats = self.entry("numbering", shape["number_bullet_id"])
        if level >= 8 and (formats is None or level - 8 >= len(formats["extended"])):
            return text
        told = [] if formats is None else formats["extended"][level - 8 : level - 7] if level >= 8 else [x["format"] for x in formats["levels"][level - 1 : level]]
        if told and told[0] and not told[0].strip("\0"):
            return text
        if level > 7:  # deeper levels are not counted
            return f"0. {text}"
        return f"{_label(level, self._count(level))} {text}"

    def _count(self, level: int) -> int:
        self.counters[level - 1] += 1
        self.counters[level:] = [0] * (7 - level)
        return self.counters[level - 1]

    # ------------------------------------------------------------ paragraphs

    def paragraph(self, node: Node, inside: bool = False) -> str:
        """Markdown of a paragraph: its objects in order, then its text."""
        parts: list[str] = []
        shapes = [(p, s) for n in node.of(SHAPES) for p, s in struct.iter_unpack("<II", n.data)]
        shapes.sort(key=lambda x: x[0])
        silent = inside and any(c.ident() in _NOTES for c in node.of(CONTROL))
        in_cells = {i for c in node.of(CONTROL) if c.ident() == "tbl " for i in self._control_images(c)}
        texts = []
        for at, child in enumerate(node.children):
            if child.tag == TEXT and not silent:
                texts.append(self.styled(*self.text(child), shapes))
            elif child.tag == COMPONENT:
                parts += self._component(child, in_cells)
            elif child.tag == PICTURE:
                parts += self._images([child], in_cells)
            elif child.tag == CONTROL:
                parts += self._control(child)
        if any(texts):
            head = LAYOUTS["para_header"].decode(node.data)
            parts.append(self.numbered("".join(texts), head))
        return _joined([p for p in parts if p])

    def _images(self, nodes: list[Node], without: set[int]) -> list[str]:
        return [m for i in self.pictures(nodes) if i not in without and (m := self.image(i))]

    def _component(self, node: Node, without: set[int]) -> list[str]:
        out = []
        for at, child in enumerate(node.children):
            if child.tag == PICTURE:
                out += self._images([child], without)
            elif child.tag == LIST:
                out += [self.paragraph(p) for p in listed(node, at)]
        return out

    def _control_images(self, control: Node) -> set[int]:
        """Images in the cells of a control's table, and those that stand beside the table."""
        cells = [p for c in cells_of(control) for p in c.paragraphs] if control.of(TABLE) else []
        found = {i for p in cells for i in self.contents(p)[1]}
        for child in control.children:
            if child.tag == COMPONENT:
                found.update(self.pictures(child.children))
        return found | set(self.pictures(control.children))

    def contents(self, paragraph: Node) -> tuple[set[str], set[int]]:
        """Different texts and images of a paragraph and all below it."""
        texts, images, todo = set(), set(), [paragraph]
        while todo:
            node = todo.pop()
            if node.tag == TEXT and (shown := self.text(node)[0].strip()):
                texts.add(shown)
            elif node.tag == PICTURE:
                images.update(self.pictures([node]))
            todo += node.children
        return texts, images

    def _control(self, control: Node) -> list[str]:
        ident = control.ident()
        own = control.of(PARA)
        if ident in ("head", "foot") and control.of(LIST):
            own = []
        if ident not in ("tbl ", "gso ", "head", "foot"):
            return [self.paragraph(p, True) for p in own] + self._images(control.children, set())
        tables = control.of(TABLE) if ident == "tbl " else []
        out, texts, images, known = [], set(), set(), set()
        if tables:
            cells = cells_of(control)
            for p in (p for c in cells for p in c.paragraphs):
                known.add(struct.unpack_from("<I", p.data, 18)[0] if len(p.data) >= 22 else 0)
                more = self.contents(p)
                texts, images = texts | more[0], images | more[1]
            out.append(self.table(tables[0], cells))
        for at, child in enumerate(control.children):
            if child.tag == LIST and not tables:
                out += [self.paragraph(p) for p in listed(control, at)]
            elif child.tag == COMPONENT:
                out += self._component(child, images)
            elif child.tag == PICTURE:
                out += self._images([child], images)
        for p in own:
            if tables:  # paragraphs of cells stand in the table already
                ident_p = struct.unpack_from("<I", p.data, 18)[0] if len(p.data) >= 22 else 0
                mine = self.contents(p)
                if (ident_p and ident_p in known) or mine[0] & texts or mine[1] & images:
                    continue
            out.append(self.paragraph(p, True))
        return out

    # ------------------------------------------------------------ tables

    def table(self, node: Node, cells: list[Cell]) -> str:
        rows, columns = struct.unpack_from("<HH", node.data, 4)
        if not rows or not columns:
            return f"\n\n[Table: {rows}x{columns}]\n\n"
        if not cells:
            return f"\n\n[Empty Table: {rows}x{columns}]\n\n"
        if any(c.row_span > 1 or c.column_span > 1 for c in cells):
            return self._html(rows, columns, cells)
        return self._grid(rows, columns, cells)

    def _html(self, rows: int, columns: int, cells: list[Cell]) -> str:
        first, left = min(c.row for c in cells), min(c.column for c in cells)
        taken: set[tuple[int, int]] = set()
        lines: dict[int, list[tuple[str, str]]] = {}
        for c in sorted(cells, key=lambda c: (c.row, c.column)):
            r, k = c.row - first, c.column - left
            if r >= rows or (k < columns and (r, k) in taken):
                continue
            taken.update((i, j) for i in range(r, min(rows, r + c.row_span)) for j in range(k, min(columns, k + c.column_span)))
            spans = [(n, v) for n, v in (("colspan", c.column_span), ("rowspan", c.row_span)) if v > 1]
            shown = "\n".join(x for x in (self._in_html(p) for p in c.paragraphs) if x.strip())
            body = shown if "<table" in shown else shown.replace("\n", "<br>")
            lines.setdefault(r, []).append((shown, "    <td" + "".join(f' {n}="{v}"' for n, v in spans) + f">{body}</td>\n"))
        body = "".join("  <tr>\n" + "".join(td for _, td in tds) + "  </tr>\n" for _, tds in sorted(lines.items()) if any(s.strip() for s, _ in tds))
        return f"{render.TABLE_OPEN}{body}</table>\n"

    def _in_html(self, paragraph: Node) -> str:
        out = []
        for child in paragraph.children:
            if child.tag == TEXT and (shown := self.text(child)[0]).strip():
                out.append(shown)
            elif child.tag == PICTURE:
                out += self._images([child], set())
            elif child.tag == COMPONENT:
                out += [x for x in self._component(child, set()) if x]
        return " ".join(out)

    def _grid(self, rows: int, columns: int, cells: list[Cell]) -> str:
        first, left = min(c.row for c in cells), min(c.column for c in cells)
        grid: dict[tuple[int, int], str] = {}
        one_row = all(c.row == first for c in cells)
        turn, before = 0, None
        for c in sorted(cells, key=lambda c: (c.row, c.column)) if one_row else cells:
            r, k = c.row - first, c.column - left
            if one_row:  # the rows are lost: a new one begins where the column does not grow
                turn = min(rows - 1, turn + 1) if before is not None and c.column <= before else turn
                r, before = turn, c.column
            if r < rows and k < columns:
                grid.setdefault((r, k), self._in_grid(c))
        lines = ["| " + " | ".join(grid.get((r, k), " ") for k in range(columns)) + " |" for r in range(rows)]
        lines.insert(1, "|" + "|".join(["---"] * columns) + "|")
        return "\n".join(["", *lines, ""])

    def _in_grid(self, cell: Cell) -> str:
        parts = []
        for n, paragraph in enumerate(cell.paragraphs):
            shown = "".join(_spaced(*self.text(c)) for c in paragraph.of(TEXT))
            parts += [shown] if shown.strip() else []
            for child in paragraph.children:
                if child.tag == PICTURE:
                    parts += self._images([child], set())
                elif child.tag == COMPONENT:
                    parts += [x for x in self._component(child, set()) if x]
            parts += ["<br>"] if n < len(cell.paragraphs) - 1 else []
        return "".join(parts).replace("|", "\\|") or " "

    # ------------------------------------------------------------ whole documents

    def parts(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {p: [] for p in render.PARTS}
        body, notes = out["body"], {"fn  ": 0, "en  ": 0}
        for section in self.sections():
            for node in section.of(PARA):
                head = LAYOUTS["para_header"].decode(node.data)
                if not head["control_mask"] & _CARRIES:
                    if body and (head["divide_section"] or head["divide_page"]) and body[-1] not in ("", "---"):
                        body.append("---\n")
                    body += [x for x in [self.paragraph(node)] if x]
                    continue
                for control in node.of(CONTROL):
                    ident = control.ident()
                    if ident in ("head", "foot"):
                        some = [p for k, c in enumerate(control.children) if c.tag == LIST for p in listed(control, k)] if control.of(LIST) else control.of(PARA)
                        out["headers" if ident == "head" else "footers"] += [x for x in map(self.paragraph, some) if x]
                    elif ident in notes:
                        notes[ident] += 1
                        mark = f"[^{notes[ident]}]"
                        if body:  # the reference stands behind the paragraph before
                            body[-1] = body[-1].replace("</p>", f" {mark}</p>") if "</p>" in body[-1] else f"{body[-1]} {mark}"
                        else:
                            body.append(mark)
                        out["footnotes" if ident == "fn  " else "endnotes"] += [x for x in (self.paragraph(p, True) for p in control.of(PARA)) if x]
        return out

    # ------------------------------------------------------------ lines of a page

    def lines(self) -> Iterator[tuple]:
        """Rows of ``LINES`` after the document's columns: each line of each paragraph of the body, and objects that stand by themselves."""
        ordinal = 0
        for section, root in enumerate(self.sections()):
            for node in root.of(PARA):
                head = LAYOUTS["para_header"].decode(node.data)
                segments = [records.SPECIAL["para_line_seg"][1](n.data)["segments"] for n in node.of(SEGMENTS)][:1]
                first = segments[0][0]["vertical"] if segments and segments[0] else None
                shape = self.entry("para_shape", head["para_shape_id"])
                named = f"ps{head['para_shape_id']}" if shape else ""
                common = (section, ordinal, first, bool(head["divide_section"] or head["divide_page"]), named, bool(shape and shape["line_grid"]), shape["outdent"] if shape else None)
                ordinal += 1
                if head["control_mask"] & _CARRIES:
                    continue
                images = [i for c in node.children for i in self._placed_images(c)]
                inline = [i for i in images if i["inline"]]
                empty = 0
                for k, (segment, runs, blank) in enumerate(self._segments(node, head, segments[0] if segments else [])):
                    hollow = bool(segment["tag"] & 1 << 16)
                    image = inline[empty] if (hollow or blank) and empty < len(inline) else None
                    empty += hollow
                    yield (*common, k, {**segment, "indented": bool(segment["tag"] & 1 << 20)}, [] if image or blank else runs, image)
                for k, image in enumerate(i for i in images if not i["inline"]):
                    yield (*common, 1000 + k, None, [], image)

    def _segments(self, node: Node, head: dict, segments: list[dict]) -> Iterator[tuple[dict, list[dict], bool]]:
        """(line, its text in runs of one style, whether it is blank). Places count all units of the text as stored; a control takes as
        many as it has, and shows one character or none. Of lines that start at the same place the last holds the text, so that it is
        shown once."""
        text = "".join(self.text(n)[0] for n in node.of(TEXT))
        controls = [(r["position"], (r["code"] in _SHOWN) - r["size"]) for n in node.of(TEXT)[:1] for r in records.text_runs(n.data) if r["kind"] == "control"]
        shapes = sorted(((p, s) for n in node.of(SHAPES) for p, s in struct.iter_unpack("<II", n.data)), key=lambda x: x[0])
        at = lambda p: max(0, p + sum(d for q, d in controls if q < p))
        for segment, after in zip(segments, [*segments[1:], None], strict=False):
            start = segment["text_start"]
            end = next((s["text_start"] for s in segments if s["text_start"] > start), head["text_char_count"])
            if after and after["text_start"] == start:
                end = start
            part = text[at(start) : at(end)]
            inside = [(p - start, s) for p, s in shapes if start <= p < end]
            if not any(p == 0 for p, _ in inside):
                inside = [(0, s) for p, s in shapes if p < start][-1:] + inside
            cuts = sorted({0, len(part), *(p for p, _ in inside if p <= len(part))})
            runs = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                held = [s for p, s in inside if p <= low][-1:]
                shape = self.entry("char_shape", held[0]) if held else None
                flags = {n: bool(shape[n]) for n in ("italic", "strikethrough", "superscript", "subscript")} | {"underline": shape["underline_type"] > 0} if shape else {}
                runs.append({"text": part[low:high], "style": held[0] if shape else None, "size": shape["base_size"] if shape else None, "color": shape["text_color"] if shape else None, **flags})
            yield segment, runs, not part.strip()

    def _placed_images(self, node: Node) -> list[dict]:
        """Images of a paragraph's record with their size; those of a shape that behaves like a letter stand in the line."""
        if node.tag == COMPONENT:
            size = records.SPECIAL["shape_component"][1](node.data)
            return self._sized(node.children, size, False, 0, 0)
        if node.tag != CONTROL or node.ident() != "gso ":
            return []
        about = CONTROL_LAYOUTS["object_common"].decode(node.data[4:])
        out = []
        for component in node.of(COMPONENT):
            size = records.SPECIAL["shape_component"][1](component.data)
            out += self._sized([component], size, about["like_letters"], about["offset_x"], about["offset_y"])
        return out

    def _sized(self, nodes: list[Node], size: dict, inline: bool, x: int, y: int) -> list[dict]:
        out = []
        for node in nodes:
            if node.tag == COMPONENT:
                out += self._sized(node.children, records.SPECIAL["shape_component"][1](node.data), inline, x, y)
            elif node.tag == PICTURE and (shown := self.image(LAYOUTS["picture"].decode(node.data)["bindata_id"])):
                out.append({"url": shown[len("![이미지](") : -1], "width": size["width"], "height": size["height"], "inline": inline, "x": x, "y": y})
        return out

    def page(self) -> dict:
        """The first page definition, at the top or below a control of the body."""
        for root in self.sections():
            for node in root.of(PARA):
                for child in node.children:
                    for found in [child, *child.children] if child.tag == CONTROL else [child]:
                        if found.tag == PAGE:
                            return LAYOUTS["page_def"].decode(found.data)
        return {}

    # ------------------------------------------------------------ numbers

    def display_numbers(self) -> Iterator[tuple]:
        """(section, paragraph, position, shape, number, prefix, suffix) of each automatic number in a top-level paragraph, table or note."""
        known = (self.dictionaries["document_properties"] or [{}])[0]
        trees = list(self.sections())
        shapes = [LAYOUTS["footnote_shape"].decode(n.data) for t in trees for p in t.of(PARA) for n in p.of(FOOTNOTE_SHAPE)][:2]
        foot, end = (shapes[0], shapes[-1]) if shapes else (None, None)
        start = {1: (foot or {}).get("start_number", known.get("footnote_start", 1)), 2: (end or {}).get("start_number", known.get("endnote_start", 1))}
        now = start | {3: known.get("image_start", 1), 4: known.get("table_start", 1), 5: known.get("formula_start", 1)}
        restart = {k: s is not None and s["numbering"] == "restart" for k, s in ((1, foot), (2, end))}
        for section, root in enumerate(trees):
            now |= {k: start[k] for k in (1, 2) if restart[k]}
            for number, node in enumerate(root.of(PARA)):
                filled: set[int] = set()
                auto = [CONTROL_LAYOUTS["auto_number"].decode(c.data[4:]) for c in node.of(CONTROL) if c.ident() in ("atno", "autn")]
                for new in [CONTROL_LAYOUTS["new_number"].decode(c.data[4:]) for c in node.of(CONTROL) if c.ident() == "newn"][-1:]:
                    if new["kind"] in now:
                        now[new["kind"]] = new["number"]
                if auto and auto[-1]["kind"] in now:
                    last = auto[-1]
                    around = [next((a[k] for a in reversed(auto) if a[k]), "") for k in ("prefix", "suffix")]
                    for text in node.of(TEXT):
                        for at in _auto_numbers(text):
                            filled.add(id(text))
                            yield section, number, at, last["shape"], now[last["kind"]], *around
                    now[last["kind"]] += 1
                yield from ((section, number, at, 0, value, "", "") for at, value in self._nested_numbers(node.children, now, filled))

    def _nested_numbers(self, nodes: list[Node], now: dict[int, int], filled: set[int]) -> Iterator[tuple[int, int]]:
        """Numbers inside controls: those of a note take its number, the first of a table the table's."""
        for control in nodes:
            if control.tag not in (CONTROL, LIST, COMPONENT, PARA):
                continue
            ident = control.ident() if control.tag == CONTROL else ""
            if ident in ("fn  ", "en  "):
                kind = 1 if ident == "fn  " else 2
                for text in _below(control, TEXT):
                    if id(text) not in filled:
                        yield from ((at, now[kind]) for at in _auto_numbers(text))
                        filled.add(id(text))
                now[kind] += 1
            elif ident == "tbl ":
                for text in (t for p in control.of(PARA) for t in p.of(TEXT)):
                    places = _auto_numbers(text) if id(text) not in filled else []
                    if places:
                        yield places[0], now[4]
                        filled.add(id(text))
                        now[4] += 1
                        break
            yield from self._nested_numbers(control.children, now, filled)


@dataclass
class Cell:
    row: int
    column: int
    row_span: int
    column_span: int
    paragraphs: list[Node]


def cells_of(control: Node) -> list[Cell]:
    """Cells of a table control by row and column: the lists behind the table's record. Of two at one place the first counts, unless it
    is empty; those outside the table are left out."""
    at = next(k for k, c in enumerate(control.children) if c.tag == TABLE)
    rows, columns = struct.unpack_from("<HH", control.children[at].data, 4) if len(control.children[at].data) >= 8 else (0, 0)
    found: dict[tuple[int, int], Cell] = {}
    opened = [k for k, c in enumerate(control.children) if k > at and c.tag == LIST]
    for k in opened:
        data = control.children[k].data
        if len(data) < 34:
            continue
        column, row, column_span, row_span = struct.unpack_from("<4H", data, 8)
        cell = Cell(row, column, row_span, column_span, listed(control, k))
        if (row, column) not in found or (not found[row, column].paragraphs and cell.paragraphs):
            found[row, column] = cell
    return [c for place, c in sorted(found.items()) if place[0] < rows and place[1] < columns]


def _below(node: Node, tag: int) -> Iterator[Node]:
    for child in node.children:
        if child.tag == tag:
            yield child
        yield from _below(child, tag)


def _auto_numbers(text: Node) -> list[int]:
    return [r["position"] for r in records.text_runs(text.data) if r["kind"] == "control" and r["code"] == 18]


def _plain(text: str, breaks: list[int]) -> str:
    """Trimmed pieces of a text without styles, each break taking the character at its place."""
    out, at = [], 0
    for b in (b for b in breaks if b < len(text)):
        out += [text[at:b].strip(), "  \n"]
        at = b + 1
    return ("".join([*out, text[at:].strip()])).lstrip() if out else text.strip()


def _spaced(text: str, breaks: list[int]) -> str:
    """Text of a cell in a grid: a space for each break, which takes the character at its place."""
    out, at = [], 0
    for b in breaks:
        out += [text[at:b] if at < b <= len(text) else "", " "]
        at = min(len(text), b + 1)
    return "".join([*out, text[at:]])


def _marked(text: str, shape: dict | None) -> str:
    if shape is None:
        return text
    for flag, mark in (("italic", "*"), ("bold", "**"), ("strikethrough", "~~")):
        text = f"{mark}{text}{mark}" if shape[flag] else text
    return text


def _label(level: int, n: int) -> str:
    syllable = numbers.SYLLABLES[(n - 1) % len(numbers.SYLLABLES)] if n else ""
    shapes = {1: f"{n}.", 2: f"{syllable}.", 3: f"{n})", 4: f"{syllable})", 5: f"({n})", 6: f"({syllable})", 7: numbers.CIRCLED[n - 1] if 0 < n <= 20 else str(n)}
    return shapes[level]


def _joined(parts: list[str]) -> str:
    """Parts one after the other: a line break between two texts, a blank line around an image, a table or a rule."""
    alone = [p.startswith(("![이미지]", "|", "---")) for p in parts]
    out = parts[:1]
    for k in range(1, len(parts)):
        out += ["\n\n" if alone[k] or alone[k - 1] else "  \n", parts[k]]
    return "".join(out)


_NEEDED = "FileHeader|DocInfo|(Root Entry/)?BodyText/Section[0-9]+|(Root Entry/)?(BinData/)?BIN.*"


def _each(files: DataFrame, schema: str, rows, folder: str | None) -> DataFrame:
    """rows(document) to Arrow rows of path, version, ..., error, for each compound file."""

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    document = Document(compound.read_compound(content.as_py(), _NEEDED), folder)
                    found = [(path, document.version, *r, None) for r in rows(document)]
                except (compound.CompoundError, RecordError, struct.error, RecursionError) as e:
                    found = [(path, *[None] * (len(arrow) - 2), str(e) or type(e).__name__)]
                cols = list(zip(*found, strict=True)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    bounded(files.sparkSession)
    return files.where(F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1").select("path", "content").mapInArrow(run, schema)


def parts(files: DataFrame, folder: str | None = "images") -> DataFrame:
    """files: ``path``, ``content``. One row a line of Markdown: ``doc``, ``version``, ``part`` (one of render.PARTS), ``ord``, ``line``;
    a document that cannot be read gives one row with an error. folder: where images are said to be; None puts their bytes in the text."""
    return _each(files, PARTS, lambda d: [(p, k, x) for p, some in d.parts().items() for k, x in enumerate(some)], folder)


def markdowns(files: DataFrame, folder: str | None = "images") -> DataFrame:
    """doc, ``markdown`` of compound documents with tables, images, notes, headers and footers."""
    rows = parts(files, folder).where("error is null")
    return render.markdown(rows, "doc", version=numbers.version("version", padded=True))


def display_texts(files: DataFrame) -> DataFrame:
    """doc, ``section``, ``paragraph``, ``position``, ``shown`` of automatic numbers: counted in document order, written in the shape that
    their control names, within its prefix and suffix."""
    schema = "doc string, version long, section int, paragraph int, position int, shape int, number long, prefix string, suffix string, error string"
    rows = _each(files, schema, lambda d: d.display_numbers(), None).where("error is null")
    shape = F.coalesce(F.get(F.array(*[F.lit(n) for n in numbers.SHAPES]), F.col("shape")), F.lit("arabic"))
    shown = F.concat("prefix", numbers.format_number(shape, "number"), "suffix")
    return rows.select("doc", "section", "paragraph", "position", shown.alias("shown"))


_SEGMENT = "struct<text_start:long,vertical:int,line_height:int,text_height:int,baseline:int,spacing:int,column_start:int,width:int,tag:long,indented:boolean>"
_RUN = "struct<text:string,style:int,size:int,color:long,italic:boolean,underline:boolean,strikethrough:boolean,superscript:boolean,subscript:boolean>"
_IMAGE = "struct<url:string,width:long,height:long,inline:boolean,x:int,y:int>"
LINES = f"section int, paragraph int, first int, breaks boolean, class string, line_grid boolean, outdent int, line int, segment {_SEGMENT}, runs array<{_RUN}>, image {_IMAGE}"


def lines(files: DataFrame, folder: str | None = "images") -> DataFrame:
    """One row a line of the body's paragraphs: ``doc``, ``section``, ``paragraph``, ``first`` (where the paragraph begins on its page), ``breaks``,
    ``class``, ``line_grid``, ``outdent``, ``line``, ``segment`` (null for an image that stands by itself), ``runs``, ``image``."""
    return _each(files, f"doc string, version long, {LINES}, error string", lambda d: d.lines(), folder).where("error is null").drop("version", "error")


def styles(files: DataFrame) -> DataFrame:
    """One row a document: ``doc``, ``page`` (struct of lengths, null if there is none), ``char_shapes``, ``para_shapes`` (arrays in order)."""
    page = "struct<paper_width:long,paper_height:long,left_margin:long,right_margin:long,top_margin:long,bottom_margin:long,header_margin:long,footer_margin:long,binding_margin:long>"
    schema = f"doc string, version long, page {page}, char_shapes array<struct<size:int,color:long,bold:boolean,italic:boolean,spacing:array<int>,font:string>>, para_shapes array<string>, error string"

    def rows(d: Document) -> Iterator[tuple]:
        fonts = d.dictionaries["face_name"]
        name = lambda k: fonts[k]["name"] if k < len(fonts) else None
        shapes = [{"size": c["base_size"], "color": c["text_color"], "bold": c["bold"], "italic": c["italic"], "spacing": c["spacing"], "font": name(c["font_ids"][0])} for c in d.dictionaries["char_shape"]]
        found = d.page()
        yield {k: found[k] for k in found if k.endswith(("_width", "_height", "_margin"))} or None, shapes, [p["align"] for p in d.dictionaries["para_shape"]]

    return _each(files, schema, rows, None).where("error is null").drop("version", "error")


def paragraph_json(files: DataFrame) -> DataFrame:
    """doc, ``json``: sections, each a list of paragraphs with their headers and typed records, nested as in the file."""
    schema = "doc string, version long, json string, error string"
    return _each(files, schema, lambda d: [(json.dumps([[_as_json(p) for p in s.of(PARA)] for s in d.sections()], ensure_ascii=False, separators=(",", ":")),)], None).drop("version")


_NAMES = {TEXT: "para_text", SHAPES: "para_char_shape", 69: "para_line_seg", 70: "para_range_tag", CONTROL: "ctrl_header", LIST: "list_header", COMPONENT: "shape_component", TABLE: "table", PICTURE: "picture"}


def _as_json(node: Node) -> dict:
    """A record with its type and what is below it; empty lists and missing values are left out."""
    if node.tag == PARA:
        head = LAYOUTS["para_header"].decode(node.data)
        return {"para_header": {k: head[k] for k in ("text_char_count", "para_shape_id", "style_id", "instance_id")}, "records": [_as_json(c) for c in node.children]}
    kind = _NAMES.get(node.tag)
    out: dict = {"type": kind or "unknown"}
    if kind is None:
        out |= {"tag_id": node.tag, "data": base64.b64encode(node.data).decode()}
    elif kind == "ctrl_header":
        out["ctrl_id"] = node.ident()
    else:
        row = records.decoder(kind)[1](node.data)
        out |= {k: v for k, v in row.items() if v not in (None, [], b"") and not isinstance(v, bytes)}
    below = [_as_json(c) for c in node.children]
    return out | ({"children": below} if below else {})
