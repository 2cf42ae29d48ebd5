"""Zipped packages of XML: entries, sections, paragraphs, tables, binary items."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.batches import bounded

ENTRIES = "doc string, name string, data binary, error string"
NODES = "doc string, section int, ord int, kind string, table_id int, row int, col int, row_span int, col_span int, text string, error string"
#: Bytes that one entry may have when inflated.
INFLATED = 512 << 20


def read_package(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, error) of each entry; one that is too large or broken has an error. Files whose ``mimetype`` is of another
    format are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        for info in sorted(infos, key=lambda i: i.filename != "mimetype"):
            try:
                if info.file_size > INFLATED:
                    raise ValueError("entry is too large")
                body = z.read(info)
            except (zipfile.BadZipFile, zlib.error, ValueError, EOFError, NotImplementedError, RuntimeError) as e:
                yield info.filename, None, str(e) or type(e).__name__
                continue
            if info.filename == "mimetype" and b"hwp" not in body and b"owpml" not in body:
                raise ValueError("another format")
            yield info.filename, body, None


def entries(files: DataFrame) -> DataFrame:
    """files: ``path``, ``content``. One row an entry: ``doc``, ``name``, ``data``, ``error``; a broken package gives one row with an
    error, a broken entry a row of its own."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, *entry) for entry in read_package(content.as_py())]
                except (zipfile.BadZipFile, ValueError, EOFError, NotImplementedError, RuntimeError) as e:
                    rows = [(path, None, None, str(e))]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["doc", "name", "data", "error"])

    bounded(files.sparkSession)
    return files.where(F.hex(F.substring("content", 1, 4)) == "504B0304").select("path", "content").mapInArrow(run, ENTRIES)


def sections(rows: DataFrame) -> DataFrame:
    """Section entries with their number; one without a number counts as 0."""
    found = rows.where(F.col("name").rlike(r"^Contents/section.*\.xml$"))
    return found.withColumn("section", F.coalesce(F.try_to_number(F.regexp_extract("name", r"section(\d+)\.xml$", 1), F.lit("999999999")).cast("int"), F.lit(0)))


def doc_info(rows: DataFrame) -> DataFrame:
    """doc and the document properties of a package: its header holds none, so there is one area and every number starts from 1."""
    one = [F.lit(1).alias(n) for n in ("area_count", "page_start", "footnote_start", "endnote_start", "image_start", "table_start", "formula_start")]
    return rows.select("doc").distinct().select("doc", *one)


def binary_items(rows: DataFrame) -> DataFrame:
    """Items below BinData/: ``index`` by name order, ``stem``, ``data``."""
    from pyspark.sql import Window

    found = rows.where(F.col("name").startswith("BinData/"))
    index = F.row_number().over(Window.partitionBy("doc").orderBy("name")) - 1
    return found.select("doc", index.alias("index"), F.regexp_extract("name", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("name", r"\.([^./]+)$", 1).alias("extension"), "data")


def header_version(rows: DataFrame) -> DataFrame:
    """doc, ``version``: from version.xml, else 5.1.0.0."""
    xml = F.decode("data", "UTF-8")
    major = F.nullif(F.regexp_extract(xml, r'\bmajor="(\d+)"', 1), F.lit("")).cast("long")
    found = rows.where("name = 'version.xml'").select("doc", (F.shiftleft(major, 24) + 0x00010000).alias("v"))
    return rows.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("v", F.lit(0x05010000).cast("long")).alias("version"))


def preview_text(rows: DataFrame) -> DataFrame:
    """doc, ``text`` of the preview; what is no UTF-8 is left out."""
    found = rows.where("name = 'Preview/PrvText.txt'")
    return found.where(F.is_valid_utf8(F.col("data").cast("string"))).select("doc", F.col("data").cast("string").alias("text"))


class _Section:
    """Events of a section's XML to rows. Tables may nest; a table's caption is a paragraph before it."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.order = self.tables = 0
        self.stack: list[dict] = []
        self.text: list[str] | None = None
        self.in_text = self.caption = False
        self.paragraphs: list[list[str]] = []

    def emit(self, kind: str, text: str | None, table=None, row=None, col=None, row_span=None, col_span=None) -> None:
        self.rows.append((self.order, kind, table, row, col, row_span, col_span, text))
        self.order += 1

    def start(self, tag: str, a: dict) -> None:
        name = tag.rpartition(":")[2]
        if name == "p":
            self.paragraphs.append([])
        elif name == "t":
            self.in_text = True
        elif name == "tab" and self.paragraphs:
            self.paragraphs[-1].append(leader(int(a.get("leader", 0) or 0), int(a.get("width", 0) or 0)))
        elif name == "lineBreak" and self.paragraphs:
            self.paragraphs[-1].append("\n")
        elif name == "tbl":
            self.stack.append({"id": self.tables, "row": -1, "col": 0, "cell": None})
            self.tables += 1
        elif name == "caption":
            self.caption = True
        elif name == "tr" and self.stack:
            self.stack[-1]["row"] += 1
            self.stack[-1]["col"] = 0
        elif name == "tc" and self.stack:
            self.stack[-1]["cell"] = {"row": None, "col": None, "rs": 1, "cs": 1, "text": []}
        elif name == "cellAddr" and self._cell():
            self._cell()["row"], self._cell()["col"] = int(a.get("rowAddr", 0)), int(a.get("colAddr", 0))
        elif name == "cellSpan" and self._cell():
            self._cell()["rs"], self._cell()["cs"] = int(a.get("rowSpan", 1)), int(a.get("colSpan", 1))
        elif name in ("img", "image") and a.get("binaryItemIDRef"):
            self.emit("image", a["binaryItemIDRef"])

    def _cell(self) -> dict | None:
        return self.stack[-1]["cell"] if self.stack else None

    def data(self, text: str) -> None:
        if self.in_text and self.paragraphs:
            self.paragraphs[-1].append(text)

    def end(self, tag: str) -> None:
        name = tag.rpartition(":")[2]
        if name == "t":
            self.in_text = False
        elif name == "caption":
            self.caption = False
        elif name == "p" and self.paragraphs:
            text = "".join(self.paragraphs.pop())
            if not text.strip():
                return
            if self._cell() is not None and not self.caption:
                self._cell()["text"].append(text)
            else:
                self.emit("caption" if self.caption else "paragraph", text)
        elif name == "tc" and self._cell():
            top, cell = self.stack[-1], self._cell()
            row = cell["row"] if cell["row"] is not None else max(0, top["row"])
            col = cell["col"] if cell["col"] is not None else top["col"]
            self.emit("cell", "\n".join(cell["text"]), top["id"], row, col, cell["rs"], cell["cs"])
            top["col"], top["cell"] = col + cell["cs"], None
        elif name == "tbl" and self.stack:
            self.stack.pop()


def leader(kind: int, width: int) -> str:
    """A tab as characters, as functions.text.tab_text has it."""
    if kind == 3:
        return "." * max(3, min(80, width // 1200))
    if kind in (1, 2):
        return {1: "_", 2: "-"}[kind] * max(2, min(40, width // 2400))
    return "\t"


def nodes(rows: DataFrame) -> DataFrame:
    """rows: sections(). Paragraphs, captions, cells and images in document order; a section that is no XML gives one row with an error."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[tuple] = []
            for doc, section, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                reader, parser = _Section(), expat.ParserCreate()
                parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
                try:
                    parser.Parse(data or b"", True)
                    out += [(doc, section, *r, None) for r in reader.rows]
                except (expat.ExpatError, ValueError) as e:
                    out.append((doc, section, 0, None, None, None, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [[]] * 11
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]
            names = ["doc", "section", "ord", "kind", "table_id", "row", "col", "row_span", "col_span", "text", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return rows.select("doc", "section", "data").mapInArrow(run, NODES)


def plain_text(node_rows: DataFrame) -> DataFrame:
    """doc, ``text``: top-level paragraphs, one a line."""
    rows = node_rows.where("kind in ('paragraph', 'caption')").select("doc", F.struct("section", "ord").alias("o"), T.trim("text").alias("t")).where("t <> ''")
    parts = F.array_sort(F.collect_list(F.struct("o", "t")))
    return rows.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))
