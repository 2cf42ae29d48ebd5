"""Queries over whole documents with headers, footers, notes, tables, images, outline numbers and page breaks: each row of ``documents`` is
written as such a file and rendered by the library; SQL says what has to come out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import query, table
from quillspark.operators import assembly, html, render
from quillspark.sources import writers
from quillspark.sources.batches import bounded


def _units(text: str) -> bytes:
    return text.encode("utf-16-le") + b"\r\0"


def _mark(code: int, ident: bytes) -> bytes:
    """An extended control character: eight units."""
    return struct.pack("<H", code) + ident + bytes(8) + struct.pack("<H", code)


def _para(level: int, text: bytes, inner: bytes = b"", mask: int = 0, divide: int = 0, shape: int = 0, instance: int = 0, style: int = 0) -> bytes:
    head = struct.pack("<IIHBBHHHI", len(text) // 2, mask, shape, 0, divide, 1, 0, 0, instance)
    return writers.record(66, level, head) + writers.record(67, level + 1, text) + writers.record(68, level + 1, struct.pack("<II", 0, style)) + inner


def _control(ident: bytes, body: bytes, inner: bytes, level: int = 1) -> bytes:
    return writers.record(71, level, ident[::-1] + body) + inner


def _list(*paragraphs: bytes, cell: tuple | None = None) -> bytes:
    data = struct.pack("<hHI", len(paragraphs), 0, 0) + (struct.pack("<4H2I4hH", *cell, 1000, 500, 0, 0, 0, 0, 1) if cell else b"")
    return writers.record(72, 2, data) + b"".join(paragraphs)


def _shape(bits: int) -> bytes:
    return writers.record(25, 1, struct.pack("<I6i3H4hI", bits, *[0] * 6, 0, 0, 0, 0, 0, 0, 0, 0))


def _style(bits: int) -> bytes:
    return writers.record(21, 1, struct.pack("<7H7B7b7B7b", *[0] * 7, *[100] * 7, *[0] * 7, *[100] * 7, *[0] * 7) + struct.pack("<iIbbIIII", 1000, bits, 0, 0, 0, 0, 0, 0))


def rich_file(doc: int, text: str, lang: str, source: str) -> bytes:
    """A document with one of each: cells span two columns if doc % 3 = 0, the introduction is bold if doc is odd."""
    header = _para(0, _mark(16, b"daeh") + _mark(16, b"toof") + _units(""), _control(b"head", bytes(4), _list(_para(2, _units(lang)))) + _control(b"foot", bytes(4), _list(_para(2, _units(source)))), mask=1 << 16)
    body = _para(0, _units(f"Intro {doc}"), style=doc % 2)
    body += b"".join(_para(0, _units(x)) for x in text.split("\n"))
    note = _para(0, _mark(17, b"  nf") + _units(""), _control(b"fn  ", bytes(8), _list() + _para(2, _mark(18, b"onta") + _units(f"note {doc}"))), mask=1 << 17)
    merged = doc % 3 == 0
    values = [(0, 0, 2 if merged else 1, lang)] + ([] if merged else [(0, 1, 1, source)]) + [(1, 0, 1, source if merged else str(doc))] + [(1, 1, 1, str(doc) if merged else "")]
    cells = b"".join(_list(_para(2, _units(t), instance=100 + k), cell=(c, r, s, 1)) for k, (r, c, s, t) in enumerate(values))
    grid = writers.record(77, 2, struct.pack("<IHHh4h2HHH", 0, 2, 2, 0, 0, 0, 0, 0, 2, 2, 1, 0)) + cells
    tabled = _para(0, _mark(11, b" lbt") + _units(""), _control(b"tbl ", bytes(42), grid), mask=1 << 11)
    after = _para(0, _units("After"), divide=4)
    outline = _para(0, _units("One"), shape=1) + _para(0, _units("Two"), shape=2) + _para(0, _units("Three"), shape=1) + _para(0, _units("Four"), shape=2)
    picture = writers.record(76, 2, b"cip$" * 2 + bytes(60)) + writers.record(85, 3, bytes(68) + bytes(3) + struct.pack("<H", 1) + bytes(5))
    image = _para(0, _mark(11, b" osg") + _units("seen"), _control(b"gso ", bytes(42), picture), mask=1 << 11)
    numbered = _para(0, _mark(18, b"onta") + _units(" table"), _control(b"atno", struct.pack("<IH3H", 4 | (2 << 4), 0, 0, ord("("), ord(")")), b""), mask=1 << 18)
    end = _para(0, _mark(17, b"  ne") + _units(""), _control(b"en  ", bytes(8), _list() + _para(2, _units(f"end {source}"))), mask=1 << 17)
    info = writers.record(16, 0, struct.pack("<7H3I", 1, 1, 5, 6, 7, 8 + doc % 5, 9, 0, 0, 0)) + writers.record(18, 1, struct.pack("<HH", 1, 1) + writers.string("png"))
    info += _style(0) + _style(2) + _shape(0) + _shape(1 << 23) + _shape(1 << 23 | 1 << 25)
    streams = {"FileHeader": writers.file_header(0x05010000, 1), "DocInfo": writers.deflate(info), "BinData/BIN0001.png": b"image"}
    return writers.compound(streams | {"BodyText/Section0": writers.deflate(header + body + note + tabled + numbered + after + outline + image + end)})


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content of every document as such a file."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, text, lang, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([rich_file(doc, text or "", lang or "", of or "")], pa.binary())], names=["path", "content"])

    bounded(spark)
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").mapInArrow(run, "path string, content binary")


def _parts(spark, d) -> DataFrame:
    return assembly.parts(files(spark, d)).withColumn("doc_id", F.col("doc").cast("long"))


_N = "chr(10)"
_GAP = f"{_N} || {_N}"
_LINES = f"(select doc_id, string_agg(trim(x), {_GAP} order by o) as t, count(*) as n from (select doc_id, unnest(string_split(text, {_N})) as x, unnest(range(len(string_split(text, {_N})))) as o from documents) where trim(x) <> '' group by doc_id)"
_OPEN = render.TABLE_OPEN.replace("\n", f"' || {_N} || '")
_TABLE = (
    f"case when doc_id % 3 = 0 then '{_OPEN}  <tr>' || {_N} || '    <td colspan=\"2\">' || lang || '</td>' || {_N} || '  </tr>' || {_N} || '  <tr>' || {_N} || '    <td>' || source || '</td>' || {_N} || '    <td>' || doc_id || '</td>' || {_N} || '  </tr>' || {_N} || '</table>' || {_N} "
    f"else {_N} || '| ' || lang || '  | ' || source || '  |' || {_N} || '|---|---|' || {_N} || '| ' || doc_id || '  |   |' || {_N} end"
)
_INTRO = "case when doc_id % 2 = 1 then '**Intro ' || doc_id || '**' else 'Intro ' || doc_id end"
_IMAGE = f"'![이미지](images/BIN0001.png)' || {_GAP} || 'seen'"
_BODY = f"{_INTRO} || {_GAP} || t || ' [^1]' || {_GAP} || {_TABLE} || {_GAP} || 'table' || {_GAP} || '---' || {_N} || {_GAP} || 'After' || {_GAP} || '1. One' || {_GAP} || '가. Two' || {_GAP} || '2. Three' || {_GAP} || '가. Four' || {_GAP} || {_IMAGE} || ' [^1]'"
_FROM = f"from documents join {_LINES} using (doc_id)"


@query("r02_parts", f"select doc_id, 'body' as part, n + 10 as n {_FROM} union all select doc_id, unnest(['headers', 'footers', 'footnotes', 'endnotes']), 1 from documents")
def _(spark, d):
    return _parts(spark, d).groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("r03_headers_footers", "select doc_id, lang as header, source as footer from documents")
def _(spark, d):
    line = lambda p: F.max(F.when(F.col("part") == p, F.col("line")))
    return _parts(spark, d).groupBy("doc_id").agg(line("headers").alias("header"), line("footers").alias("footer"))


@query("r04_notes", "select doc_id, 'note ' || doc_id as footnote, 'end ' || source as endnote, 2::bigint as marked from documents")
def _(spark, d):
    line = lambda p: F.max(F.when(F.col("part") == p, F.col("line")))
    marked = F.count_if((F.col("part") == "body") & F.col("line").endswith(" [^1]"))
    return _parts(spark, d).groupBy("doc_id").agg(line("footnotes").alias("footnote"), line("endnotes").alias("endnote"), marked.alias("marked"))


@query("r06_paragraphs", f"select doc_id, {_INTRO} as first, {_IMAGE} || ' [^1]' as last from documents")
def _(spark, d):
    body = _parts(spark, d).where("part = 'body'").groupBy("doc_id")
    return body.agg(F.min_by("line", "ord").alias("first"), F.max_by("line", "ord").alias("last"))


@query("r07_outline", "select doc_id, '1. One,가. Two,2. Three,가. Four' as numbered from documents")
def _(spark, d):
    rows = _parts(spark, d).where("part = 'body' and line rlike ' (One|Two|Three|Four)$'").groupBy("doc_id")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), ",").alias("numbered"))


@query("r10_table_cells", f"select doc_id, {_TABLE} as \"table\" from documents")
def _(spark, d):
    rows = _parts(spark, d).where(F.col("part") == "body")
    return rows.where(F.col("line").contains("<table") | F.col("line").startswith("\n|")).select("doc_id", F.col("line").alias("table"))


@query("k03_markdown_with_objects", f"select doc_id, '{render.TITLE}' || {_GAP} || {_GAP} || '{render.VERSION_LABEL}5.01.00.00' || {_GAP} || {_GAP} || lang || {_GAP} || {_GAP} || {_BODY} || {_GAP} || {_GAP} || source || {_GAP} || {_GAP} || '{render.FOOTNOTES}' || {_GAP} || {_GAP} || 'note ' || doc_id || {_GAP} || {_GAP} || '{render.ENDNOTES}' || {_GAP} || {_GAP} || 'end ' || source as markdown {_FROM}")
def _(spark, d):
    return assembly.markdowns(files(spark, d)).select(F.col("doc").cast("long").alias("doc_id"), "markdown")


_ROMAN = "list_extract(['VIII','IX','X','XI','XII'], (doc_id % 5 + 1)::int)"


@query("r32_display_texts", f"select doc_id, '5,(' || {_ROMAN} || ')' as shown from documents")
def _(spark, d):
    rows = assembly.display_texts(files(spark, d)).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "paragraph", "shown"))), lambda x: x["shown"]), ",").alias("shown"))
    return rows.select(F.col("doc").cast("long").alias("doc_id"), "shown")


@query("k01_document_json", f"select doc_id, (len(string_split(text, {_N})) + 12)::bigint as paragraphs, 'Intro ' || doc_id as first, 'tbl ' as control from documents")
def _(spark, d):
    rows = assembly.paragraph_json(files(spark, d))
    tables = F.regexp_extract("json", '"ctrl_id":"(tbl )"', 1)
    return rows.select(F.col("doc").cast("long").alias("doc_id"), F.json_array_length(F.get_json_object("json", "$[0]")).cast("long").alias("paragraphs"), F.get_json_object("json", "$[0][1].records[0].runs[0].text").alias("first"), tables.alias("control"))


# ---------------------------------------------------------------- pages of lines


def lined_file(doc: int, text: str, lang: str, source: str) -> bytes:
    """A document whose paragraphs are lines of the text, each in two line segments of half of it; a page holds ten paragraphs."""
    body = b""
    for k, line in enumerate(text.split("\n")):
        half = len(line) // 2
        top = k % 10 * 7200
        segment = lambda start, y, tag: struct.pack("<IiiiiiiiI", start, y, 720, 720, 720, 0, 360, 3600, tag)
        segments = writers.record(69, 1, segment(0, top, 0) + segment(half, top + 1440, 1 << 20))
        styled = writers.record(68, 1, struct.pack("<4I", 0, 0, half, 1))
        head = struct.pack("<IIHBBHHHI", len(line) + 1, 0, 0, 0, 0, 2, 0, 2, 0)
        body += writers.record(66, 0, head) + writers.record(67, 1, _units(line)) + styled + segments
    info = writers.record(16, 0, struct.pack("<7H3I", 1, 1, 1, 1, 1, 1, 1, 0, 0, 0)) + writers.record(19, 1, b"\0" + writers.string(source)) + _style(0) + _style(1) + _shape(1 << 2)
    return writers.compound({"FileHeader": writers.file_header(0x05010000, 1), "DocInfo": writers.deflate(info), "BodyText/Section0": writers.deflate(body)})


def lined_files(spark: SparkSession, d: str) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, text, lang, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([lined_file(doc, text or "", lang or "", of or "")], pa.binary())], names=["path", "content"])

    bounded(spark)
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").mapInArrow(run, "path string, content binary")


_X = f"(select doc_id, source, unnest(string_split(text, {_N})) as x, unnest(range(len(string_split(text, {_N})))) as o from documents)"


@query("r23_lines", f"select doc_id, o::bigint as paragraph, 0::bigint as line, substr(x, 1, length(x) // 2) as shown from {_X} where trim(substr(x, 1, length(x) // 2)) <> '' union all select doc_id, o, 1, substr(x, length(x) // 2 + 1) from {_X} where trim(substr(x, length(x) // 2 + 1)) <> ''")
def _(spark, d):
    rows = assembly.lines(lined_files(spark, d)).where("size(runs) > 0")
    shown = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    return rows.select(F.col("doc").cast("long").alias("doc_id"), F.col("paragraph").cast("long").alias("paragraph"), F.col("line").cast("long").alias("line"), shown.alias("shown"))


@query("r24_boxes_of_lines", f"select doc_id, o::bigint as paragraph, '<div class=\"hls ps0\" style=\"line-height:2.54mm;white-space:nowrap;left:1.27mm;top:' || format('{{:.2f}}', (o % 10) * 25.4 + 5.08) || 'mm;height:2.54mm;width:12.70mm;padding-left:0.00mm;\"><span class=\"hrt cs1\" style=\"font-size:10pt;color:rgb(0,0,0);\"><em>' || regexp_replace(regexp_replace(substr(x, length(x) // 2 + 1), '^ ', '&nbsp;'), ' $', '&nbsp;') || '</em></span></div>' as box from {_X} where trim(substr(x, length(x) // 2 + 1)) <> ''")
def _(spark, d):
    rows = html.line_boxes(assembly.lines(lined_files(spark, d))).where("line = 1 and size(runs) > 0")
    return rows.select(F.col("doc").cast("long").alias("doc_id"), F.col("paragraph").cast("long").alias("paragraph"), "box")


@query("r21_html_pages", f"select doc_id, ((max(o) + 10) // 10)::bigint as pages, (2 * count(*))::bigint as lines, 1::bigint as heads from {_X} group by doc_id")
def _(spark, d):
    rows = html.documents(lined_files(spark, d))
    count = lambda t: F.regexp_count("html", F.lit(t)).cast("long")
    return rows.select(F.col("doc").cast("long").alias("doc_id"), count('<div class="hpa"').alias("pages"), count('<div class="hls ps0"').alias("lines"), count("<!DOCTYPE html>").alias("heads"))


_RULE = "  font-size:10pt;color:rgb(0,0,0);font-family:\"' || source || '\";"


@query("r20_style_sheets", f"select doc_id, '.cs0 {{{{' || {_N} || '{_RULE}' || {_N} || '}}}}' || {_N} || '.cs1 {{{{' || {_N} || '{_RULE}font-style:italic;' || {_N} || '}}}}' || {_N} || '.ps0 {{{{' || {_N} || '  text-align:left;' || {_N} || '}}}}' || {_N} as own, 57::bigint as fixed, '.hcc {{{{margin:0;padding:0;position:absolute;}}}}' as one from documents".replace("{{", "{").replace("}}", "}"))
def _(spark, d):
    rows = html.style_sheets(assembly.styles(lined_files(spark, d)))
    fixed = F.substring_index("css", ".cs0 {", 1)
    own = F.substring_index(F.concat(F.lit(".cs0 {"), F.substring_index("css", ".cs0 {", -1)), "@media", 1)
    return rows.select(F.col("doc").cast("long").alias("doc_id"), own.alias("own"), F.regexp_count(fixed, F.lit("\n")).cast("long").alias("fixed"), F.regexp_extract("css", r"(\.hcc \{.*?\})", 1).alias("one"))


@query("r27_shape_images", "select doc_id, 'images/BIN0001.png' as url, false as inline from documents")
def _(spark, d):
    rows = assembly.lines(files(spark, d)).where("image is not null")
    return rows.select(F.col("doc").cast("long").alias("doc_id"), "image.url", "image.inline")


@query("r26_html_controls", "select p_partkey, p_size % 4 < 2 as shown from part")
def _(spark, d):
    ident = F.get(F.array(*[F.lit(n) for n in ("tbl ", "gso ", "secd", "fn  ")]), F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", html.shows_control(ident).alias("shown"))
