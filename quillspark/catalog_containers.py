"""Queries over whole containers: each row of ``documents`` is written as a compound file (compressed or bare) or a package, then the
library scans the files, and its results are held against SQL over the texts."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import query, table
from quillspark.functions import bits, media, numbers
from quillspark.operators import documents
from quillspark.sources import compound, package, records, sinks, streams, summary, writers
from quillspark.sources.batches import bounded

#: Lines of a section.
SECTION = 20
_EPOCH = 116_444_736_000_000_000


def _sections(text: str) -> list[list[str]]:
    lines = text.split("\n")
    return [lines[k : k + SECTION] for k in range(0, len(lines), SECTION)]


def binary_file(doc: int, text: str, lang: str, source: str) -> bytes:
    """A compound file: compressed if doc % 3 = 0; then, if doc % 17 = 0, its first section is cut off."""
    packed = doc % 3 == 0
    put = writers.deflate if packed else bytes
    parts = _sections(text)
    info = writers.record(16, 0, struct.pack("<7H3I", len(parts), 1, 2, 3, 4, 5, 6, 0, 0, 0)) + writers.record(18, 1, struct.pack("<HH", 1, 1) + writers.string("png"))
    info += writers.record(19, 1, b"\0" + writers.string(lang)) + writers.record(26, 0, writers.string("stray") * 2 + struct.pack("<BBhHH", 0, 0, 0, 0, 0))
    info += b"".join(writers.record(26, 1, writers.string(n) + writers.string("Body") + struct.pack("<BBhHH", 0, 0, 1042, k, 5)) for k, n in enumerate((source, lang)))
    out = {"FileHeader": writers.file_header(0x05010000 + doc % 256, int(packed) | (doc % 2) << 5), "DocInfo": put(info)}
    for k, lines in enumerate(parts):
        body = put(b"".join(writers.paragraph(x) for x in lines))
        out[f"BodyText/Section{k}"] = body[:-10] if packed and k == 0 and doc % 17 == 0 else body
    out["BodyText/Section99"] = put(writers.paragraph("beyond"))
    out["PrvText"] = text[:50].encode("utf-16-le")
    out["PrvImage"] = (b"BM", b"GIF89a", b"\x89PNG")[doc % 3 if doc % 3 == 0 else 1 + doc % 2] + bytes(8)
    out["Scripts/JScriptVersion"] = put(struct.pack("<II", doc, 7))
    out["Scripts/DefaultJScript"] = put(b"".join(writers.string(x, "<I") for x in (lang, source, "", "post")) + b"\xff" * 4)
    out["XMLTemplate/Schema"] = put(writers.string(source, "<I"))
    out["\x05HwpSummaryInformation"] = writers.property_set({2: source, 4: lang}, {14: len(parts)}, {12: _EPOCH + 864_000_000_000 * (doc % 1000)})
    if doc % 4 == 2:
        out |= {"BinData/BIN0001": b"", "BinData/BIN0001.png": source.encode()}
    else:
        out["BinData/BIN0001"] = writers.deflate(source.encode())
    return writers.compound(out)


def packaged_file(doc: int, text: str, lang: str, source: str) -> bytes:
    """A package; if doc % 17 = 0 the data of its first section is damaged."""
    out = {"mimetype": b"application/hwp+zip"} if doc % 5 else {}
    if doc % 2:
        out["version.xml"] = f'<v major="{doc % 7 + 1}" minor="1"/>'.encode()
    for k, lines in enumerate(_sections(text)):
        body = "".join(f"<hp:p><hp:run><hp:t>{escape(x)}</hp:t></hp:run></hp:p>" for x in lines)
        out[f"Contents/section{k}.xml"] = f'<hs:sec xmlns:hs="s" xmlns:hp="p">{body}</hs:sec>'.encode()
    out |= {"Preview/PrvText.txt": text[:50].encode(), "BinData/image1.png": source.encode(), "BinData/logo.gif": lang.encode()}
    data = writers.package(out)
    if doc % 17 == 0:
        name = b"Contents/section0.xml"
        at = data.index(name) + len(name)
        data = data[:at] + b"\xff" * 8 + data[at + 8 :]
    return data


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content of every document as a file."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, text, lang, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                make = packaged_file if doc % 3 == 2 else binary_file
                yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([make(doc, text or "", lang or "", of or "")], pa.binary())], names=["path", "content"])

    bounded(spark)
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").mapInArrow(run, "path string, content binary")


def _doc(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("doc").cast("long").alias("doc_id"), *columns)


_SOUND = "not (doc_id % 3 = 0 and doc_id % 17 = 0 and ord < 20) and not (doc_id % 3 = 2 and doc_id % 17 = 0 and ord < 20)"
_L = f"l as (select doc_id, lang, source, unnest(range(len(x)))::bigint as ord, unnest(x) as line, len(x) as n from (select *, string_split(text, chr(10)) as x from documents)), b as (select * from l where doc_id % 3 < 2), p as (select * from l where doc_id % 3 = 2), s as (select * from l where {_SOUND})"
_PARTS = "((len(string_split(text, chr(10))) + 19) // 20)"


@query("s01_formats", "select doc_id, case when doc_id % 3 = 2 then 'package' else 'compound' end as format from documents")
def _(spark, d):
    return _doc(documents.formats(files(spark, d)), "format")


@query("s02_streams", f"select doc_id, 10 + {_PARTS} + case when doc_id % 4 = 2 then 1 else 0 end as n from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(compound.streams(files(spark, d)).groupBy("doc").agg(F.count("name").alias("n")), "n")


@query("s04_dispatch", "select doc_id, 1::bigint as n from documents where doc_id % 17 = 0 and doc_id % 3 <> 1")
def _(spark, d):
    # what could not be read has a row of its own: here one section a damaged document
    return _doc(documents.errors(files(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "n")


@query("s06_root_stream", "select doc_id, 256::bigint as size, (2 * length(substr(text, 1, 50)))::bigint as preview from documents where doc_id % 3 < 2")
def _(spark, d):
    rows = compound.streams(files(spark, d), "FileHeader|PrvText")
    size = lambda n: F.max(F.when(F.col("name") == n, F.octet_length("data"))).cast("long")
    return _doc(rows.groupBy("doc").agg(size("FileHeader").alias("size"), size("PrvText").alias("preview")), "size", "preview")


@query("s07_nested_streams", f"select doc_id, {_PARTS} + 1 as n from documents where doc_id % 3 < 2")
def _(spark, d):
    rows = compound.nested(compound.streams(files(spark, d)), "BodyText", "Section[0-9]+")
    return _doc(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "n")


@query("s09_entries", f"select doc_id, {_PARTS} + 3 + case when doc_id % 5 > 0 then 1 else 0 end + doc_id % 2 as n, (doc_id % 17 = 0)::bigint as broken from documents where doc_id % 3 = 2")
def _(spark, d):
    return _doc(package.entries(files(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("broken")), "n", "broken")


@query("s10_mimetype", "select doc_id, doc_id % 5 > 0 as named from documents where doc_id % 3 = 2")
def _(spark, d):
    return _doc(package.entries(files(spark, d)).groupBy("doc").agg(F.bool_or(F.col("name") == "mimetype").alias("named")), "named")


@query("s11_section_order", f"select doc_id, array_to_string(range({_PARTS}), ',') as sections from documents where doc_id % 3 = 2")
def _(spark, d):
    rows = package.sections(package.entries(files(spark, d))).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("section")), ",").alias("sections"))
    return _doc(rows, "sections")


@query("s12_package_items", "select doc_id, unnest([0, 1])::int as index, unnest(['image1', 'logo']) as stem, unnest(['png', 'gif']) as extension, unnest([source, lang]) as body from documents where doc_id % 3 = 2")
def _(spark, d):
    return _doc(package.binary_items(package.entries(files(spark, d))), "index", "stem", "extension", F.decode("data", "UTF-8").alias("body"))


@query("s13_inflate", f"with {_L} select doc_id, (ord // 20)::int as section, case when doc_id % 51 = 0 and ord // 20 = 0 then null else sum(26 + 4 + 2 * (length(line) + 1) + case when 2 * (length(line) + 1) >= 4095 then 4 else 0 end + 12)::bigint end as size, doc_id % 51 = 0 and ord // 20 = 0 as broken from b group by doc_id, ord // 20")
def _(spark, d):
    rows = records.sections(compound.streams(files(spark, d))).where("section < 99")
    return _doc(rows, "section", F.octet_length("data").cast("long").alias("size"), F.col("error").isNotNull().alias("broken"))


@query("s15_file_headers", "select doc_id, 83951616 + doc_id % 256 as version, doc_id % 3 = 0 as compressed, doc_id % 2 = 1 as templates from documents where doc_id % 3 < 2")
def _(spark, d):
    rows = records.file_headers(compound.streams(files(spark, d)))
    return _doc(rows, "version", bits.has_bit("document_flags", 0).alias("compressed"), bits.has_bit("document_flags", 5).alias("templates"))


def _info(spark, d) -> DataFrame:
    return records.records(compound.inflated(compound.streams(files(spark, d)).where("name = 'DocInfo'")))


@query("s16_doc_info", f"select doc_id, {_PARTS} as area_count, lang as font, unnest([source, lang]) as style, unnest([0, 1])::bigint as idx from documents where doc_id % 3 < 2")
def _(spark, d):
    info = _info(spark, d)
    styles = records.dictionary(info, "style").select("doc", "idx", F.col("local_name").alias("style"))
    fonts = records.dictionary(info, "face_name").select("doc", F.col("name").alias("font"))
    return _doc(styles.join(fonts, "doc").join(records.area_counts(info), "doc"), F.col("area_count").cast("long").alias("area_count"), "font", "style", "idx")


@query("s17_body", f"with {_L} select doc_id, count(distinct ord // 20) as sections, count(*) as paragraphs from s where doc_id % 3 < 2 group by doc_id")
def _(spark, d):
    rows = compound.streams(files(spark, d))
    areas = records.area_counts(records.records(compound.inflated(rows.where("name = 'DocInfo'"))))
    framed = records.tree(records.records(records.sections(rows, areas))).where("tag = 66 and parent is null")
    return _doc(framed.groupBy("doc").agg(F.count_distinct("stream").alias("sections"), F.count(F.lit(1)).alias("paragraphs")), "sections", "paragraphs")


@query("s18_items", "select doc_id, 1 as index, case when doc_id % 4 = 2 then 'BinData/BIN0001.png' else 'BinData/BIN0001' end as name, source as body from documents where doc_id % 3 < 2")
def _(spark, d):
    items = streams.binary_items(compound.streams(files(spark, d)), records.dictionary(_info(spark, d), "bin_data"))
    return _doc(items, "index", "name", F.decode("data", "UTF-8").alias("body"))


@query("s20_package_versions", "select doc_id, case when doc_id % 2 = 1 then (doc_id % 7 + 1) * 16777216 + 65536 else 83951616 end as version from documents where doc_id % 3 = 2")
def _(spark, d):
    return _doc(package.header_version(package.entries(files(spark, d))), "version")


@query("s21_package_info", "select doc_id, 1::bigint as area_count, 1::bigint as table_start from documents where doc_id % 3 = 2")
def _(spark, d):
    return _doc(package.doc_info(package.entries(files(spark, d))), F.col("area_count").cast("long").alias("area_count"), F.col("table_start").cast("long").alias("table_start"))


@query("s22_package_paragraphs", f"with {_L} select doc_id, (ord // 20)::int as section, count(*) as n, sum(length(line))::bigint as chars from s where doc_id % 3 = 2 and trim(line) <> '' group by doc_id, ord // 20")
def _(spark, d):
    nodes = package.nodes(package.sections(package.entries(files(spark, d)).where("error is null"))).where("kind = 'paragraph'")
    return _doc(nodes.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")), "section", "n", "chars")


@query("s23_previews", "select doc_id, substr(text, 1, 50) as preview from documents")
def _(spark, d):
    f = files(spark, d)
    rows = streams.preview_text(compound.streams(f)).union(package.preview_text(package.entries(f)))
    return _doc(rows, F.col("text").alias("preview"))


@query("s25_preview_images", "select doc_id, case when doc_id % 3 = 0 then 'BMP' when doc_id % 2 = 0 then 'GIF' else 'UNKNOWN' end as format from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(streams.preview_images(compound.streams(files(spark, d))), "format")


@query("s26_scripts", "select doc_id, doc_id as high, 7::bigint as low, lang as header, source, '' as pre, 'post' as post from documents where doc_id % 3 < 2")
def _(spark, d):
    rows = compound.streams(files(spark, d))
    return _doc(streams.scripts(rows).join(streams.script_versions(rows), "doc"), "high", "low", "header", "source", "pre", "post")


@query("s27_templates", "select doc_id, source as content from documents where doc_id % 3 < 2 and doc_id % 2 = 1")
def _(spark, d):
    rows = compound.streams(files(spark, d))
    return _doc(streams.xml_templates(rows, records.file_headers(rows)), "content")


_CREATED = "strftime(timestamp '1970-01-01' + to_days((doc_id % 1000)::int), '%Y-%m-%dT09:00:00+09:00')"


@query("s28_summaries", f"select doc_id, source as title, lang as author, {_PARTS} as page_count, {_CREATED} as created from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(summary.summaries(compound.streams(files(spark, d))), "title", "author", "page_count", "created")


@query("s29_header_scan", "select doc_id, '5.1.0.' || (doc_id % 256) as version, 'plain' as status from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(documents.headers(files(spark, d)), numbers.version("version").alias("version"), "status")


@query("s30_summary_scan", "select doc_id, source as title from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(documents.summaries(files(spark, d)), "title")


@query("k05_image_rows", "select doc_id, 'BIN0001.png' as file, 'image/png' as mime, strlen(source)::bigint as size from documents where doc_id % 3 < 2")
def _(spark, d):
    items = streams.binary_items(compound.streams(files(spark, d)), records.dictionary(_info(spark, d), "bin_data"))
    return _doc(sinks.image_rows(items), "file", "mime", F.octet_length("data").cast("long").alias("size"))


@query("k06_preview_rows", "select doc_id, case when doc_id % 3 = 0 then 'preview.bmp' when doc_id % 2 = 0 then 'preview.gif' else 'preview.bin' end as file from documents where doc_id % 3 < 2")
def _(spark, d):
    return _doc(sinks.preview_rows(streams.preview_images(compound.streams(files(spark, d)))), "file")


@query("k07_header_json", "select doc_id, '{\"signature\":\"HWP Document File\",\"version\":\"5.1.0.' || (doc_id % 256) || '\",\"document_flags\":[' || array_to_string(list_filter([case when doc_id % 3 = 0 then '\"compressed\"' end, case when doc_id % 2 = 1 then '\"xml_template\"' end], lambda x: x is not null), ',') || '],\"license_flags\":[],\"encrypt_version\":4,\"kogl_country\":0}' as json from documents where doc_id % 3 < 2")
def _(spark, d):
    rows = records.file_headers(compound.streams(files(spark, d)))
    return _doc(rows, sinks.header_json(rows).alias("json"))


@query("k08_section_counts", f"select doc_id, {_PARTS} + case when doc_id % 3 < 2 then 1 else 0 end as sections from documents")
def _(spark, d):
    return _doc(documents.section_counts(spark, files(spark, d)), "sections")


@query("k02_container_texts", f"with {_L} select doc_id, string_agg(trim(line), chr(10) order by ord) as text from s where trim(line) <> '' group by doc_id")
def _(spark, d):
    return _doc(documents.plain_texts(spark, files(spark, d)), "text")


@query("k03_container_markdown", f"with {_L} select doc_id, '# HWP 문서' || chr(10) || chr(10) || chr(10) || chr(10) || '**버전**: ' || case when doc_id % 3 < 2 then '5.01.00.' || format('{{:02d}}', doc_id % 256) when doc_id % 2 = 1 then (doc_id % 7 + 1) || '.01.00.00' else '5.01.00.00' end || chr(10) || chr(10) || chr(10) || chr(10) || string_agg(trim(line), chr(10) || chr(10) order by ord) as markdown from s where trim(line) <> '' group by doc_id")
def _(spark, d):
    return _doc(documents.markdowns(spark, files(spark, d)), "markdown")


@query("f65_item_mime", "select doc_id, 'image/png' as mime, 'png' as extension from documents where doc_id % 3 < 2")
def _(spark, d):
    items = streams.binary_items(compound.streams(files(spark, d)), records.dictionary(_info(spark, d), "bin_data"))
    return _doc(items, media.mime_of_extension("extension").alias("mime"), "extension")


_PAGES = ((949, "cp949"), (1200, "utf-16-le"), (65001, "utf-8"), (1252, "cp1252"))


@query("f07_code_pages", "select p_partkey, p_name as title, p_brand as author from part")
def _(spark, d):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = []
            for size, name, brand in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                page, codec = _PAGES[size % 4]
                sets.append(writers.property_set({2: name + "\0" * (page == 1200), 4: brand + "\0" * (page == 1200)}, {}, {}, page if page < 32768 else page - 65536, codec))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(["\x05HwpSummaryInformation"] * batch.num_rows), pa.array(sets, pa.binary())], names=["doc", "name", "data"])

    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand").mapInArrow(run, "doc string, name string, data binary")
    return summary.summaries(rows).select(F.col("doc").cast("long").alias("p_partkey"), "title", "author")
