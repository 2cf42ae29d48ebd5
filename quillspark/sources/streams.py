"""Smaller streams of a compound document: previews, scripts, XML templates, binary items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import bits, media
from quillspark.plans import intervals
from quillspark.sources.compound import inflated
from quillspark.sources.layouts import read, utf16


def preview_text(streams: DataFrame) -> DataFrame:
    """doc, ``text``; null where the bytes are no UTF-16."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            text = [utf16(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc", "text"])

    return streams.where("name = 'PrvText'").select("doc", "data").mapInArrow(run, "doc string, text string")


def preview_images(streams: DataFrame) -> DataFrame:
    return streams.where("name = 'PrvImage'").select("doc", media.preview_format("data").alias("format"), F.base64("data").alias("image"))


def _texts(streams: DataFrame, where: str, names: list[str]) -> DataFrame:
    """doc, name and so many texts of a stream, each after its length (u32, in units); missing ones are null."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for data in batch.column(2).to_pylist():
                data, at, row = data or b"", 0, []
                for _ in names:
                    size = int.from_bytes(data[at : at + 4], "little") if at + 4 <= len(data) else None
                    whole = size is not None and at + 4 + 2 * size <= len(data)
                    row.append(utf16(data[at + 4 : at + 4 + 2 * size]) if whole else None)
                    at = at + 4 + 2 * size if whole else len(data) + 1
                out.append(row)
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in cols)], names=["doc", "name", *names])

    rows = inflated(streams.where(where).select("doc", "name", "data", "compressed")).select("doc", "name", "data")
    return rows.mapInArrow(run, "doc string, name string, " + ", ".join(f"`{n}` string" for n in names))


def scripts(streams: DataFrame) -> DataFrame:
    return _texts(streams, "name = 'Scripts/DefaultJScript'", ["header", "source", "pre", "post"])


def script_versions(streams: DataFrame) -> DataFrame:
    rows = inflated(streams.where("name = 'Scripts/JScriptVersion'").select("doc", "data", "compressed"))
    return rows.select("doc", bits.little_endian("data", 0, 4).alias("high"), bits.little_endian("data", 4, 4).alias("low"))


def xml_templates(streams: DataFrame, headers: DataFrame) -> DataFrame:
    """The templates of documents whose header says that they have some."""
    marked = headers.where(bits.has_bit("document_flags", 5)).select("doc")
    return _texts(streams, "name like 'XMLTemplate/%'", ["content"]).join(marked, "doc", "left_semi")


def candidates(index: F.Column, extension: F.Column) -> F.Column:
    """Names under which a binary item may be stored, the likeliest first; with an extension two more."""
    bare = F.concat(F.lit("BIN"), F.format_string("%04X", index.cast("long")))
    folders = ("BinData/", "Root Entry/BinData/")
    names = F.array(*[F.concat(F.lit(f), bare) for f in folders], bare)
    full = F.concat(bare, F.lit("."), extension)
    return F.when(extension.isNull(), names).otherwise(F.concat(names, F.array(*[F.concat(F.lit(f), full) for f in folders])))


def binary_items(streams: DataFrame, bin_data: DataFrame) -> DataFrame:
    """bin_data: records.dictionary of kind bin_data. doc, ``index``, ``name``, ``extension``, ``data`` of items that are embedded or
    stored, from the first candidate that is there and not empty; links have none. An item that does not inflate stays as it is."""
    rows = bin_data.where("kind <> 'link' and error is null").select("doc", "seq", F.col("binary_id").alias("index"), "extension")
    wanted = rows.select("*", F.posexplode(candidates(F.col("index"), F.col("extension"))).alias("rank", "name"))
    there = streams.where("name rlike '(^|/)BIN[0-9A-F]{4}' and length(data) > 0").select("doc", "name", "data")
    found = intervals.first_candidate(wanted, there, ["doc", "seq"], "name", "rank")
    return inflated(found.select("doc", "index", "name", "extension", "data"), keep=True).drop("error")


def length_prefixed(data: bytes, at: int) -> tuple[str | None, int]:
    """Text after its length in units (u16) at a place of a record, and where it ends."""
    value, after, _ = read(data, at, "str")
    return value, after
