"""Property sets: the summary of a document, with texts in the code page that the set names."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.functions.media import FILETIME_EPOCH

# Properties by number.
PROPERTIES = {
    2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 8: "last_author", 9: "revision", 11: "last_printed", 12: "created", 13: "last_saved", 14: "page_count", 20: "date_text", 21: "paragraph_count",
}
_NUMBERS = ("page_count", "paragraph_count")
DDL = "doc string, " + ", ".join(f"{v} {'long' if v in _NUMBERS else 'string'}" for v in PROPERTIES.values()) + ", error string"
_CODE_PAGES = {1200: "utf-16-le", 1201: "utf-16-be", 65001: "utf-8", 949: "cp949", 1252: "cp1252"}


def decode_text(data: bytes, page: int) -> str:
    """Text up to the first NUL; unknown pages are read as UTF-8, then 1252."""
    wide = page in (1200, 1201)
    if wide:
        end = next((k for k in range(0, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), len(data) // 2 * 2)
        data = data[:end]
    else:
        data = data.split(b"\0", 1)[0]
    names = [_CODE_PAGES[page]] if page in _CODE_PAGES else ["utf-8"]
    for name in [*names, "cp1252"]:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def seoul_time(filetime: int) -> str:
    """Ticks of 100 ns since 1601 as ISO text at UTC+9; earlier than 1970 is the start of 1970."""
    if filetime < FILETIME_EPOCH:
        return "1970-01-01T00:00:00+09:00"
    from datetime import datetime, timedelta

    return (datetime(1970, 1, 1) + timedelta(seconds=(filetime - FILETIME_EPOCH) // 10_000_000, hours=9)).strftime("%Y-%m-%dT%H:%M:%S+09:00")


def read_summary(data: bytes) -> dict:
    if len(data) < 48:
        raise ValueError("property set is cut off")
    order = "<" if data[:2] == b"\xfe\xff" else ">" if data[:2] == b"\xff\xfe" else None
    if order is None:
        raise ValueError("no property set")
    start = struct.unpack_from(f"{order}I", data, 44)[0]
    _, n = struct.unpack_from(f"{order}II", data, start)
    places = [struct.unpack_from(f"{order}II", data, start + 8 + 8 * k) for k in range(min(n, (len(data) - start - 8) // 8))]
    page, out = 1252, {}
    for number, at in sorted(places):
        at += start
        if at + 6 > len(data):
            continue
        kind = struct.unpack_from(f"{order}I", data, at)[0]
        value = _value(data, at + 4, kind, order, page)
        if number == 1 and value is not None:
            page = value & 0xFFFF
        elif number in PROPERTIES and value is not None:
            name = PROPERTIES[number]
            if (name in _NUMBERS) == isinstance(value, int):
                out[name] = value
    return out


def _value(data: bytes, at: int, kind: int, order: str, page: int):
    if kind == 2:
        return struct.unpack_from(f"{order}h", data, at)[0]
    if at + 4 > len(data):
        return None
    size = struct.unpack_from(f"{order}I", data, at)[0]
    if kind == 3:
        return struct.unpack_from(f"{order}i", data, at)[0]
    if kind == 30:
        return decode_text(data[at + 4 : at + 4 + size], page)
    if kind == 31:
        return decode_text(data[at + 4 : at + 4 + 2 * size], 1200 if order == "<" else 1201)
    if kind == 64 and at + 8 <= len(data):
        a, b = struct.unpack_from(f"{order}II", data, at)
        return seoul_time((b << 32 | a) if order == "<" else (b << 32 | a))
    return None


def summaries(streams: DataFrame) -> DataFrame:
    """doc and its properties; a broken set gives an error, a missing one no row."""
    names = [*PROPERTIES.values(), "error"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(read_summary(data or b""))
                except (ValueError, struct.error) as e:
                    out.append({"error": str(e)})
            cols = [pa.array([r.get(n) for r in out], pa.int64() if n in _NUMBERS else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc", *names])

    return streams.where("name rlike 'SummaryInformation$' and data is not null").select("doc", "data").mapInArrow(run, DDL)
