"""Compound files: from bytes to named streams, by the published layout of the container.

A file is sectors chained by a table (FAT); small streams live in a stream of their own with a second table. Every chain is
followed with a bound, so a broken or hostile file ends in an error of its own and never in a loop.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.batches import bounded

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Largest size that a compressed stream may have when inflated.
INFLATED = 512 << 20
STREAMS = "doc string, name string, data binary, error string, compressed boolean"


class CompoundError(ValueError):
    pass


def _chain(table: list[int], first: int) -> Iterator[int]:
    seen = 0
    while first < 0xFFFFFFFA:
        if first >= len(table) or seen > len(table):
            raise CompoundError("broken sector chain")
        yield first
        first, seen = table[first], seen + 1


def read_compound(data: bytes, wanted: str | None = None) -> dict[str, bytes]:
    """Streams by path (``/`` between storages, without the root). wanted: a pattern of paths; others are not put together."""
    if len(data) < 512 or data[:8] != MAGIC:
        raise CompoundError("not a compound file")
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    if sector not in (512, 4096) or mini > sector:
        raise CompoundError("unknown sector size")
    n_fat, directory, cutoff, mini_first, n_mini, more, n_more = struct.unpack_from("<I I 4x I I I I I", data, 44)

    def at(k: int) -> bytes:
        low = (k + 1) * sector
        if low >= len(data):
            raise CompoundError("sector beyond the end")
        return data[low : low + sector].ljust(sector, b"\0")

    fat_places = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
    for _ in range(n_more):
        if more >= 0xFFFFFFFA:
            break
        *some, more = struct.unpack(f"<{sector // 4}I", at(more))
        fat_places += [x for x in some if x < 0xFFFFFFFA]
    fat: list[int] = []
    for k in fat_places[:n_fat]:
        fat += struct.unpack(f"<{sector // 4}I", at(k))

    def stream(first: int) -> bytes:
        return b"".join(at(k) for k in _chain(fat, first))

    entries = stream(directory)
    nodes = []
    for low in range(0, len(entries) - 127, 128):
        size, kind = struct.unpack_from("<HB", entries, low + 64)
        left, right, child = struct.unpack_from("<III", entries, low + 68)
        first, length = struct.unpack_from("<IQ", entries, low + 116)
        name = entries[low : low + max(0, min(64, size) - 2)].decode("utf-16-le", "replace")
        nodes.append((name, kind, left, right, child, first, length if sector == 4096 else length & 0xFFFFFFFF))
    if not nodes or nodes[0][1] != 5:
        raise CompoundError("no root entry")
    mini_fat = [x for k in _chain(fat, mini_first) for x in struct.unpack(f"<{sector // 4}I", at(k))] if n_mini else []
    small = stream(nodes[0][5]) if nodes[0][5] < 0xFFFFFFFA else b""
    out: dict[str, bytes] = {}
    todo, seen = [(nodes[0][4], "")], set()
    while todo:
        k, path = todo.pop()
        if k >= len(nodes) or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, first, length = nodes[k]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2 and (wanted is None or re.fullmatch(wanted, path + name)):
            if length < cutoff:
                body = b"".join(small[x * mini : (x + 1) * mini] for x in _chain(mini_fat, first)) if length else b""
            else:
                body = stream(first)
            if len(body) < length:
                raise CompoundError(f"stream {name} is cut off")
            out[path + name] = body[:length]
    return out


def inflate(data: bytes, raw: bool = True) -> bytes:
    """zlib or bare deflate; bounded, so that a small file cannot fill the memory. A stream that is cut off is an error."""
    worker = zlib.decompressobj(-15 if raw else 15)
    try:
        out = worker.decompress(data, INFLATED)
    except zlib.error as e:
        raise CompoundError(str(e)) from None
    if worker.unconsumed_tail:
        raise CompoundError("inflated stream is too large")
    if not worker.eof:
        raise CompoundError("compressed stream is cut off")
    return out


def is_compressed(header: bytes | None) -> bool:
    """Bit 0 of the flags in a file header; documents without one count as compressed."""
    return len(header or b"") < 40 or bool(header[36] & 1)


def streams(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """files: ``path``, ``content`` (as the binaryFile source gives). One row a stream: ``doc``, ``name``, ``data``, ``error``,
    ``compressed`` (what the document's header says). wanted: a pattern of names, so that others are not read.

    Files that are no compound files are left out; one that is broken gives one row with an error. Null content is left out.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = read_compound(content.as_py(), f"FileHeader|{wanted}" if wanted else None)
                    packed = is_compressed(found.get("FileHeader"))
                    rows = [(path, k, v, None, packed) for k, v in found.items() if not wanted or re.fullmatch(wanted, k)]
                except (CompoundError, struct.error) as e:
                    rows = [(path, None, None, str(e), None)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_()), strict=True)], names=["doc", "name", "data", "error", "compressed"])

    bounded(files.sparkSession)
    magic = F.substring("content", 1, 8) == F.lit(MAGIC)
    return files.where(magic).select("path", "content").mapInArrow(run, STREAMS)


def nested(rows: DataFrame, storage: str, stream: str) -> DataFrame:
    """rows of streams() below a storage whose name matches; a path that starts at ``Root Entry`` counts where the plain one is missing."""
    found = rows.where(F.col("name").rlike(f"^(Root Entry/)?{storage}/{stream}$"))
    plain = F.regexp_replace("name", "^Root Entry/", "")
    first = F.row_number().over(Window.partitionBy("doc", "_plain").orderBy(F.length("name")))
    return found.withColumn("_plain", plain).withColumn("_n", first).where("_n = 1").withColumn("name", F.col("_plain")).drop("_plain", "_n")


def inflated(rows: DataFrame, raw: bool = True, keep: bool = False) -> DataFrame:
    """rows with ``data``: the same with ``data`` inflated, and ``error`` (with null data) where that fails. Rows whose ``compressed``
    is false stay as they are. With ``keep`` the bytes stay instead of an error, as writers leave some items bare."""
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    place, noted = rows.columns.index("data"), rows.columns.index("error")
    packed = rows.columns.index("compressed") if "compressed" in rows.columns else None

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            flags = batch.column(packed).to_pylist() if packed is not None else [None] * batch.num_rows
            for k, (flag, error) in enumerate(zip(flags, batch.column(noted).to_pylist(), strict=True)):
                row = batch.slice(k, 1)
                data = row.column(place)[0].as_py()
                if data is not None and flag is not False:
                    try:
                        data = inflate(data, raw)
                    except CompoundError as e:
                        data, error = (data, error) if keep else (None, str(e))
                row = row.set_column(place, batch.schema.field(place), pa.array([data], pa.binary()))
                yield row.set_column(noted, batch.schema.field(noted), pa.array([error], pa.string()))

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)
