"""Writers of containers: bytes of compound files, packages, record streams and property sets, by their published layouts.

They share nothing with the readers, so that what one side gets wrong the other does not repeat.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

_FREE, _END, _FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
_SECTOR, _SMALL, _CUTOFF = 512, 64, 4096


def record(tag: int, level: int, payload: bytes) -> bytes:
    """A record of a stream; sizes from 4095 on stand behind the head."""
    size = len(payload)
    head = struct.pack("<I", tag | level << 10 | min(size, 0xFFF) << 20)
    return head + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def string(text: str, count: str = "<H") -> bytes:
    """UTF-16 text after its length in units."""
    raw = text.encode("utf-16-le")
    return struct.pack(count, len(raw) // 2) + raw


def deflate(data: bytes) -> bytes:
    worker = zlib.compressobj(6, zlib.DEFLATED, -15)
    return worker.compress(data) + worker.flush()


def file_header(version: int, flags: int) -> bytes:
    return b"HWP Document File".ljust(32, b"\0") + struct.pack("<IIIIB", version, flags, 0, 4, 0) + bytes(207)


def paragraph(text: str, level: int = 0, mask: int = 0, divide: int = 0, shape: int = 0, instance: int = 0, style: int = 0) -> bytes:
    """Header, text and style run of a paragraph without controls."""
    head = struct.pack("<IIHBBHHHI", len(text) + 1, mask, shape, style, divide, 1, 0, 0, instance)
    return record(66, level, head) + record(67, level + 1, text.encode("utf-16-le") + b"\r\0") + record(68, level + 1, struct.pack("<II", 0, 0))


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; ``/`` parts one level of storages from streams. Streams under 4096 bytes are in the small
    stream."""
    storages = list(dict.fromkeys(p.rpartition("/")[0] for p in streams if "/" in p))
    entries = [("Root Entry", 5, ""), *((s, 1, "") for s in storages), *((p.rpartition("/")[2], 2, p) for p in streams)]
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first, n = len(sectors), -(-len(data) // _SECTOR)
        for k in range(n):
            sectors.append(data[k * _SECTOR : (k + 1) * _SECTOR].ljust(_SECTOR, b"\0"))
            fat.append(first + k + 1 if k < n - 1 else _END)
        return first if n else _END

    small, small_fat, at = b"", [], {}
    for path, data in streams.items():
        if len(data) >= _CUTOFF:
            at[path] = put(data)
            continue
        n = -(-len(data) // _SMALL)
        at[path] = len(small_fat) if n else _END
        small_fat += [*range(len(small_fat) + 1, len(small_fat) + n), _END] if n else []
        small += data.ljust(n * _SMALL, b"\0")
    small_at = put(small)
    table = b"".join(struct.pack("<I", x) for x in small_fat)
    table_at, n_table = put(table.ljust(-(-len(table) // _SECTOR) * _SECTOR, b"\xff")), -(-len(table) // _SECTOR)
    inside: dict[str, list[int]] = {"": [k for k, e in enumerate(entries) if e[1] == 1 or (e[1] == 2 and "/" not in e[2])]}
    for s in storages:
        inside[s] = [k for k, e in enumerate(entries) if e[1] == 2 and e[2].rpartition("/")[0] == s]
    after = {a: b for some in inside.values() for a, b in zip(some, some[1:], strict=False)}
    directory = b""
    for k, (name, kind, path) in enumerate(entries):
        child = inside.get("" if kind == 5 else name, []) if kind != 2 else []
        first, size = (small_at, len(small)) if kind == 5 else (0, 0) if kind == 1 else (at[path], len(streams[path]))
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, _FREE, after.get(k, _FREE), child[0] if child else _FREE) + bytes(36) + struct.pack("<IQ", first, size)
    directory_at = put(directory)
    n_fat = 1
    while len(sectors) + n_fat > n_fat * (_SECTOR // 4):
        n_fat += 1
    places = range(len(sectors), len(sectors) + n_fat)
    whole = struct.pack(f"<{len(fat) + n_fat}I", *fat, *[_FAT] * n_fat).ljust(n_fat * _SECTOR, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, n_fat, directory_at, 0, _CUTOFF, table_at, n_table, _END, 0)
    return head + struct.pack("<109I", *places, *[_FREE] * (109 - n_fat)) + b"".join(sectors) + whole


def package(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def property_set(texts: dict[int, str], numbers: dict[int, int], times: dict[int, int], page: int = 949, codec: str = "cp949") -> bytes:
    """A summary: texts in a code page, whole numbers, file times."""
    values = {1: struct.pack("<Ihh", 2, page, 0)}
    for k, text in texts.items():
        raw = text.encode(codec) + b"\0"
        values[k] = struct.pack("<II", 30, len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    values |= {k: struct.pack("<Ii", 3, v) for k, v in numbers.items()} | {k: struct.pack("<IQ", 64, v) for k, v in times.items()}
    at, table, body = 8 + 8 * len(values), b"", b""
    for k, v in values.items():
        table += struct.pack("<II", k, at + len(body))
        body += v
    return b"\xfe\xff\0\0" + bytes(20) + struct.pack("<I", 1) + bytes(16) + struct.pack("<III", 48, at + len(body), len(values)) + table + body
