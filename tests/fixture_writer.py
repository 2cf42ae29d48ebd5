"""Writers of small container files, from the published layouts, independent of the readers."""

import io
import struct
import zipfile
import zlib

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def record(tag: int, level: int, payload: bytes) -> bytes:
    size = len(payload)
    if size < 0xFFF:
        return struct.pack("<I", tag | level << 10 | size << 20) + payload
    return struct.pack("<II", tag | level << 10 | 0xFFF << 20, size) + payload


def text(s: str) -> bytes:
    return struct.pack("<H", len(s.encode("utf-16-le")) // 2) + s.encode("utf-16-le")


def deflate(data: bytes) -> bytes:
    worker = zlib.compressobj(6, zlib.DEFLATED, -15)
    return worker.compress(data) + worker.flush()


def file_header(version: int = 0x05010000, flags: int = 1) -> bytes:
    return b"HWP Document File".ljust(32, b"\0") + struct.pack("<IIIIB", version, flags, 0, 4, 0) + bytes(207)


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors: streams under 4096 bytes in the mini stream, one level of storages."""
    names: list[tuple[str, int, str | None]] = []
    for path in streams:
        head, _, name = path.rpartition("/")
        if head and (head, 1, None) not in names:
            names.append((head, 1, None))
    entries = [("Root Entry", 5, None)] + names + [(p.rpartition("/")[2], 2, p) for p in streams]
    fat: list[int] = []
    sectors: list[bytes] = []

    def put(data: bytes) -> int:
        if not data:
            return END
        first = len(sectors)
        parts = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        for k, part in enumerate(parts):
            sectors.append(part)
            fat.append(first + k + 1 if k + 1 < len(parts) else END)
        return first

    mini, mini_fat, place = b"", [], {}
    for path, data in streams.items():
        if len(data) < 4096:
            n = -(-len(data) // 64)
            place[path] = len(mini_fat) if n else END
            mini_fat += [len(mini_fat) + k + 1 for k in range(n - 1)] + ([END] if n else [])
            mini += data.ljust(n * 64, b"\0")
        else:
            place[path] = put(data)
    root_first = put(mini)
    mini_first = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // 512) * 512, b"\xff")) if mini_fat else END

    children: dict[str, list[int]] = {"": []}
    for k, (name, kind, path) in enumerate(entries):
        if kind == 1:
            children[""].append(k)
        elif kind == 2:
            children.setdefault(path.rpartition("/")[0], []).append(k)
    right = {}
    for some in children.values():
        for a, b in zip(some, some[1:]):
            right[a] = b
    out = b""
    for k, (name, kind, path) in enumerate(entries):
        raw = name.encode("utf-16-le") + b"\0\0"
        child = children[""][0] if kind == 5 and children[""] else children[name][0] if kind == 1 else FREE
        first, size = (root_first, len(mini)) if kind == 5 else (0, 0) if kind == 1 else (place[path], len(streams[path]))
        out += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, FREE, right.get(k, FREE), child) + bytes(16) + bytes(20) + struct.pack("<IQ", first, size)
    directory = put(out.ljust(-(-len(out) // 512) * 512, b"\0"))
    n_fat = 1
    while (len(sectors) + n_fat) > n_fat * 128:
        n_fat += 1
    fat_places = list(range(len(sectors), len(sectors) + n_fat))
    table = fat + [0xFFFFFFFD] * n_fat
    raw = struct.pack(f"<{len(table)}I", *table).ljust(n_fat * 512, b"\xff")
    sectors += [raw[k * 512 : (k + 1) * 512] for k in range(n_fat)]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, mini_first, -(-len(mini_fat) * 4 // 512), END, 0)
    head += struct.pack("<109I", *(fat_places + [FREE] * (109 - n_fat)))
    return head + b"".join(sectors)


def para_header(chars: int = 1, shape: int = 0) -> bytes:
    return struct.pack("<IIHBBHHHI", chars, 0, shape, 0, 0, 1, 0, 1, 7)


def section(paragraphs: list[str]) -> bytes:
    out = b""
    for p in paragraphs:
        out += record(66, 0, para_header(len(p) + 1)) + record(67, 1, p.encode("utf-16-le") + b"\r\0") + record(68, 1, struct.pack("<II", 0, 0))
    return out


def document(paragraphs: list[str], more: dict[str, bytes] | None = None) -> bytes:
    info = record(16, 0, struct.pack("<7H3I", 1, 1, 1, 1, 1, 1, 1, 0, 0, 0))
    info += record(19, 1, b"\0" + text("바탕")) + record(26, 1, text("본문") + text("Body") + struct.pack("<BBhHH", 0, 0, 1042, 3, 5))
    streams = {"FileHeader": file_header(), "DocInfo": deflate(info), "BodyText/Section0": deflate(section(paragraphs))}
    return compound(streams | (more or {}))


def package(sections: dict[str, str], more: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/hwp+zip")
        for name, xml in sections.items():
            z.writestr(f"Contents/{name}.xml", xml)
        for name, data in (more or {}).items():
            z.writestr(name, data)
    return out.getvalue()
