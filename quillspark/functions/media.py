"""File formats, image types, names of binary items, file times."""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPOUND_MAGIC, PACKAGE_MAGIC = "D0CF11E0A1B11AE1", "504B0304"
# MIME types by extension, of records' items and, with more kinds, of packages' items.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp"}
PACKAGE_MIME = MIME | {"svg": "image/svg+xml", "webp": "image/webp", "tiff": "image/tiff", "tif": "image/tiff", "ico": "image/x-icon", "emf": "image/emf", "wmf": "image/wmf"}
FILETIME_EPOCH = 116_444_736_000_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sniff(content: Column | str) -> Column:
    """``compound``, ``package`` or ``unknown`` from the first bytes."""
    head = F.hex(F.substring(_c(content), 1, 8))
    return F.when(head == COMPOUND_MAGIC, "compound").when(F.substring(head, 1, 8) == PACKAGE_MAGIC, "package").otherwise("unknown")


def preview_format(content: Column | str) -> Column:
    head = F.substring(_c(content), 1, 6)
    return F.when(F.hex(F.substring(head, 1, 2)) == "424D", "BMP").when(F.hex(head).isin("474946383761", "474946383961"), "GIF").otherwise("UNKNOWN")


def mime_of_base64(text: Column | str) -> Column:
    text = _c(text)
    return F.when(text.startswith("iVBORw"), "image/png").when(text.startswith("/9j/"), "image/jpeg").when(text.startswith("Qk"), "image/bmp").otherwise("image/jpeg")


def _mime(extension: Column | str, known: dict[str, str], default: str) -> Column:
    out = None
    name = F.lower(_c(extension))
    for k, v in known.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out.otherwise(default)


def mime_of_extension(extension: Column | str) -> Column:
    """Of an item that a record names; others count as JPEG."""
    return _mime(extension, MIME, "image/jpeg")


def package_mime(extension: Column | str) -> Column:
    """Of an item of a package; others are bytes of no known kind."""
    return _mime(extension, PACKAGE_MIME, "application/octet-stream")


def item_name(index: Column | str, extension: Column | str) -> Column:
    """File name of a binary item."""
    return F.concat(F.lit("BIN"), F.format_string("%04X", _c(index).cast("long")), F.lit("."), F.coalesce(_c(extension), F.lit("jpg")))


def filetime_seconds(filetime: Column | str) -> Column:
    """Unix seconds; times before 1970 count as 0."""
    since = _c(filetime).cast("long") - FILETIME_EPOCH
    return F.when(since < 0, F.lit(0)).otherwise((since - since % 10_000_000) / 10_000_000).cast("long")


def seoul_text(seconds: Column | str) -> Column:
    """Unix seconds as ISO text at UTC+9, whatever the session's time zone."""
    days = F.floor((_c(seconds) + 32_400) / 86_400).cast("int")
    rest = (_c(seconds) + 32_400).cast("long") - days.cast("long") * 86_400
    clock = F.format_string("T%02d:%02d:%02d+09:00", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"), clock)


def data_uri(content: Column | str, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(_c(content)))


def image_markdown(target: Column) -> Column:
    return F.concat(F.lit("![이미지]("), target, F.lit(")"))


def relative_folder(image_dir: str, html_dir: str) -> str:
    """Path of the images as the page sees it; both are options, so this is computed once."""
    return os.path.relpath(image_dir, html_dir)
