"""Joins of decoded rows with the tables of their document.

Dictionaries hold ``idx``, an entry's place from 0 within its document, as records.dictionary gives it. All joins are left to the
optimiser's checked broadcasts; a row whose entry is missing keeps nulls or the default that is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import media

# Fixed value: the font of styles whose font is unknown.
DEFAULT_FONT = "함초롬바탕"


def look_up(rows: DataFrame, entries: DataFrame, index: Column, columns: dict[str, str], key: str = "doc") -> DataFrame:
    """Adds columns (name in entries: name in the result) of the entry of the same document whose place is ``index``."""
    wanted = entries.select(F.col(key).alias("_key"), F.col("idx").alias("_idx"), *[F.col(a).alias(b) for a, b in columns.items()])
    found = rows.withColumn("_at", index.cast("long"))
    return found.join(wanted, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_idx")), "left").drop("_key", "_idx", "_at")


def with_char_shape(runs: DataFrame, shapes: DataFrame, columns: list[str], fonts: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """runs: key, ``shape_id``. Adds columns of the character shape, and with fonts (key, idx, ``name``) the ``font`` of its first
    language, the default one where there is none. shapes: key, idx, the columns, and ``font_id`` if there are fonts."""
    out = look_up(runs, shapes, F.col("shape_id"), {c: c for c in columns} | ({"font_id": "_font"} if fonts is not None else {}), key)
    if fonts is None:
        return out
    out = look_up(out, fonts, F.col("_font"), {"name": "font"}, key).drop("_font")
    return out.withColumn("font", F.coalesce("font", F.lit(DEFAULT_FONT)))


def with_para_shape(paragraphs: DataFrame, shapes: DataFrame, columns: list[str], key: str = "doc") -> DataFrame:
    """paragraphs: key, ``para_shape_id``. Adds columns of the paragraph shape and ``class``: ``ps`` and its number, empty if it is missing."""
    out = look_up(paragraphs, shapes.withColumn("_known", F.lit(True)), F.col("para_shape_id"), {c: c for c in columns} | {"_known": "_known"}, key)
    return out.withColumn("class", F.when(F.col("_known"), F.concat(F.lit("ps"), F.col("para_shape_id").cast("string"))).otherwise(F.lit(""))).drop("_known")


def with_style(paragraphs: DataFrame, styles: DataFrame, key: str = "doc") -> DataFrame:
    """paragraphs: key, ``style_id``. Adds ``style``: the local name."""
    return look_up(paragraphs, styles, F.col("style_id"), {"local_name": "style"}, key)


def with_numbering(paragraphs: DataFrame, numberings: DataFrame, key: str = "doc") -> DataFrame:
    """paragraphs: key, ``number_bullet_id``, ``level`` (from 0). Adds ``format``: that of the numbering's level, null where the document
    has no such numbering or level. numberings: key, idx, ``formats`` (array)."""
    out = look_up(paragraphs, numberings, F.col("number_bullet_id"), {"formats": "_formats"}, key)
    return out.withColumn("format", F.get("_formats", F.col("level").cast("int"))).drop("_formats")


def with_border(cells: DataFrame, fills: DataFrame, columns: list[str], zone: Column | None = None, key: str = "doc") -> DataFrame:
    """cells: key, ``border_fill_id``, ``table_fill_id``. Adds columns of the border fill: that of the zone if it has one, else the cell's
    own, else the table's. Identifiers count from 1, 0 is none."""
    choices = [c for c in (zone, F.col("border_fill_id"), F.col("table_fill_id")) if c is not None]
    chosen = F.coalesce(*[F.nullif(c.cast("long"), F.lit(0).cast("long")) for c in choices])
    return look_up(cells, fills, chosen - 1, {c: c for c in columns}, key)


def with_item(pictures: DataFrame, items: DataFrame, key: str = "doc") -> DataFrame:
    """pictures: key, ``bindata_id``; items: key, ``index``, ``seq``, ``extension``. Adds ``extension``, ``item_seq`` of the first item with
    that number; pictures without one go."""
    first = items.groupBy(F.col(key).alias("_key"), F.col("index").alias("_index")).agg(F.min_by("extension", "seq").alias("extension"), F.min("seq").alias("item_seq"))
    return pictures.join(first, (F.col(key) == F.col("_key")) & (F.col("bindata_id") == F.col("_index"))).drop("_key", "_index")


def with_named_item(images: DataFrame, items: DataFrame, key: str = "doc") -> DataFrame:
    """images: key, ``text`` (the reference of a package's image); items: package.binary_items(). Adds ``index``, ``extension`` of the
    item with that name; images without one go."""
    first = items.groupBy(F.col(key).alias("_key"), F.col("stem").alias("_stem")).agg(F.min("index").alias("index"), F.min_by("extension", "index").alias("extension"))
    return images.join(first, (F.col(key) == F.col("_key")) & (F.col("text") == F.col("_stem"))).drop("_key", "_stem")


def with_kind(items: DataFrame, bin_data: DataFrame, key: str = "doc") -> DataFrame:
    """items: key, ``bindata_id``; bin_data: key, ``binary_id``, ``extension``. Adds ``extension`` (``jpg`` where no embedded record names
    one) and ``mime``."""
    known = bin_data.groupBy(F.col(key).alias("_key"), F.col("binary_id").alias("_id")).agg(F.first("extension", ignorenulls=True).alias("_extension"))
    out = items.join(known, (F.col(key) == F.col("_key")) & (F.col("bindata_id") == F.col("_id")), "left")
    out = out.withColumn("extension", F.coalesce("_extension", F.lit("jpg"))).drop("_key", "_id", "_extension")
    return out.withColumn("mime", media.mime_of_extension("extension"))


def with_contents(cells: DataFrame, by_place: DataFrame, by_index: DataFrame, columns: Column, key: str = "doc") -> DataFrame:
    """cells: key, ``row``, ``col``. Adds ``content``: that which stands at their place, else at their index by rows of ``columns``.
    by_place: key, ``row``, ``col``, ``content``; by_index: key, ``place``, ``content``. Of several the smallest counts."""
    placed = by_place.groupBy(key, "row", "col").agg(F.min("content").alias("_placed"))
    listed = by_index.groupBy(key, F.col("place").alias("_place")).agg(F.min("content").alias("_listed"))
    out = cells.withColumn("_place", F.col("row") * columns + F.col("col"))
    out = out.join(placed, [key, "row", "col"], "left").join(listed, [key, "_place"], "left")
    return out.withColumn("content", F.coalesce("_placed", "_listed")).drop("_placed", "_listed", "_place")


def outside(images: DataFrame, inside: DataFrame, keys: list[str]) -> DataFrame:
    """Images that none of the cells' images repeats."""
    return images.join(inside.select(*keys).distinct(), keys, "left_anti")


def first_row(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each document: its first page definition, or its first control of a kind."""
    first = F.min_by(F.struct(*columns), order).alias("_first")
    return rows.groupBy(key).agg(first).select(key, *[F.col("_first")[c].alias(c) for c in columns])


def note_shapes(shapes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first shape of a document's notes is that of footnotes, the second that of endnotes, or the first again: key, ``footnote``,
    ``endnote`` (structs)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    ranked = shapes.select(key, n.alias("_n"), F.struct(*columns).alias("_shape")).where("_n <= 2")
    out = ranked.groupBy(key).agg(F.max_by("_shape", -F.col("_n")).alias("footnote"), F.max_by("_shape", "_n").alias("endnote"))
    return out


def distinct_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, ``texts``: the different trimmed texts of a subtree, sorted; blank ones count as none."""
    from quillspark.functions import text as T

    shown = T.trim(text)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(F.when(shown != "", shown))).alias("texts"))


def shares_text(left: Column, right: Column) -> Column:
    """Whether two sets of texts have one in common."""
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))
