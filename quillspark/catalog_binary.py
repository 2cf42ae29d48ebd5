"""Queries that decode binary records: payloads are packed from table columns in the JVM, framed, read back, and compared by SQL
with the columns that they were packed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import grid_cells, lines, query, table
from quillspark.catalog import _CELLS, _LEVELS, _LINES, _levelled  # noqa: PLC2701
from quillspark.operators import documents
from quillspark.sources import functions, records
from quillspark.sources.layouts import BODY_TAGS, DOC_TAGS, FIRST

_TAGS = DOC_TAGS | BODY_TAGS
#: Records of document-wide tables that stand one level down.
ONE_DOWN = ("bin_data", "face_name", "border_fill", "char_shape", "tab_def", "numbering", "bullet", "para_shape", "style", "layout_compatibility", "track_change_info", "track_change_content", "track_change_author")


def le(value: Column | str | int, size: int) -> Column:
    """Little-endian bytes of a number (two's complement)."""
    v = (F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value).cast("long")
    big = F.lpad(F.hex(v.bitwiseAND(F.lit((1 << 8 * size) - 1)) if size < 8 else v), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(big, 2 * (size - k) - 1, 2) for k in range(size)]))


def utf16_units(s: Column) -> Column:
    return F.encode(s, "UTF-16LE")


def framed(rows: DataFrame, doc: Column, order: str, kind: str, level: Column | int, payload: Column) -> DataFrame:
    """One stream a doc of records of one kind in order, read back by the framing operator."""
    level = F.lit(level) if isinstance(level, int) else level
    size = F.octet_length(payload)
    short = F.least(size, F.lit(0xFFF))
    head = le(F.lit(FIRST + _TAGS[kind]).cast("long") + level.cast("long") * 1024 + short.cast("long") * 1048576, 4)
    one = F.concat(head, F.when(size >= 0xFFF, le(size.cast("long"), 4)).otherwise(F.unhex(F.lit(""))), payload)
    rows = rows.select(doc.cast("string").alias("doc"), F.lit("stream").alias("name"), F.col(order).alias("o"), F.hex(one).alias("h"))
    parts = F.array_sort(F.collect_list(F.struct("o", "h")))
    streams = rows.groupBy("doc", "name").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("data"))
    return records.records(streams)


def typed(spark: SparkSession, rows: DataFrame, key: str, order: str, kind: str, payload: Column) -> DataFrame:
    level = 1 if kind in ONE_DOWN else 0
    return records.typed(framed(rows, F.col(key), order, kind, level, payload), kind).withColumn(key, F.col("doc").cast("long"))


@query("d04_framing", f"select doc_id, ord::bigint as seq, 67 as tag, level, (2 * length(line))::bigint as size from ({_LEVELS})")
def _(spark, d):
    rows = _levelled(spark, d)
    out = framed(rows, F.col("doc_id"), "ord", "para_text", F.col("level"), utf16_units(F.col("line")))
    return out.select(F.col("doc").cast("long").alias("doc_id"), "seq", "tag", "level", "size")


@query("d05_record_tree", f"with l as ({_LEVELS}) select doc_id, ord::bigint as seq, (select max(p.ord) from l p where p.doc_id = l.doc_id and p.ord < l.ord and p.level < l.level)::bigint as parent from l")
def _(spark, d):
    out = records.tree(framed(_levelled(spark, d), F.col("doc_id"), "ord", "para_text", F.col("level"), utf16_units(F.col("line"))))
    return out.select(F.col("doc").cast("long").alias("doc_id"), "seq", "parent")


@query("d32_para_text", f"select doc_id, ord::bigint as seq, x || case when ord % 2 = 0 then '-' || x else chr(9) end as shown from (select doc_id, ord, replace(line, chr(9), ' ') as x from ({_LINES}))")
def _(spark, d):
    rows = lines(spark, d).withColumn("line", F.replace("line", F.lit("\t"), F.lit(" ")))
    tab = F.concat(le(9, 2), le(600, 4), F.unhex(F.lit("00" * 8)), le(9, 2))
    payload = F.concat(utf16_units(F.col("line")), F.when(F.col("ord") % 2 == 0, F.concat(le(24, 2), utf16_units(F.col("line")))).otherwise(tab), le(13, 2))
    out = records.typed(framed(rows, F.col("doc_id"), "ord", "para_text", 0, payload), "para_text")
    return out.select(F.col("doc").cast("long").alias("doc_id"), "seq", documents.text_of_runs(F.col("runs")).alias("shown"))


@query("d30_para_header", f"select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as seq, l_partkey as chars, l_suppkey::int as para_shape_id, l_linenumber as style_id, l_linenumber & 1 = 1 as divide_section, (l_linenumber >> 2) & 1 = 1 as divide_page, l_partkey * 3 as instance_id from {_CELLS}")
def _(spark, d):
    payload = F.concat(le("l_partkey", 4), le(0, 4), le("l_suppkey", 2), le("l_linenumber", 1), le("l_linenumber", 1), le(1, 2), le(2, 2), le(3, 2), le(F.col("l_partkey") * 3, 4))
    out = typed(spark, grid_cells(spark, d), "l_orderkey", "l_linenumber", "para_header", payload)
    return out.select("l_orderkey", "seq", "chars", "para_shape_id", "style_id", "divide_section", "divide_page", "instance_id")


@query("d16_char_shape", f"select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as seq, (l_quantity * 100)::int as base_size, l_partkey % 2 = 1 as italic, (l_partkey >> 1) & 1 = 1 as bold, ((l_partkey >> 2) & 3)::int as underline_type, l_partkey * 40503 % 16777216 as text_color, (-l_linenumber)::int as spacing, (l_suppkey % 65536)::int as border_fill_id from {_CELLS}")
def _(spark, d):
    seven = lambda c, n: F.concat(*[le(c, n) for _ in range(7)])
    payload = F.concat(
        seven("l_linenumber", 2), seven(100, 1), seven(-F.col("l_linenumber"), 1), seven(100, 1), seven(0, 1), le((F.col("l_quantity") * 100).cast("long"), 4), le("l_partkey", 4), le(0, 1), le(0, 1),
        le(F.col("l_partkey") * 40503 % 16777216, 4), le(0, 4), le(0, 4), le(0, 4), le("l_suppkey", 2),
    )
    out = typed(spark, grid_cells(spark, d), "l_orderkey", "l_linenumber", "char_shape", payload)
    return out.select("l_orderkey", "seq", "base_size", "italic", "bold", "underline_type", "text_color", F.col("spacing")[0].alias("spacing"), "border_fill_id")


@query("d38_cells", f"select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as seq, (l_partkey % 7)::int as col, (l_suppkey % 5)::int as \"row\", l_partkey * 10 as width, case l_partkey % 3 when 0 then 'top' when 1 then 'center' else 'bottom' end as vertical_align from {_CELLS}")
def _(spark, d):
    payload = F.concat(le(1, 2), le(0, 2), le(F.col("l_partkey") % 3 * 32, 4), le(F.col("l_partkey") % 7, 2), le(F.col("l_suppkey") % 5, 2), le(1, 2), le(1, 2), le(F.col("l_partkey") * 10, 4), le(100, 4), le(-1, 2), le(-2, 2), le(3, 2), le(4, 2), le(5, 2))
    out = typed(spark, grid_cells(spark, d), "l_orderkey", "l_linenumber", "list_header", payload)
    return out.select("l_orderkey", "seq", "cell.col", "cell.row", "cell.width", "vertical_align")


@query("d34_line_segs", "select l_orderkey, count(*) as n, sum(l_partkey - 500)::bigint as verticals, max(l_suppkey)::int as widest from " + _CELLS + " group by l_orderkey")
def _(spark, d):
    cells = grid_cells(spark, d)
    one = F.hex(F.concat(le("l_linenumber", 4), le(F.col("l_partkey") - 500, 4), le(10, 4), le(10, 4), le(8, 4), le(2, 4), le(0, 4), le("l_suppkey", 4), le(0, 4)))
    rows = cells.groupBy("l_orderkey").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("h")))), lambda p: p["h"]), "")).alias("p")).withColumn("o", F.lit(0))
    out = typed(spark, rows, "l_orderkey", "o", "para_line_seg", F.col("p"))
    s = F.explode("segments")
    return out.select("l_orderkey", s.alias("s")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s.vertical").alias("verticals"), F.max("s.width").alias("widest"))


@query("d60_controls", f"select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as seq, case l_linenumber % 3 when 0 then 'tbl ' when 1 then 'gso ' else 'atno' end as ctrl_id, l_partkey * 10 as width, (-l_suppkey)::int as offset_y, l_partkey & 1 = 1 as like_letters, case least((l_partkey >> 3) & 3, 2) when 0 then 'paper' when 1 then 'page' else 'para' end as vert_rel_to from {_CELLS} qualify l_linenumber % 3 < 2")
def _(spark, d):
    ident = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" lbt")).when(F.col("l_linenumber") % 3 == 1, F.lit(" osg")).otherwise(F.lit("onta")).cast("binary")
    payload = F.concat(ident, le("l_partkey", 4), le(-F.col("l_suppkey"), 4), le(0, 4), le(F.col("l_partkey") * 10, 4), le(100, 4), le(0, 4), le(1, 2), le(2, 2), le(3, 2), le(4, 2), le(7, 4), le(0, 4))
    out = records.controls(framed(grid_cells(spark, d), F.col("l_orderkey"), "l_linenumber", "ctrl_header", 1, payload), "object_common")
    return out.select(F.col("doc").cast("long").alias("l_orderkey"), "seq", "ctrl_id", "width", "offset_y", "like_letters", "vert_rel_to")


@query("d21_styles", "select p_partkey, 'S' || p_name as local_name, p_brand as english_name, case p_size % 8 when 0 then 'paragraph' when 1 then 'character' else 'other' end as kind, (p_size % 100)::int as para_shape_id from part")
def _(spark, d):
    string = lambda c: F.concat(le(F.length(c), 2), utf16_units(c))
    rows = table(spark, d, "part").withColumn("o", F.lit(0))
    payload = F.concat(string(F.concat(F.lit("S"), "p_name")), string(F.col("p_brand")), le(F.col("p_size") % 8, 1), le(1, 1), le(1042, 2), le(F.col("p_size") % 100, 2), le(3, 2))
    out = typed(spark, rows, "p_partkey", "o", "style", payload)
    return out.select("p_partkey", "local_name", "english_name", "kind", "para_shape_id")


@query("d39_page_defs", "select o_orderkey, o_custkey as paper_width, o_orderkey as paper_height, case when o_custkey % 2 = 1 then 'horizontal' else 'vertical' end as direction, round(o_custkey / 7200.0 * 25.4, 6) as width_mm from orders")
def _(spark, d):
    payload = F.concat(le("o_custkey", 4), le("o_orderkey", 4), *[le(k, 4) for k in range(7)], le(F.col("o_custkey") % 2, 4))
    out = typed(spark, table(spark, d, "orders").withColumn("o", F.lit(0)), "o_orderkey", "o", "page_def", payload)
    return out.select("o_orderkey", "paper_width", "paper_height", "direction", F.round(F.col("paper_width") / 7200.0 * 25.4, 6).alias("width_mm"))


@query("d04_table_function", "select p_partkey, 0::bigint as seq, 67 as tag, (p_size % 9)::int as level, (2 * length(p_name))::bigint as size from part union all select p_partkey, 1, null, null, null from part where p_size % 4 = 0")
def _(spark, d):
    functions.register(spark)
    head = le(F.col("p_size") % 9 * 1024 + F.length("p_name") * 2097152 + 67, 4)
    cut = F.when(F.col("p_size") % 4 == 0, F.unhex(F.lit("4304"))).otherwise(F.unhex(F.lit("")))
    rows = table(spark, d, "part").select("p_partkey", F.concat(head, utf16_units(F.col("p_name")), cut).alias("data"))
    return spark.sql("select s.p_partkey, r.seq, r.tag, r.level, r.size from {streams} s, lateral frame_records(s.data) r", streams=rows)
