"""Queries by operator, each with the SQL of the same result.

Tables of business data stand in for decoded documents: lines of a text for paragraphs, order lines for cells, parts for
styles, events for positions. Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import bits, media, numbers, text, units
from quillspark.operators import render
from quillspark.plans import cells, intervals, lookups, sequence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, line of every line of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


_LINES = "select doc_id, unnest(range(len(l)))::int as ord, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)"

def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with one row for each (l_orderkey, l_linenumber), the smallest whole row, as cells of a table have one order."""
    columns = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*columns)).alias("_row"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col("_row")[c].alias(c) for c in columns])


_CELLS = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate) = 1)"


# ---------------------------------------------------------------- numbers as text

_ROMAN = (
    "repeat('M', (n // 10000 * 10)::int) || "
    + " || ".join(f"list_extract({_list(numbers.ROMAN[k])}, ((n // {u}) % 10 + 1)::int)" for k, u in (("M", 1000), ("C", 100), ("X", 10), ("I", 1)))
)


@query("f21_roman", f"select n, {_ROMAN} as roman, lower({_ROMAN}) as roman_lower from (select p_partkey as n from part)")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n")).select("n", numbers.roman("n").alias("roman"), F.lower(numbers.roman("n")).alias("roman_lower"))


def _alpha_sql(n: str) -> str:
    out, below = "''", 1
    arms = []
    for k in range(1, 8):
        m = f"({n} - {below})"
        letters = " || ".join(f"chr((65 + {m} // {26**j} % 26)::int)" for j in range(k - 1, -1, -1))
        arms.append(f"when {n} between {below} and {below + 26**k - 1} then {letters}")
        below += 26**k
    return f"case {' '.join(arms)} else {out} end"


@query("f22_alpha", f"select n, {_alpha_sql('n')} as alpha from (select p_partkey as n from part)")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n")).select("n", numbers.alpha("n").alias("alpha"))


def _look(values: list[str], n: str = "n") -> str:
    return f"case when {n} between 1 and {len(values)} then list_extract({_list(values)}, {n}::int) end"


def _cycle(values: list[str]) -> str:
    return f"case when n = 0 then '0' else list_extract({_list(values)}, ((n - 1) % {len(values)} + 1)::int) end"


def _count_sql(digits: list[str], ten: str) -> str:
    d = f"list_extract({_list(['', *digits])}, "
    return f"case when n between 1 and 99 then (case when n // 10 > 1 then {d}(n // 10 + 1)::int) else '' end) || (case when n >= 10 then '{ten}' else '' end) || {d}(n % 10 + 1)::int) else n::varchar end"


_SIZES = "(select l_orderkey, l_linenumber, (l_quantity * 2 + l_linenumber - 3)::bigint as n from lineitem)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2 + F.col("l_linenumber") - 3).cast("long").alias("n"))


@query(
    "f23_circled",
    f"select *, coalesce({_look(numbers.CIRCLED)}, n::varchar) as circled, coalesce({_look(numbers.CIRCLED_UPPER)}, {_alpha_sql('n')}) as upper, coalesce({_look(numbers.CIRCLED_LOWER)}, lower({_alpha_sql('n')})) as lower from {_SIZES}",
)
def _(spark, d):
    return _sizes(spark, d).select("*", numbers.circled_number("n").alias("circled"), numbers.circled_alpha("n").alias("upper"), numbers.circled_alpha("n", False).alias("lower"))


@query(
    "f25_gana",
    f"select *, {_cycle(numbers.SYLLABLES)} as gana, {_cycle(numbers.JAMO)} as jamo, coalesce({_look(numbers.CIRCLED_SYLLABLES)}, {_cycle(numbers.SYLLABLES)}) as circled_gana, coalesce({_look(numbers.CIRCLED_JAMO)}, {_cycle(numbers.JAMO)}) as circled_jamo from {_SIZES}",
)
def _(spark, d):
    n = "n"
    return _sizes(spark, d).select("*", numbers.gana(n).alias("gana"), numbers.jamo(n).alias("jamo"), numbers.circled_gana(n).alias("circled_gana"), numbers.circled_jamo(n).alias("circled_jamo"))


@query("f27_hangul_number", f"select *, {_count_sql(numbers.HANGUL_DIGITS, '십')} as word from {_SIZES}")
def _(spark, d):
    return _sizes(spark, d).withColumn("word", numbers.hangul_number("n"))


@query(
    "f28_chinese_number",
    f"select *, {_count_sql(numbers.CHINESE_DIGITS, '十')} as word, coalesce({_look(numbers.CIRCLED_CHINESE)}, {_count_sql(numbers.CHINESE_DIGITS, '十')}) as circled from {_SIZES}",
)
def _(spark, d):
    return _sizes(spark, d).select("*", numbers.chinese_number("n").alias("word"), numbers.circled_chinese("n").alias("circled"))


@query("f30_stem", f"select *, {_cycle(numbers.STEMS)} as stem, {_cycle(numbers.STEMS_CHINESE)} as chinese from {_SIZES}")
def _(spark, d):
    return _sizes(spark, d).select("*", numbers.heavenly_stem("n").alias("stem"), numbers.heavenly_stem("n", True).alias("chinese"))


_SHAPE_SQL = {
    "arabic": "n::varchar", "circled_arabic": f"coalesce({_look(numbers.CIRCLED)}, n::varchar)", "roman_upper": _ROMAN, "roman_lower": f"lower({_ROMAN})",
    "alpha_upper": _alpha_sql("n"), "alpha_lower": f"lower({_alpha_sql('n')})", "circled_alpha_upper": f"coalesce({_look(numbers.CIRCLED_UPPER)}, {_alpha_sql('n')})",
    "circled_alpha_lower": f"coalesce({_look(numbers.CIRCLED_LOWER)}, lower({_alpha_sql('n')}))", "hangul": _cycle(numbers.SYLLABLES),
    "circled_hangul": f"coalesce({_look(numbers.CIRCLED_SYLLABLES)}, {_cycle(numbers.SYLLABLES)})", "hangul_jamo": _cycle(numbers.JAMO),
    "circled_hangul_jamo": f"coalesce({_look(numbers.CIRCLED_JAMO)}, {_cycle(numbers.JAMO)})", "hangul_number": _count_sql(numbers.HANGUL_DIGITS, "십"),
    "chinese_number": _count_sql(numbers.CHINESE_DIGITS, "十"), "circled_chinese_number": f"coalesce({_look(numbers.CIRCLED_CHINESE)}, {_count_sql(numbers.CHINESE_DIGITS, '十')})",
    "heavenly_stem": _cycle(numbers.STEMS), "heavenly_stem_chinese": _cycle(numbers.STEMS_CHINESE), "user_repeat": "n::varchar",
}
_SHAPE_NAMES = [*numbers.SHAPES, "user_repeat"]


@query(
    "f20_format_number",
    f"select l_orderkey, l_linenumber, shape, n, case shape {' '.join(f'when {chr(39)}{k}{chr(39)} then {v}' for k, v in _SHAPE_SQL.items())} end as label from (select l_orderkey, l_linenumber, l_quantity::bigint as n, list_extract({_list(_SHAPE_NAMES)}, (l_partkey % {len(_SHAPE_NAMES)} + 1)::int) as shape from lineitem)",
)
def _(spark, d):
    shape = F.get(F.array(*[F.lit(s) for s in _SHAPE_NAMES]), (F.col("l_partkey") % len(_SHAPE_NAMES)).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"), shape.alias("shape"))
    return rows.withColumn("label", numbers.format_number("shape", "n"))


def _label_sql(level: str, n: str) -> str:
    syllable = f"(case when {n} = 0 then '' else list_extract({_list(numbers.SYLLABLES)}, (({n} - 1) % 14 + 1)::int) end)"
    circled = f"(case when {n} between 1 and 20 then list_extract({_list(numbers.CIRCLED)}, {n}::int) else {n}::varchar end)"
    return f"case {level} when 2 then {syllable} || '.' when 3 then {n} || ')' when 4 then {syllable} || ')' when 5 then '(' || {n} || ')' when 6 then '(' || {syllable} || ')' when 7 then {circled} else {n} || '.' end"


@query("f31_outline_label", f"select l_orderkey, l_linenumber, level, n, {_label_sql('level', 'n')} as label from (select l_orderkey, l_linenumber, l_suppkey % 9 + 1 as level, l_quantity::bigint as n from lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 9 + 1).alias("level"), F.col("l_quantity").cast("long").alias("n"))
    return rows.withColumn("label", numbers.outline_label("level", "n"))


# ---------------------------------------------------------------- bits, versions, flags


@query("f33_version", "select o_orderkey, v, (v >> 24) & 255 || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) as version, format('{}.{:02d}.{:02d}.{:02d}', (v >> 24) & 255, (v >> 16) & 255, (v >> 8) & 255, v & 255) as padded from (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as v from orders)")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 2654435761) % 4294967296).alias("v"))
    return rows.select("*", numbers.version("v").alias("version"), numbers.version("v", padded=True).alias("padded"))


@query(
    "f45_flags",
    "select o_orderkey, v, array_to_string(list_filter(["
    + ",".join(f"case when (v >> {k}) & 1 = 1 then '{n}' end" for k, n in enumerate(bits.DOCUMENT_FLAGS))
    + "], lambda x: x is not null), ',') as document_flags, array_to_string(list_filter(["
    + ",".join(f"case when (v >> {k}) & 1 = 1 then '{n}' end" for k, n in enumerate(bits.LICENSE_FLAGS))
    + "], lambda x: x is not null), ',') as license_flags, v & 1 = 1 as compressed, (v >> 1) & 1 = 1 as encrypted, (v >> 5) & 1 = 1 as has_template from (select o_orderkey, (o_orderkey * 40503) % 262144 as v from orders)",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 40503) % 262144).alias("v"))
    return rows.select(
        "*", F.array_join(bits.flag_names("v", bits.DOCUMENT_FLAGS), ",").alias("document_flags"), F.array_join(bits.flag_names("v", bits.LICENSE_FLAGS), ",").alias("license_flags"),
        bits.has_bit("v", 0).alias("compressed"), bits.has_bit("v", 1).alias("encrypted"), bits.has_bit("v", 5).alias("has_template"),
    )


@query("d02_record_header", "select l_orderkey, l_linenumber, v, v & 1023 as tag, (v >> 10) & 1023 as level, (v >> 20) & 4095 as size, ((v >> 20) & 4095) = 4095 as extended from (select l_orderkey, l_linenumber, (l_orderkey * 2654435761 + l_linenumber * 40503) % 4294967296 as v from lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503) % 4294967296).alias("v"))
    tag, level, size = bits.record_header("v")
    return rows.select("*", tag.alias("tag"), level.alias("level"), size.alias("size"), (size == 4095).alias("extended"))


@query("d01_little_endian", "select o_orderkey, b0 + b1 * 256 as u16, (b0 + b1 * 256 + b2 * 65536 + b3 * 16777216) as u32, case when b0 + b1 * 256 >= 32768 then b0 + b1 * 256 - 65536 else b0 + b1 * 256 end as i16 from (select o_orderkey, (ord(substr(h, 1, 1)))::bigint as b0, ord(substr(h, 2, 1))::bigint as b1, ord(substr(h, 3, 1))::bigint as b2, ord(substr(h, 4, 1))::bigint as b3 from (select o_orderkey, md5(o_orderkey::varchar) as h from orders))")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).cast("binary").alias("h"))
    return rows.select("o_orderkey", bits.little_endian("h", 0, 2).alias("u16"), bits.little_endian("h", 0, 4).alias("u32"), bits.little_endian("h", 0, 2, signed=True).alias("i16"))


@query("f32_auto_number", "select l_orderkey, l_linenumber, a & 15 as kind, (a >> 4) & 255 as shape from (select l_orderkey, l_linenumber, l_partkey * 97 + l_linenumber as a from lineitem)")
def _(spark, d):
    a = F.col("l_partkey") * 97 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bits.auto_number_kind(a).alias("kind"), bits.auto_number_shape(a).alias("shape"))


_NAMED = {k: v for k, v in text.CONTROL_NAMES.items()}


@query(
    "f01_control_codes",
    "select l_orderkey, l_linenumber, c as code, case when c > 31 or c in (0,10,13,24,30,31) then 1 else 8 end as size, case when c = 9 then chr(9) when c in (10,13) then chr(10) when c = 24 then '-' when c in (30,31) then ' ' end as shown, c in (9,10,13,24,30,31) as convertible, case when c > 31 then 'UNKNOWN_' || c "
    + " ".join(f"when c = {k} then '{v}'" for k, v in _NAMED.items())
    + " else 'RESERVED_' || c end as name from (select l_orderkey, l_linenumber, (l_partkey % 40)::int as c from lineitem)",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).cast("int").alias("code"))
    return rows.select("*", text.control_size("code").alias("size"), text.control_text("code").alias("shown"), text.is_convertible("code").alias("convertible"), text.control_name("code").alias("name"))


# ---------------------------------------------------------------- units and colours


@query("f40_units", "select l_orderkey, l_linenumber, v, round(v / 7200.0 * 25.4, 6) as mm, round(v / 7200.0, 6) as inches, trunc(v / 100.0 / 25.4 * 7200.0)::bigint as units, floor(v::double * 25.4::double / 7200.0::double * 100 + 0.5) / 100 as mm2 from (select l_orderkey, l_linenumber, floor(l_extendedprice)::bigint as v from lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("v"))
    return rows.select("*", F.round(units.to_mm("v"), 6).alias("mm"), F.round(units.to_inches("v"), 6).alias("inches"), units.from_mm(F.col("v") / 100.0).alias("units"), units.round2(units.int_to_mm("v")).alias("mm2"))


@query("f43_color", "select l_orderkey, l_linenumber, 'rgb(' || (c & 255) || ',' || ((c >> 8) & 255) || ',' || ((c >> 16) & 255) || ')' as rgb, format('#{:02X}{:02X}{:02X}', c & 255, (c >> 8) & 255, (c >> 16) & 255) as hex from (select l_orderkey, l_linenumber, (l_orderkey * 40503 + l_partkey) % 16777216 as c from lineitem)")
def _(spark, d):
    c = (F.col("l_orderkey") * 40503 + F.col("l_partkey")) % 16777216
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", units.rgb(c).alias("rgb"), units.hex_color(c).alias("hex"))


@query("f44_border_width", f"select p_partkey, coalesce(list_extract({units.BORDER_WIDTHS}, (p_size % 18 + 1)::int), 0.12)::double as mm from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", units.border_width(F.col("p_size") % 18).alias("mm"))


@query("f46_position", "select p_partkey, round(case p_size % 3 when 1 then 20 + (170 - w) / 2 + x when 2 then 20 + 170 - w - x else 20 + x end, 4) as \"left\", round(297.0 - 24.99 - 10.0 - x, 4) as content_height from (select *, p_retailprice / 100.0 as w, p_size / 10.0 as x from part)")
def _(spark, d):
    w, x = F.col("p_retailprice") / 100.0, F.col("p_size") / 10.0
    mode = F.when(F.col("p_size") % 3 == 1, "center").when(F.col("p_size") % 3 == 2, "right").otherwise("left")
    none = F.lit(None).cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(units.aligned(F.lit(20.0), F.lit(170.0), w, x, mode), 4).alias("left"), F.round(units.content_height(none, none, none, x, none), 4).alias("content_height")
    )


@query("f50_letter_spacing", "select p_partkey, coalesce(nullif((p_size % 3)::double, 0), nullif((p_partkey % 4)::double, 0)) / 2.0 / 100.0 as em from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", units.letter_spacing(F.col("p_size") % 3, F.col("p_partkey") % 4).alias("em"))


# ---------------------------------------------------------------- times, formats


@query("f61_filetime", "select event_id, s as seconds, strftime(make_timestamp((s + 32400) * 1000000), '%Y-%m-%dT%H:%M:%S+09:00') as shown from (select event_id, case when ft < 116444736000000000 then 0 else (ft - 116444736000000000) // 10000000 end as s from (select event_id, 116444736000000000 + epoch_us(ts) * 10 - event_id % 7 * 30000000000000000 as ft from events))")
def _(spark, d):
    ft = F.lit(media.FILETIME_EPOCH) + F.unix_micros(F.col("ts").cast("timestamp")) * 10 - F.col("event_id") % 7 * 30_000_000_000_000_000
    rows = table(spark, d, "events").select("event_id", media.filetime_seconds(ft).alias("seconds"))
    return rows.withColumn("shown", media.seoul_text("seconds"))


@query("s03_sniff", "select doc_id, case doc_id % 4 when 0 then 'compound' when 1 then 'package' else 'unknown' end as format, case doc_id % 4 when 2 then 'BMP' when 3 then 'GIF' else 'UNKNOWN' end as preview from documents")
def _(spark, d):
    heads = {0: "D0CF11E0A1B11AE1", 1: "504B0304", 2: "424D", 3: "474946383961"}
    head = None
    for k, v in heads.items():
        head = F.when(F.col("doc_id") % 4 == k, F.unhex(F.lit(v))) if head is None else head.when(F.col("doc_id") % 4 == k, F.unhex(F.lit(v)))
    content = F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", content.alias("c")).select("doc_id", media.sniff("c").alias("format"), media.preview_format("c").alias("preview"))


@query("f65_mime", "select doc_id, case when b like 'iVBORw%' then 'image/png' when b like '/9j/%' then 'image/jpeg' when b like 'Qk%' then 'image/bmp' else 'image/jpeg' end as mime, length(b) as size from (select doc_id, base64(encode(coalesce(text, ''))) as b from documents)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("b"))
    return rows.select("doc_id", media.mime_of_base64("b").alias("mime"), F.length(F.regexp_replace("b", "\\s", "")).cast("long").alias("size"))


@query("f66_item_names", f"select p_partkey, format('BIN{{:04X}}.{{}}', p_partkey, e) as file, case e {' '.join(f'when {chr(39)}{k}{chr(39)} then {chr(39)}{v}{chr(39)}' for k, v in media.MIME.items())} else 'image/jpeg' end as mime from (select p_partkey, list_extract(['png','gif','bmp','jpg','xyz'], (p_size % 5 + 1)::int) as e from part)")
def _(spark, d):
    e = F.get(F.array(*[F.lit(x) for x in ("png", "gif", "bmp", "jpg", "xyz")]), (F.col("p_size") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", media.item_name("p_partkey", e).alias("file"), media.mime_of_extension(e).alias("mime"))


# ---------------------------------------------------------------- text


@query("f08_tab_leader", "select l_orderkey, l_linenumber, case l when 3 then repeat('.', greatest(3, least(80, w // 1200))::int) when 2 then repeat('-', greatest(2, least(40, w // 2400))::int) when 1 then repeat('_', greatest(2, least(40, w // 2400))::int) else chr(9) end as tab from (select l_orderkey, l_linenumber, l_suppkey % 5 as l, floor(l_extendedprice)::bigint as w from lineitem)")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.tab_text(F.col("l_suppkey") % 5, F.floor("l_extendedprice")).alias("tab"))


@query("f12_markdown_style", "select doc_id, ord, case when trim(line) = '' then '' else (case when s then '~~' else '' end) || (case when b then '**' else '' end) || (case when i then '*' else '' end) || line || (case when i then '*' else '' end) || (case when b then '**' else '' end) || (case when s then '~~' else '' end) end as styled from (select *, doc_id % 2 = 1 as i, (doc_id // 2) % 2 = 1 as b, (doc_id // 4) % 2 = 1 as s from (" + _LINES + "))")
def _(spark, d):
    flag = lambda k: F.floor(F.col("doc_id") / k) % 2 == 1
    return lines(spark, d).select("doc_id", "ord", text.markdown_style("line", flag(1), flag(2), flag(4)).alias("styled"))


@query("f15_cell_escape", "select doc_id, replace(replace(text, '|', '\\|'), chr(10), '<br>') as cell, regexp_replace(regexp_replace(text, '^ ', '&nbsp;'), ' $', '&nbsp;') as edges from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cell_text("text").alias("cell"), text.hard_edges("text").alias("edges"))


@query("f11_breaks", "select l_orderkey, string_agg(trim(piece), '  ' || chr(10) order by k) as shown from (select l_orderkey, k, substr(s, (k * 7 + 1)::int, 7) as piece from (select o_orderkey as l_orderkey, o_orderpriority || ' ' || o_orderstatus || ' order' as s from orders), range(0, 3) t(k)) group by l_orderkey")
def _(spark, d):
    s = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.lit("order"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), text.with_breaks(F.substring(s, 1, 21), F.array(F.lit(7), F.lit(14))).alias("shown"))


@query("f14_caption", "select l_orderkey, l_linenumber, '표' as label, case when l_linenumber % 2 = 0 then l_partkey::varchar end as number, 'item ' || l_suppkey as body from lineitem")
def _(spark, d):
    written = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("표 "), F.col("l_partkey").cast("string"), F.lit(" item "), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("표 item "), F.col("l_suppkey").cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.caption(written).alias("c")).select("l_orderkey", "l_linenumber", "c.label", "c.number", "c.body")


@query("p05_meaningful", "select doc_id, count(*) as n_lines, count(*) filter (where trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '') as n_meaningful from (" + _LINES + ") group by doc_id")
def _(spark, d):
    rows = lines(spark, d).withColumn("ok", text.meaningful("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("ok").alias("n_meaningful"))


@query("p11_blank_format", "select p_partkey, p_size % 3 = 1 as blank from part")
def _(spark, d):
    form = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.lit("\0\0")).otherwise(F.lit("^1."))
    return table(spark, d, "part").select("p_partkey", text.blank_format(form).alias("blank"))


@query("k02_plain_text", "select doc_id, string_agg(t, chr(10) order by ord) as plain from (select doc_id, ord, trim(line) as t from (" + _LINES + ")) where t <> '' group by doc_id")
def _(spark, d):
    return render.plain_text(lines(spark, d), "doc_id", "ord", "line").withColumnRenamed("text", "plain")


# ---------------------------------------------------------------- document order

_LEVELS = "select doc_id, ord, line, (length(line) * 7 + ord * 3) % 5 as level from (" + _LINES + ")"


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("level", ((F.length("line") * 7 + F.col("ord") * 3) % 5).cast("int"))


@query("w01_parent", f"with l as ({_LEVELS}) select doc_id, ord, level, (select max(p.ord) from l p where p.doc_id = l.doc_id and p.ord < l.ord and p.level < l.level) as parent from l")
def _(spark, d):
    return sequence.parents(_levelled(spark, d), "doc_id", "ord", "level", 5).select("doc_id", "ord", "level", "parent")


@query(
    "w04_outline",
    f"with l as (select doc_id, ord, level + 1 as level from ({_LEVELS})), g as (select *, (select max(p.ord) from l p where p.doc_id = l.doc_id and p.ord < l.ord and p.level < l.level) as above from l), n as (select *, row_number() over (partition by doc_id, level, above order by ord) as number from g) select doc_id, ord, level, number, {_label_sql('level', 'number')} as label from n",
)
def _(spark, d):
    rows = _levelled(spark, d).withColumn("level", F.col("level") + 1)
    rows = sequence.outline_numbers(rows, "doc_id", "ord", "level")
    return rows.select("doc_id", "ord", "level", "number", numbers.outline_label("level", "number").alias("label"))


@query("w05_counters", "with l as (select l_orderkey, l_linenumber, l_quantity::bigint as v, l_returnflag = 'R' as r from " + _CELLS + "), g as (select *, count(*) filter (where r) over (partition by l_orderkey order by l_linenumber) as run from l) select l_orderkey, l_linenumber, coalesce(max(case when r then v end) over (partition by l_orderkey, run), 1) + row_number() over (partition by l_orderkey, run order by l_linenumber) - 1 as counter from g")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("v"), (F.col("l_returnflag") == "R").alias("r"))
    return sequence.restarting_counter(rows, "l_orderkey", "l_linenumber", F.col("r"), F.col("v"), F.lit(1)).select("l_orderkey", "l_linenumber", "counter")


@query("w06_note_ids", "select l_orderkey, l_linenumber, l_returnflag as kind, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) as number, row_number() over (partition by l_orderkey order by l_linenumber) + 4 as table_number from " + _CELLS + "")
def _(spark, d):
    rows = sequence.numbered(grid_cells(spark, d), ["l_orderkey", "l_returnflag"], "l_linenumber")
    return sequence.numbered(rows, "l_orderkey", "l_linenumber", "table_number", start=5).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), "number", "table_number")


_SEGMENTS = "select user_id, event_id, case when event_id % 11 = 0 then null else value::double end as v, event_id % 13 = 0 as e, event_id % 17 = 0 as c from events"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("user_id", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"), (F.col("event_id") % 13 == 0).alias("e"), (F.col("event_id") % 17 == 0).alias("c"))


@query("w09_reset", f"with s as ({_SEGMENTS}), p as (select *, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev from s) select user_id, event_id, coalesce(prev is not null and v is not null and (v < 0.1 or (prev > 0.1 and v < prev - 0.1)), false) as reset from p")
def _(spark, d):
    return sequence.vertical_resets(_segments(spark, d), "user_id", "event_id", "v").select("user_id", "event_id", "reset")


@query(
    "w08_pages",
    f"""with recursive s as (select *, row_number() over (partition by user_id order by event_id) as k from ({_SEGMENTS})),
    f as (
      select user_id, event_id, k, 1::bigint as page, null::varchar as reason, v as last, greatest(0.0, coalesce(v, 0.0)) as most from s where k = 1
      union all
      select user_id, event_id, k, page + (case when reason is null then 0 else 1 end), reason,
        coalesce(v, case when reason is null then last end), greatest(case when reason is null then most else 0.0 end, coalesce(v, 0.0))
      from (
        select s.user_id, s.event_id, s.k, s.v, f.page, f.last, f.most,
          case when s.e then 'explicit' when s.c then 'page_def_change'
               when f.last is not null and s.v is not null and (s.v < 0.1 or (f.last > 0.1 and s.v < f.last - 0.1)) then 'vertical_reset'
               when s.v is not null and s.v > 250 and f.most > 0 then 'vertical_overflow' end as reason
        from f join s on s.user_id = f.user_id and s.k = f.k + 1
      )
    ) select user_id, event_id, page, reason from f""",
)
def _(spark, d):
    return sequence.pages(_segments(spark, d), "user_id", "event_id", "v", "e", "c", 250.0)


@query("w14_col_addr", "with l as (select l_orderkey, l_linenumber, (l_suppkey % 3 + 1)::bigint as span, case when l_partkey % 4 = 0 then l_partkey % 10 end as given from " + _CELLS + "), g as (select *, count(given) over (partition by l_orderkey order by l_linenumber) as island from l) select l_orderkey, l_linenumber, coalesce(max(given) over (partition by l_orderkey, island), 0) + coalesce(sum(span) over (partition by l_orderkey, island order by l_linenumber rows between unbounded preceding and 1 preceding), 0)::bigint as address from g")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3 + 1).alias("span"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 10).alias("given"))
    return sequence.column_addresses(rows, "l_orderkey", "l_linenumber", "span", "given").select("l_orderkey", "l_linenumber", "address")


@query("w13_recovered_rows", "select l_orderkey, l_linenumber, least(sum(b) over (partition by l_orderkey order by l_linenumber), 2)::bigint as \"row\" from (select *, case when l_partkey % 6 <= lag(l_partkey % 6) over (partition by l_orderkey order by l_linenumber) then 1 else 0 end as b from " + _CELLS + ")")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 6).alias("c"))
    return sequence.recovered_rows(rows, "l_orderkey", "l_linenumber", "c", F.lit(3)).select("l_orderkey", "l_linenumber", "row")


_SPANS = "select l_orderkey, l_partkey % 90 as low, l_partkey % 90 + l_linenumber + 5 as high from " + _CELLS + ""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("l_partkey") % 90
    return grid_cells(spark, d).select("l_orderkey", low.alias("low"), (low + F.col("l_linenumber") + 5).alias("high"))


@query("w15_gaps", f"with s as ({_SPANS}), r as (select l_orderkey, greatest(coalesce(max(high) over (partition by l_orderkey order by low, high rows between unbounded preceding and 1 preceding), 0), 0) as gap_low, least(low, 100) as gap_high from s), t as (select * from r union all select l_orderkey, greatest(max(high), 0), 100 from s group by 1) select l_orderkey, gap_low, gap_high from t where gap_low < gap_high")
def _(spark, d):
    return sequence.gaps(_spans(spark, d), "l_orderkey", "low", "high", F.lit(0).cast("long"), F.lit(100).cast("long"))


@query("w16_offsets", "select user_id, event_id, coalesce(sum(k - s) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as shift, event_id + coalesce(sum(k - s) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as cleaned from (select user_id, event_id, case when event_id % 3 = 0 then 1 else 8 end as s, case when event_id % 3 = 0 then 1 else 0 end as k from events)")
def _(spark, d):
    single = F.col("event_id") % 3 == 0
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(single, 1).otherwise(8).alias("s"), F.when(single, 1).otherwise(0).alias("k"))
    return sequence.cleaned_offsets(rows, "user_id", "event_id", "s", "k").select("user_id", "event_id", "shift", "cleaned")


@query("w02_segment_ends", "with s as (select l_orderkey, l_linenumber, (l_partkey % 50)::bigint as start from " + _CELLS + ") select l_orderkey, l_linenumber, start, coalesce((select min(t.start) from s t where t.l_orderkey = s.l_orderkey and t.start > s.start), 50) as \"end\" from s")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("start"))
    return sequence.segment_ends(rows, "l_orderkey", "start", F.lit(50).cast("long"))


@query("w12_image_index", "select doc_id, ord, count(*) filter (where trim(line) = '') over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as image_index from (" + _LINES + ")")
def _(spark, d):
    return sequence.empty_rank(lines(spark, d), "doc_id", "ord", F.trim("line") == "").select("doc_id", "ord", "image_index")


@query("w17_separators", "select doc_id, string_agg(sep || line, '' order by ord) as joined from (select doc_id, ord, line, case when lag(i) over w is null then '' when lag(i) over w and i then '  ' || chr(10) else chr(10) || chr(10) end as sep from (select *, length(line) % 2 = 0 as i from (" + _LINES + ")) window w as (partition by doc_id order by ord)) group by doc_id")
def _(spark, d):
    rows = sequence.separators(lines(spark, d).withColumn("i", F.length("line") % 2 == 0), "doc_id", "ord", "i")
    return sequence.joined(rows, "doc_id", "ord", F.concat("separator", "line"), "", "joined")


# ---------------------------------------------------------------- joins

_STYLES = "select p_partkey as idx, p_size * 10 as base_size, p_partkey * 40503 % 16777216 as color, p_size % 2 = 0 as bold, p_size % 3 = 0 as italic, p_partkey % 7 as font, (p_size % 9 - 4) as spacing from part"


def _styles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("idx"), (F.col("p_size") * 10).alias("base_size"), (F.col("p_partkey") * 40503 % 16777216).alias("color"), (F.col("p_size") % 2 == 0).alias("bold"),
        (F.col("p_size") % 3 == 0).alias("italic"), (F.col("p_partkey") % 7).alias("font"), (F.col("p_size") % 9 - 4).alias("spacing"),
    )


@query("j01_style_lookup", f"select l_orderkey, l_linenumber, s.base_size, s.bold, coalesce(n.n_name, '{render.DEFAULT_FONT}') as font from lineitem left join ({_STYLES}) s on l_partkey * 2 = s.idx left join nation n on s.font = n.n_nationkey and n.n_nationkey < 5")
def _(spark, d):
    runs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("shape_id"), F.lit(0).alias("doc"))
    fonts = table(spark, d, "nation").where("n_nationkey < 5").select(F.lit(0).alias("doc"), F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("name"))
    shapes = _styles(spark, d).select(F.lit(0).alias("doc"), "idx", "base_size", "bold", F.col("font").alias("font_id"))
    return lookups.with_char_shape(runs, shapes, ["base_size", "bold"], fonts).select("l_orderkey", "l_linenumber", "base_size", "bold", "font")


@query("j12_asof_style", "with e as (select user_id, event_id, event_type from events), s as (select user_id, event_id as at, event_type from e where event_id % 3 = 0) select e.user_id, e.event_id, (select max_by(s.event_type, s.at) from s where s.user_id = e.user_id and s.at <= e.event_id) as style from e")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("style"))
    out = intervals.as_of(events.select("user_id", "at"), events.where("at % 3 = 0"), "user_id", "at", "style")
    return out.select("user_id", F.col("at").alias("event_id"), "style")


@query("j13_anchor_interval", f"with s as ({_SPANS}), p as (select l_orderkey, l_linenumber, l_suppkey % 110 as at from {_CELLS}) select p.l_orderkey, p.l_linenumber, p.at, s.low, s.high from p join s on p.l_orderkey = s.l_orderkey and p.at >= s.low and p.at < s.high")
def _(spark, d):
    points = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 110).alias("at"))
    return intervals.points_in_intervals(points, _spans(spark, d), "l_orderkey", "at", "low", "high", 16)


_ZONES = "select l_orderkey, l_linenumber as zone_ord, l_partkey % 4 as start_row, l_partkey % 4 + 2 as end_row, l_suppkey % 4 as start_col, l_suppkey % 4 + 2 as end_col, l_partkey % 5 as fill from " + _CELLS


@query("j07_zone_range", f"with z as ({_ZONES}), c as (select l_orderkey, l_linenumber, l_partkey % 6 as r, l_suppkey % 6 as k from {_CELLS}) select c.l_orderkey, c.l_linenumber, (select max_by(z.fill, z.zone_ord) from z where z.fill <> 0 and z.l_orderkey = c.l_orderkey and c.r between z.start_row and z.end_row and c.k between z.start_col and z.end_col) as zone_fill from c")
def _(spark, d):
    li, p, s = grid_cells(spark, d), F.col("l_partkey"), F.col("l_suppkey")
    zones = li.select("l_orderkey", F.col("l_linenumber").alias("zone_ord"), (p % 4).alias("start_row"), (p % 4 + 2).alias("end_row"), (s % 4).alias("start_col"), (s % 4 + 2).alias("end_col"), (p % 5).alias("fill"))
    cells = li.select("l_orderkey", "l_linenumber", (p % 6).alias("r"), (s % 6).alias("k"))
    return intervals.last_zone(cells, zones, "l_orderkey", ["l_linenumber"], "r", "k").select("l_orderkey", "l_linenumber", "zone_fill")


@query("j16_cell_anti", "select l_orderkey, l_linenumber from " + _CELLS + " p where not exists (select 1 from orders o where o.o_orderkey = p.l_orderkey and o.o_custkey % 7 = p.l_linenumber) and not exists (select 1 from orders o where o.o_orderkey = p.l_orderkey and o.o_orderstatus = p.l_linestatus)")
def _(spark, d):
    paragraphs = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("id"), F.col("l_linestatus").alias("t"))
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).alias("id"), F.col("o_orderstatus").alias("t"))
    return intervals.not_in_cells(paragraphs, cells, "l_orderkey", "id", "t").select("l_orderkey", "l_linenumber")


@query("j20_positional", "with a as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as k from " + _CELLS + " where l_returnflag = 'N'), b as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber) as k from " + _CELLS + " where l_linestatus = 'O') select a.l_orderkey, a.l_linenumber, a.k::bigint as ordinal, b.l_partkey from a left join b using (l_orderkey, k)")
def _(spark, d):
    li = grid_cells(spark, d)
    out = intervals.positional(li.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber"), li.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.col("ordinal").cast("long").alias("ordinal"), "l_partkey")


@query("j11_candidates", "with w as (select p_partkey, p_size % 7 as a, p_size % 5 as b, 24 as c from part), x as (select p_partkey, 0 as rank, a as k from w union all select p_partkey, 1, b from w union all select p_partkey, 2, c from w) select p_partkey, min_by(n_name, rank) as found from x join nation on k = n_nationkey and n_nationkey > 3 group by p_partkey")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit(0).alias("doc"), F.posexplode(F.array(F.col("p_size") % 7, F.col("p_size") % 5, F.lit(24))).alias("rank", "k"))
    streams = table(spark, d, "nation").where("n_nationkey > 3").select(F.lit(0).alias("doc"), F.col("n_nationkey").alias("k"), "n_name")
    return intervals.first_candidate(p, streams, ["doc", "p_partkey"], "k", "rank").select("p_partkey", F.col("n_name").alias("found"))


@query("j22_subtree", f"with recursive l as ({_LEVELS}), p as (select doc_id, ord, (select max(q.ord) from l q where q.doc_id = l.doc_id and q.ord < l.ord and q.level < l.level) as parent from l), t as (select doc_id, ord, ord as root from p where parent is null union all select p.doc_id, p.ord, t.root from p join t on p.doc_id = t.doc_id and p.parent = t.ord) select doc_id, root, count(*) as n_nodes from t group by doc_id, root")
def _(spark, d):
    # with the parent at hand a root's subtree is the run of rows up to the next root
    rows = sequence.parents(_levelled(spark, d), "doc_id", "ord", "level", 5)
    root = F.last(F.when(F.col("parent").isNull(), F.col("ord")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("root", root).groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("n_nodes"))


# ---------------------------------------------------------------- aggregates


@query("a02_first_nonempty", "select l_orderkey, c as col, coalesce(min_by(t, l_linenumber) filter (where t <> ''), '') as content from (select l_orderkey, l_linenumber, l_partkey % 3 as c, case when l_suppkey % 3 = 0 then '' else l_returnflag || l_partkey end as t from " + _CELLS + ") group by l_orderkey, c")
def _(spark, d):
    t = F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("col"), t.alias("content"))
    return cells.first_contents(rows, "l_orderkey", ["col"], "content", "l_linenumber")


@query("a03_table_size", "select l_orderkey, max(coalesce(c, 0) + s) as n_cols, count(distinct l_linenumber) as n_rows, min(coalesce(c, 0)) as first_col, bool_or(s > 1) as merged from (select l_orderkey, l_linenumber, nullif(l_partkey % 5, 4) as c, l_suppkey % 2 + 1 as s from " + _CELLS + ") group by l_orderkey")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.nullif(F.col("l_partkey") % 5, F.lit(4)).alias("c"), (F.col("l_suppkey") % 2 + 1).alias("s"))
    return cells.table_sizes(rows, "l_orderkey", "l_linenumber", "c", "s")


@query("a05_row_heights", "with h as (select l_orderkey, l_partkey % 3 as r, max(l_quantity) filter (where l_linenumber % 3 > 0) as height from " + _CELLS + " group by 1, 2) select l_orderkey, r, height, coalesce(sum(height) over (partition by l_orderkey order by r rows between unbounded preceding and 1 preceding), 0) as top from h")
def _(spark, d):
    rows = grid_cells(spark, d).select("l_orderkey", (F.col("l_partkey") % 3).alias("r"), "l_quantity", F.when(F.col("l_linenumber") % 3 > 0, 1).otherwise(2).alias("span"))
    return cells.row_heights(rows, "l_orderkey", "r", "l_quantity", "span")


@query("a07_column_edges", "select l_orderkey, count(distinct x)::double as n_edges from (select distinct l_orderkey, 0.0::double as x from lineitem union all select l_orderkey, (l_partkey % 20)::double from " + _CELLS + " union all select l_orderkey, (l_partkey % 20 + 3)::double from " + _CELLS + ") group by l_orderkey")
def _(spark, d):
    boxes = grid_cells(spark, d).select("l_orderkey", (F.col("l_partkey") % 20).cast("double").alias("left"), F.lit(3.0).alias("width"))
    return cells.column_edges(boxes, "l_orderkey").select("l_orderkey", F.size("edges").cast("double").alias("n_edges"))


@query("a12_pattern_ids", "with f as (select l_orderkey, l_partkey % 4 as color, min(l_linenumber) as first from " + _CELLS + " where l_partkey % 4 <> 0 group by 1, 2) select l_orderkey, color, format('w_{:02d}', row_number() over (partition by l_orderkey order by first) - 1) as pattern from f")
def _(spark, d):
    rows = grid_cells(spark, d).withColumn("color", F.col("l_partkey") % 4).where("color <> 0")
    return cells.pattern_ids(rows, "l_orderkey", "color", "l_linenumber")


@query("a11_distinct_texts", "select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag || l_linestatus)), ',') as texts, min(l_shipdate)::timestamp as first_date, min_by(l_partkey, l_linenumber) as first_part, coalesce(list_extract(list(l_partkey order by l_linenumber), 2), min_by(l_partkey, l_linenumber)) as second_part from " + _CELLS + " group by l_orderkey")
def _(spark, d):
    rows = grid_cells(spark, d).withColumn("t", F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))
    shapes = lookups.note_shapes(rows, "l_orderkey", "l_linenumber", ["l_partkey"]).select("l_orderkey", F.col("footnote.l_partkey").alias("first_part"), F.col("endnote.l_partkey").alias("second_part"))
    first = lookups.first_row(rows, "l_orderkey", "l_shipdate", ["l_shipdate"]).select("l_orderkey", F.col("l_shipdate").alias("first_date"))
    texts = lookups.distinct_texts(rows, "l_orderkey", "t").select("l_orderkey", F.array_join("texts", ",").alias("texts"))
    return texts.join(first, "l_orderkey").join(shapes, "l_orderkey")


# ---------------------------------------------------------------- rendering

_SHOWN = "l_linenumber::varchar || '|' || l_returnflag"


@query(
    "r09_pipe_table",
    "with c0 as (select l_orderkey, (l_linenumber - 1) // 2 as r, (l_linenumber - 1) % 2 as k, replace(" + _SHOWN + ", '|', '\\|') as t from " + _CELLS + "), s as (select l_orderkey, max(r) + 1 as n from c0 group by 1), c as (select l_orderkey, r - min(r) over (partition by l_orderkey) as r, k - min(k) over (partition by l_orderkey) as k, t from c0), g as (select s.l_orderkey, r.r as r, coalesce(a.t, ' ') as a, coalesce(b.t, ' ') as b from s, lateral (select unnest(range(n)) as r) r left join c a on a.l_orderkey = s.l_orderkey and a.r = r.r and a.k = 0 left join c b on b.l_orderkey = s.l_orderkey and b.r = r.r and b.k = 1) select l_orderkey, chr(10) || string_agg('| ' || a || ' | ' || b || ' |' || case when r = 0 then chr(10) || '|---|---|' else '' end, chr(10) order by r) || chr(10) as \"table\" from g group by l_orderkey",
)
def _(spark, d):
    k = F.col("l_linenumber") - 1
    cells = grid_cells(spark, d).select("l_orderkey", F.floor(k / 2).alias("r"), (k % 2).alias("k"), text.cell_text(F.concat(F.col("l_linenumber").cast("string"), F.lit("|"), "l_returnflag")).alias("t"))
    rows = cells.groupBy("l_orderkey").agg(F.max("r").alias("m"))
    cells = cells.join(rows, "l_orderkey")
    return render.pipe_table(cells, "l_orderkey", "r", "k", "t", F.col("m") + 1, F.lit(2))


@query(
    "r08_html_table",
    "with c as (select l_orderkey, l_linenumber as r, l_partkey % 2 + 1 as s, case when l_suppkey % 4 = 0 then '' else l_returnflag || chr(10) || l_linestatus end as t from " + _CELLS + ") select l_orderkey, '" + render.TABLE_OPEN.replace("\n", "' || chr(10) || '") + "' || string_agg(case when trim(t) = '' then '' else '  <tr>' || chr(10) || '    <td' || case when s > 1 then ' colspan=\"' || s || '\"' else '' end || '>' || replace(t, chr(10), '<br>') || '</td>' || chr(10) || '  </tr>' || chr(10) end, '' order by r) || '</table>' || chr(10) as \"table\" from c group by l_orderkey",
)
def _(spark, d):
    t = F.when(F.col("l_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat_ws("\n", "l_returnflag", "l_linestatus"))
    cells = grid_cells(spark, d).select("l_orderkey", F.col("l_linenumber").alias("r"), F.lit(0).alias("k"), (F.col("l_partkey") % 2 + 1).alias("s"), F.lit(1).alias("rs"), t.alias("t"))
    return render.html_table(cells, "l_orderkey", "r", "k", "rs", "s", "t")


@query("r11_table_chooser", "select p_partkey, case when r = 0 or c = 0 then chr(10) || chr(10) || '[Table: ' || r || 'x' || c || ']' || chr(10) || chr(10) when p_partkey % 2 = 0 then chr(10) || chr(10) || '[Empty Table: ' || r || 'x' || c || ']' || chr(10) || chr(10) end as shown from (select p_partkey, p_size % 4 as r, p_size % 3 as c from part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", render.placeholder(F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_partkey") % 2).alias("shown"))


def _num(x: str) -> str:
    return f"case when ({x}) % 100 = 0 then (({x}) // 100)::varchar when ({x}) % 10 = 0 then (({x}) // 100) || '.' || (({x}) % 100 // 10) else (({x}) // 100) || '.' || lpad((({x}) % 100)::varchar, 2, '0') end"


@query(
    "r20_css",
    f"select idx, '.cs' || idx || ' {{' || chr(10) || '  font-size:' || {_num('base_size')} || 'pt;color:rgb(' || (color & 255) || ',' || ((color >> 8) & 255) || ',' || ((color >> 16) & 255) || ');font-family:\"' || coalesce(n_name, '{render.DEFAULT_FONT}') || '\";' || case when bold then 'font-weight:bold;' else '' end || case when italic then 'font-style:italic;' else '' end || case when spacing <> 0 then 'letter-spacing:' || (case when spacing < 0 then '-' else '' end) || '0.0' || (abs(spacing) // 2) || 'em;' else '' end || chr(10) || '}}' || chr(10) as rule, '.ps' || idx || ' {{' || chr(10) || '  text-align:' || (case font when 0 then 'left' when 1 then 'right' when 2 then 'center' else 'justify' end) || ';' || chr(10) || '}}' || chr(10) as para from (select * replace (spacing // 2 * 2 as spacing) from ({_STYLES.replace('(p_size % 9 - 4) as spacing', '((p_size % 5) * 2)::int as spacing')})) left join (select * from nation where n_nationkey < 5) on font = n_nationkey",
)
def _(spark, d):
    s = _styles(spark, d).withColumn("spacing", (F.col("base_size") / 10).cast("int") % 5 * 2)
    fonts = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("font"), "n_name")
    c = F.col
    align = F.when(c("font") == 0, "left").when(c("font") == 1, "right").when(c("font") == 2, "center").otherwise("other")
    rows = s.join(fonts, "font", "left")
    return rows.select("idx", render.char_rule(c("idx"), c("base_size").cast("double"), c("color"), c("n_name"), c("bold"), c("italic"), c("spacing")).alias("rule"), render.para_rule(c("idx"), align).alias("para"))


@query("r05_markdown", "select doc_id, '" + render.TITLE + "' || chr(10) || chr(10) || '' || chr(10) || chr(10) || '" + render.VERSION_LABEL + "' || '5.01.00.00' || chr(10) || chr(10) || '' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by ord) as markdown from (" + _LINES + ") where trim(line) <> '' group by doc_id")
def _(spark, d):
    rows = lines(spark, d).where(F.trim("line") != "").select("doc_id", F.lit("body").alias("part"), "ord", "line")
    return render.markdown(rows, "doc_id", version=numbers.version(F.lit(0x05010000), padded=True))


@query(
    "u01_parts_union",
    "with p as (select conv_id, turn, case role when 'system' then 'headers' when 'user' then 'body' else 'footnotes' end as part, text from conversations), g as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) filter (where part = 'headers') as h, string_agg(text, chr(10) || chr(10) order by turn) filter (where part = 'body') as b, string_agg(text, chr(10) || chr(10) order by turn) filter (where part = 'footnotes') as f from p group by conv_id) select conv_id, '" + render.TITLE + "' || chr(10) || chr(10) || coalesce(chr(10) || chr(10) || h || chr(10) || chr(10), '') || coalesce(chr(10) || chr(10) || b, '') || coalesce((case when b is null then '' else chr(10) || chr(10) end) || chr(10) || chr(10) || '" + render.FOOTNOTES + "' || chr(10) || chr(10) || chr(10) || chr(10) || f, '') as markdown from g",
)
def _(spark, d):
    part = F.when(F.col("role") == "system", "headers").when(F.col("role") == "user", "body").otherwise("footnotes")
    return render.markdown(table(spark, d, "conversations").select("conv_id", part.alias("part"), F.col("turn").alias("ord"), F.col("text").alias("line")), "conv_id")


@query("s22_markup_text", "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as plain, len(regexp_extract_all(html, '<p[ >]')) as n_paragraphs, len(regexp_extract_all(html, '<a[ >]')) as n_links from pages")
def _(spark, d):
    pages = table(spark, d, "pages")
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\r\n]+", " "))
    return pages.select("page_id", plain.alias("plain"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"), F.regexp_count("html", F.lit("<a[ >]")).cast("long").alias("n_links"))


@query("k01_json", "select o_orderkey, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"items\":[' || string_agg('{\"n\":' || l_linenumber || ',\"flag\":\"' || l_returnflag || '\"}', ',' order by l_linenumber) || ']}' as json from orders join " + _CELLS + " as l on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus")
def _(spark, d):
    items = grid_cells(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("items"))
    rows = table(spark, d, "orders").join(items, "o_orderkey")
    return rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "items")).alias("json"))
