"""More queries by operator: lookups, anti joins, geometry and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.catalog import _CELLS, _LINES, _SEGMENTS, _num, _segments, grid_cells, lines, query, table  # noqa: PLC2701
from quillspark.functions import media, text, units
from quillspark.operators import render, tables
from quillspark.plans import cells, intervals, lookups, sequence
from quillspark.sources import package

# ---------------------------------------------------------------- lookups


@query("j02_paragraph_class", "select l_orderkey, l_linenumber, case when p_partkey is null then '' else 'ps' || p_partkey end as class, p_brand as style, coalesce(n_name, '') as numbering from " + _CELLS + " l left join part on l_partkey * 2 = p_partkey left join nation on p_size = n_nationkey")
def _(spark, d):
    part = table(spark, d, "part")
    shapes = part.select(F.lit(0).alias("doc"), F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("number_bullet_id"))
    styles = part.select(F.lit(0).alias("doc"), F.col("p_partkey").alias("idx"), F.col("p_brand").alias("local_name"))
    numbering = table(spark, d, "nation").select(F.lit(0).alias("doc"), F.col("n_nationkey").alias("idx"), F.array(F.lit("%"), F.col("n_name")).alias("formats"))
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.lit(0).alias("doc"), (F.col("l_partkey") * 2).alias("para_shape_id"), (F.col("l_partkey") * 2).alias("style_id"), F.lit(1).alias("level"))
    rows = lookups.with_numbering(lookups.with_style(lookups.with_para_shape(rows, shapes, ["number_bullet_id"]), styles), numbering)
    return rows.select("l_orderkey", "l_linenumber", "class", "style", F.coalesce("format", F.lit("")).alias("numbering"))


@query("j06_border_lookup", "select l_orderkey, l_linenumber, p_brand as border from (select *, case when l_partkey % 5 = 0 then l_suppkey else l_partkey end as fill from " + _CELLS + ") left join part on fill > 0 and p_partkey = fill - 1")
def _(spark, d):
    fills = table(spark, d, "part").select(F.lit(0).alias("doc"), F.col("p_partkey").alias("idx"), F.col("p_brand").alias("border"))
    own = F.when(F.col("l_partkey") % 5 == 0, F.lit(0)).otherwise(F.col("l_partkey"))
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.lit(0).alias("doc"), own.alias("border_fill_id"), F.col("l_suppkey").alias("table_fill_id"))
    return lookups.with_border(rows, fills, ["border"]).select("l_orderkey", "l_linenumber", "border")


@query("j08_images", "select l_orderkey, l_linenumber, '![이미지](images/' || file || ')' as shown from " + _CELLS + " l join (select b, min_by(f, k) as file from (select p_size as b, p_partkey as k, format('BIN{:04X}.png', p_partkey) as f from part) group by b) on l_partkey % 60 = b")
def _(spark, d):
    items = table(spark, d, "part").select(F.lit(0).alias("doc"), F.col("p_size").cast("long").alias("index"), F.col("p_partkey").alias("seq"), F.lit("png").alias("extension"))
    pictures = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.lit(0).alias("doc"), (F.col("l_partkey") % 60).alias("bindata_id"))
    file = F.concat(F.lit("images/"), media.item_name("item_seq", F.col("extension")))
    return lookups.with_item(pictures, items).select("l_orderkey", "l_linenumber", media.image_markdown(file).alias("shown"))


@query("j10_extensions", "select l_orderkey, l_linenumber, coalesce(e, 'jpg') as extension, case coalesce(e, 'jpg') when 'png' then 'image/png' when 'gif' then 'image/gif' else 'image/jpeg' end as mime from " + _CELLS + " l left join (select n_nationkey::bigint as k, case n_regionkey when 0 then 'png' when 1 then 'gif' else 'jpg' end as e from nation) on l_partkey % 40 = k")
def _(spark, d):
    e = F.when(F.col("n_regionkey") == 0, "png").when(F.col("n_regionkey") == 1, "gif").otherwise("jpg")
    bin_data = table(spark, d, "nation").select(F.lit(0).alias("doc"), F.col("n_nationkey").cast("long").alias("binary_id"), e.alias("extension"))
    rows = grid_cells(spark, d).select("l_orderkey", "l_linenumber", F.lit(0).alias("doc"), (F.col("l_partkey") % 40).alias("bindata_id"))
    return lookups.with_kind(rows, bin_data).select("l_orderkey", "l_linenumber", "extension", "mime")


@query("j15_cells_by_place", "with c as (select l_orderkey, l_linenumber, l_partkey % 3 as r, l_suppkey % 3 as k from " + _CELLS + "), p as (select l_orderkey, r, k, min(l_linenumber) as t from c where l_linenumber % 2 = 0 group by 1, 2, 3), q as (select l_orderkey, l_linenumber as place, l_linenumber * 100 as t from c where l_linenumber % 3 = 0) select c.l_orderkey, c.l_linenumber, coalesce(p.t, q.t) as content from c left join p on c.l_orderkey = p.l_orderkey and c.r = p.r and c.k = p.k left join q on c.l_orderkey = q.l_orderkey and q.place = c.r * 3 + c.k")
def _(spark, d):
    c = grid_cells(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("row"), (F.col("l_suppkey") % 3).alias("col"))
    by_place = c.where("l_linenumber % 2 = 0").select("l_orderkey", "row", "col", F.col("l_linenumber").alias("content"))
    by_index = c.where("l_linenumber % 3 = 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("place"), (F.col("l_linenumber") * 100).alias("content"))
    return lookups.with_contents(c, by_place, by_index, F.lit(3), "l_orderkey").select("l_orderkey", "l_linenumber", "content")


@query("j17_images_outside_tables", "select distinct l_orderkey, l_partkey from " + _CELLS + " l where not exists (select 1 from " + _CELLS + " c where c.l_orderkey = l.l_orderkey and c.l_suppkey = l.l_partkey % 10 + 1)")
def _(spark, d):
    rows = grid_cells(spark, d)
    inside = rows.select("l_orderkey", F.col("l_suppkey").alias("image"))
    return lookups.outside(rows.withColumn("image", F.col("l_partkey") % 10 + 1), inside, ["l_orderkey", "image"]).select("l_orderkey", "l_partkey").distinct()


@query("j18_covered", "with c as (select l_orderkey, l_linenumber // 3 as r, l_linenumber % 3 as k, 1 as rs, l_partkey % 2 + 1 as cs from " + _CELLS + "), s as (select *, lag(cs) over (partition by l_orderkey, r order by k) as b, lag(k) over (partition by l_orderkey, r order by k) as bk, lag(cs, 2) over (partition by l_orderkey, r order by k) as a, lag(k, 2) over (partition by l_orderkey, r order by k) as ak from c) select l_orderkey, r::bigint as r, k::bigint as k from s where not (coalesce(bk + b > k, false))")
def _(spark, d):
    n = F.col("l_linenumber").cast("long")
    cells = grid_cells(spark, d).select("l_orderkey", F.floor(n / 3).alias("r"), (n % 3).alias("k"), F.lit(1).cast("long").alias("rs"), (F.col("l_partkey") % 2 + 1).alias("cs"))
    return intervals.covered_cells(cells, "l_orderkey", "r", "k", "rs", "cs").select("l_orderkey", "r", "k")


@query("u04_shared_texts", "select o_orderkey, list_has_any(list(l_returnflag), list(case when l_linenumber % 2 = 0 then l_linestatus else 'A' end)) as overlap from (select l_orderkey as o_orderkey, * from " + _CELLS + ") group by o_orderkey")
def _(spark, d):
    other = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise("A")
    rows = grid_cells(spark, d).withColumn("other", other)
    left, right = (lookups.distinct_texts(rows, "l_orderkey", c).withColumnRenamed("texts", c) for c in ("l_returnflag", "other"))
    return left.join(right, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), lookups.shares_text(F.col("l_returnflag"), F.col("other")).alias("overlap"))


# ---------------------------------------------------------------- aggregates and windows


@query("a04_normalised", "select l_orderkey, l_linenumber, l_partkey - min(l_partkey) over (partition by l_orderkey) as r, l_suppkey - min(l_suppkey) over (partition by l_orderkey) as k from " + _CELLS)
def _(spark, d):
    return cells.from_first(grid_cells(spark, d), "l_orderkey", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "r", "k")


@query("a06_sizes", "select l_orderkey, case when w = 0 or h = 0 then content_w else w end as width, case when w = 0 or h = 0 then content_h else h end as height, top, bottom from (select l_orderkey, sum(l_quantity) filter (where l_linenumber = 1) as content_w, sum(l_quantity) as content_h, (l_orderkey % 3)::double as w, (l_orderkey % 4)::double as h, min(l_partkey) as top, max(l_partkey + l_suppkey) as bottom from " + _CELLS + " group by l_orderkey)")
def _(spark, d):
    rows = grid_cells(spark, d)
    sums = rows.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("cw"), F.sum("l_quantity").alias("ch"))
    sums = sums.join(cells.extents(rows, "l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey")
    width, height = cells.resolved((F.col("l_orderkey") % 3).cast("double"), (F.col("l_orderkey") % 4).cast("double"), F.col("cw"), F.col("ch"))
    return sums.select("l_orderkey", width.alias("width"), height.alias("height"), "top", "bottom")


@query("a16_boundaries", "select l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_partkey % 20, l_partkey % 20 + l_linenumber])))), ',') as edges from " + _CELLS + " group by l_orderkey")
def _(spark, d):
    low = F.col("l_partkey") % 20
    return cells.boundaries(grid_cells(spark, d), "l_orderkey", F.array(low, low + F.col("l_linenumber"))).select("l_orderkey", F.array_join("edges", ",").alias("edges"))


@query("w10_overflow", f"with s as ({_SEGMENTS}) select user_id, event_id, coalesce(v + 20 > 250 and coalesce(max(v) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) > 0, false) as overflow from s")
def _(spark, d):
    rows = sequence.overflows(_segments(spark, d), "user_id", "event_id", "v", F.col("v") + 20, 250.0)
    return rows.select("user_id", "event_id", "overflow")


@query("w18_page_breaks", "select doc_id, string_agg(case when ord > 0 and ord % 7 = 0 then '---' || chr(10) || chr(10) || line else line end, chr(10) order by ord) as body from (" + _LINES + ") group by doc_id")
def _(spark, d):
    rows = render.page_breaks(lines(spark, d).withColumn("b", F.col("ord") % 7 == 0), "doc_id", "ord", "b")
    return sequence.joined(rows.withColumn("o", F.struct("ord", "sub")), "doc_id", "o", "line", "\n", "body")


# ---------------------------------------------------------------- text and boxes


@query("f05_inline_names", "select p_partkey, case when p_size % 2 = 0 then substr(p_brand, 1, 4) end as name from part")
def _(spark, d):
    data = F.when(F.col("p_size") % 2 == 0, F.concat(F.substring("p_brand", 1, 4).cast("binary"), F.unhex(F.lit("00" * 8)))).otherwise(F.unhex(F.lit("01" * 12)))
    return table(spark, d, "part").select("p_partkey", text.inline_name(data).alias("name"))


@query("f13_html_run", f"select doc_id, ord, '<span class=\"hrt cs' || doc_id || '\" style=\"font-size:' || {_num('doc_id')} || 'pt;color:rgb(' || (doc_id & 255) || ',' || ((doc_id >> 8) & 255) || ',0);\">' || (case when ord % 2 = 0 then '<u>' else '' end) || (case when ord % 3 = 0 then '<em>' else '' end) || regexp_replace(regexp_replace(line, '^ ', '&nbsp;'), ' $', '&nbsp;') || (case when ord % 3 = 0 then '</em>' else '' end) || (case when ord % 2 = 0 then '</u>' else '' end) || '</span>' as run from ({_LINES})")
def _(spark, d):
    i = F.col("doc_id")
    run = render.text_run(F.col("line"), i, i.cast("double"), i.bitwiseAND(F.lit(65535)), F.col("ord") % 3 == 0, F.col("ord") % 2 == 0, F.lit(False))
    return lines(spark, d).select("doc_id", "ord", run.alias("run"))


@query("f47_view_box", f"select p_partkey, '-2.5 -2.5 ' || {_num('p_size * 10 + 500')} || ' ' || {_num('p_partkey % 1000 + 500')} as box from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", units.view_box(F.col("p_size") / 10, F.col("p_partkey") % 1000 / 100).alias("box"))


def _mm(units_360: str) -> str:
    """SQL of lengths that are multiples of 360 units, which are exact hundredths of a millimetre."""
    return f"format('{{{{:.2f}}}}', ({units_360}) * 1.27)"


@query(
    "r24_line_box",
    f"select l_orderkey, l_linenumber, '<div class=\"hls ps' || l_linenumber || '\" style=\"line-height:' || {_mm('b')} || 'mm;white-space:nowrap;left:' || {_mm('l_suppkey')} || 'mm;top:' || {_mm('l_partkey')} || 'mm;height:' || {_mm('b + 1')} || 'mm;width:' || {_mm('l_partkey + 7')} || 'mm;' || case when l_linenumber % 2 = 0 then 'padding-left:' || {_mm('2')} || 'mm;' else '' end || '\">' || l_returnflag || '</div>' as box from (select *, l_partkey % 9 as b from {_CELLS})".replace("{{", "{").replace("}}", "}"),
)
def _(spark, d):
    u = lambda c: c.cast("long") * 360
    b = F.col("l_partkey") % 9
    pad = F.when(F.col("l_linenumber") % 2 == 0, F.lit(720))
    box = render.line_box(u(F.col("l_partkey")), u(b + 1), u(b), u(b), u(F.col("l_suppkey")), u(F.col("l_partkey") + 7), F.concat(F.lit("ps"), F.col("l_linenumber").cast("string")), F.col("l_returnflag"), indentation=pad)
    return grid_cells(spark, d).select("l_orderkey", "l_linenumber", box.alias("box"))


_HEAD = render.HTML_HEAD.replace("\n", "' || chr(10) || '")
_MID = render.HTML_BODY.replace("\n", "' || chr(10) || '")
_TAIL = render.HTML_END.replace("\n", "' || chr(10) || '")


@query(
    "r21_html_document",
    f"with p as (select doc_id, ord // 40 as page, string_agg('<p>' || line || '</p>', '' order by ord) as body from ({_LINES}) group by 1, 2) select doc_id, '{_HEAD}' || '.ps0 {{}}' || chr(10) || '{_MID}' || string_agg('<div class=\"hpa\" style=\"width:210mm;height:297mm;\"><div class=\"hcD\" style=\"left:20mm;top:24.99mm;\"><div class=\"hcI\">' || body || '</div></div></div>' || chr(10), '' order by page) || '{_TAIL}' as html from p group by doc_id",
)
def _(spark, d):
    rows = lines(spark, d).withColumn("page", F.floor(F.col("ord") / 40)).withColumn("body", F.concat(F.lit("<p>"), "line", F.lit("</p>")))
    return render.html_document(rows, "doc_id", "page", "ord", "body", F.lit(".ps0 {}\n"), F.lit(210.0), F.lit(297.0), F.lit(20.0), F.lit(24.99))


@query("r22_page_numbers", "select p_partkey, case when p_size % 4 > 0 then '-' || (p_partkey + 4) || '.' end as number from part")
def _(spark, d):
    position = F.when(F.col("p_size") % 4 > 0, "bottom_center").otherwise("none")
    number = render.page_number(position, F.col("p_partkey"), F.lit(5), F.lit("-\0"), F.lit(".\0"))
    return table(spark, d, "part").select("p_partkey", number.alias("number"))


@query("r30_svg_borders", f"select l_orderkey, l_linenumber, '<path d=\"M' || {_num('l_suppkey')} || ',0 L' || {_num('l_suppkey')} || ',' || {_num('l_partkey')} || '\" style=\"stroke:#' || format('{{:02X}}{{:02X}}{{:02X}}', l_partkey & 255, (l_partkey >> 8) & 255, 0) || ';stroke-linecap:butt;stroke-width:0.12;\"></path>' as path from {_CELLS}")
def _(spark, d):
    x, y = F.col("l_suppkey") / 100, F.col("l_partkey") / 100
    return grid_cells(spark, d).select("l_orderkey", "l_linenumber", render.svg_line(x, F.lit(0.0), x, y, F.col("l_partkey").bitwiseAND(F.lit(65535)), units.border_width(F.lit(1))).alias("path"))


@query("r05_page_info", "select o_orderkey, '**용지 크기**: ' || format('{:.2f}', o_custkey * 1.27) || 'mm x ' || format('{:.2f}', o_orderkey * 1.27) || 'mm' as size_line, '**용지 방향**: Vertical' as direction_line from orders")
def _(spark, d):
    c = F.col("o_custkey") * 360
    info = render.page_info(c, F.col("o_orderkey") * 360, c, c, c, c, F.lit("Vertical"))
    return table(spark, d, "orders").select("o_orderkey", info[0].alias("size_line"), info[1].alias("direction_line"))


@query("o01_numeric_sections", "select p_partkey, string_agg(s, ',' order by n, s) as sections from (select p_partkey, 'Contents/section' || x || '.xml' as s, x as n from part, (select unnest([10, 2, 0, 1]) as x)) group by p_partkey")
def _(spark, d):
    names = F.array(*[F.lit(f"Contents/section{k}.xml") for k in (10, 2, 0, 1)])
    rows = table(spark, d, "part").select("p_partkey", F.explode(names).alias("s")).withColumn("n", F.regexp_extract("s", r"section(\d+)", 1).cast("int"))
    return sequence.joined(rows.withColumn("o", F.struct("n", "s")), "p_partkey", "o", "s", ",", "sections")


# ---------------------------------------------------------------- places, edges and runs


@query("w03_style_segments", "with t as (select l_orderkey, 60::bigint as length from lineitem group by 1), s as (select l_orderkey, (l_partkey % 70)::bigint as position, max(l_suppkey) as shape from " + _CELLS + " group by 1, 2), p as (select l_orderkey, position as start from s where position <= 60 union select l_orderkey, 0 from t union select l_orderkey, 60 from t), r as (select *, lead(start) over (partition by l_orderkey order by start) as \"end\" from p) select r.l_orderkey, r.start, r.\"end\", (select max_by(s.shape, s.position) from s where s.l_orderkey = r.l_orderkey and s.position <= r.start) as shape_id from r where r.\"end\" is not null")
def _(spark, d):
    rows = grid_cells(spark, d)
    texts = rows.select("l_orderkey").distinct().withColumn("length", F.lit(60).cast("long"))
    shapes = rows.select("l_orderkey", (F.col("l_partkey") % 70).alias("position"), F.col("l_suppkey").alias("shape_id"))
    return sequence.style_segments(texts, shapes, "l_orderkey")


@query("j14_segment_shapes", "with g as (select distinct l_orderkey, (l_partkey % 50)::bigint as start, (l_partkey % 50 + 20)::bigint as fin from " + _CELLS + "), s as (select l_orderkey, (l_suppkey % 70)::bigint as at, max(l_linenumber) as shape from " + _CELLS + " group by 1, 2) select l_orderkey, start, 0::bigint as position, shape as shape_id from (select g.l_orderkey, g.start, max_by(s.shape, s.at) as shape from g join s on s.l_orderkey = g.l_orderkey and s.at <= g.start group by 1, 2) union all select g.l_orderkey, g.start, s.at - g.start, s.shape from g join s on s.l_orderkey = g.l_orderkey and s.at > g.start and s.at < g.fin")
def _(spark, d):
    rows = grid_cells(spark, d)
    start = F.col("l_partkey") % 50
    segments = rows.select("l_orderkey", start.alias("start"), (start + 20).alias("end"))
    shapes = rows.groupBy("l_orderkey", (F.col("l_suppkey") % 70).alias("at")).agg(F.max("l_linenumber").alias("shape_id"))
    return intervals.shapes_in_segments(segments, shapes, "l_orderkey", 16)


@query("j09_named_images", "select p_partkey, (i % 3)::int as index, case i % 3 when 0 then 'png' when 1 then 'bmp' else 'gif' end as extension from (select p_partkey, p_size % 5 as i from part) where i < 3")
def _(spark, d):
    images = table(spark, d, "part").select("p_partkey", F.lit("d").alias("doc"), F.concat(F.lit("image"), (F.col("p_size") % 5).cast("string")).alias("text"))
    names = ["BinData/image0.png", "BinData/image1.bmp", "BinData/image2.gif", "Contents/image3.png"]
    entries = spark.createDataFrame([("d", n, b"") for n in names], "doc string, name string, data binary")
    return lookups.with_named_item(images, package.binary_items(entries)).select("p_partkey", "index", "extension")


_DRAWN = "format('<path d=\"M{{{{}}}},{{{{}}}} L{{{{}}}},{{{{}}}}\" style=\"stroke:#{{{{:02X}}}}{{{{:02X}}}}00;stroke-linecap:butt;stroke-width:0.12;\"></path>', {}, {}, {}, {}, c & 255, c >> 8)"
_EDGE = [_DRAWN.format(*x).replace("{{", "{").replace("}}", "}") for x in (("0", "0", "0", "5 * n"), ("10", "0", "10", "5 * n"), ("'-0.06'", "0", "'10.06'", "0"), ("'-0.06'", "5 * r + 5", "'10.06'", "5 * r + 5"))]


@query(
    "r30_table_svg",
    f"with q as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as r, l_partkey & 65535 as c, count(*) over (partition by l_orderkey) as n from {_CELLS}) select l_orderkey, '<svg class=\"hs\" viewBox=\"-2.5 -2.5 15 ' || (5 * max(n) + 5) || '\" style=\"left:-2.5mm;top:-2.5mm;width:15mm;height:' || (5 * max(n) + 5) || 'mm;\"><defs></defs>' || string_agg({_EDGE[0]} || {_EDGE[1]} || {_EDGE[2]}, '') filter (where r = 0) || string_agg({_EDGE[3]}, '' order by r) || string_agg({_EDGE[3]}, '') filter (where r = n - 1) || '</svg>' as svg from q group by l_orderkey",
)
def _(spark, d):
    # tables of one column, a row a line; each cell has one line around it, the table none
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    line = F.struct(F.lit(1).alias("type"), F.lit(1).alias("width"), F.col("l_partkey").bitwiseAND(F.lit(65535)).alias("color"))
    sides = [line.alias(f"{s}_line") for s in tables.SIDES]
    cell = grid_cells(spark, d).select("l_orderkey", r.alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"), F.lit(0).alias("background"), *sides)
    empty = [F.lit(None).cast("struct<type:int,width:int,color:bigint>").alias(f"{s}_line") for s in tables.SIDES]
    whole = cell.groupBy("l_orderkey").agg((F.max("row") + 1).alias("rows")).select("l_orderkey", "rows", F.lit(None).cast("double").alias("height"), F.array(F.lit(1)).alias("row_sizes"), *empty)
    return tables.svgs(cell, whole, "l_orderkey")


@query("a12_fill_patterns", "with q as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) as r, l_partkey % 3 as c from " + _CELLS + "), f as (select l_orderkey, c, min(r) as first from q where c > 0 group by 1, 2) select l_orderkey, string_agg('<pattern id=\"w_0' || k || '\" width=\"10\" height=\"10\" patternUnits=\"userSpaceOnUse\"><rect width=\"10\" height=\"10\" fill=\"rgb(' || c || ',0,0)\" /></pattern>', '' order by k) as defs from (select *, row_number() over (partition by l_orderkey order by first) - 1 as k from f) group by l_orderkey")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    cell = grid_cells(spark, d).select("l_orderkey", r.alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"), (F.col("l_partkey") % 3).alias("background"))
    whole = cell.groupBy("l_orderkey").agg((F.max("row") + 1).alias("rows")).select("l_orderkey", "rows", F.lit(None).cast("double").alias("height"), F.array(F.lit(1)).alias("row_sizes"))
    return tables.fills(cell, whole, "l_orderkey").select("l_orderkey", "defs")


def _grid(spark, d):
    """Cells of a table an order: two columns, rows by line number, some of two rows."""
    n = F.col("l_linenumber") - 1
    size = lambda c, k: (F.col(c) % k + 1).cast("double")
    cell = grid_cells(spark, d).select("l_orderkey", F.floor(n / 2).cast("int").alias("row"), (n % 2).cast("int").alias("col"), F.when(F.col("l_partkey") % 4 == 0, 2).otherwise(1).alias("row_span"), size("l_partkey", 8).alias("width"), (F.col("l_suppkey") % 5).cast("double").alias("height"))
    tables = cell.groupBy("l_orderkey").agg((F.max("row") + 1).alias("rows"), F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_orderkey") % 40).cast("double")).alias("height"))
    return cell, tables.withColumn("row_sizes", F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.when(r % 2 == 0, 720).otherwise(1)))


_GRID = "c as (select l_orderkey, (l_linenumber - 1) // 2 as r, (l_linenumber - 1) % 2 as k, case when l_partkey % 4 = 0 then 2 else 1 end as s, (l_partkey % 8 + 1)::double as w, (l_suppkey % 5)::double as h from " + _CELLS + "), t as (select l_orderkey, max(r) + 1 as n, case when l_orderkey % 3 > 0 then (l_orderkey % 40)::double end as th from c group by l_orderkey), g as (select t.l_orderkey, t.n, t.th, x.r, case when x.r % 2 = 0 then 720 else 1 end as size from t, lateral (select unnest(range(t.n)) as r) x), m as (select g.*, (select max(c.h) from c where c.l_orderkey = g.l_orderkey and c.r = g.r and c.s = 1) as cell from g)"


@query("a08_row_edges", f"with {_GRID}, e as (select l_orderkey, r, sum(coalesce(cell, case when th > 0 then th / n end, size / 7200.0 * 25.4)) over (partition by l_orderkey order by r) as y from m) select l_orderkey, count(*) + 1 as n, round(max(y), 6) as bottom, round(min(y), 6) as second from e group by l_orderkey")
def _(spark, d):
    cell, tables = _grid(spark, d)
    edges = cells.row_edges(cell, tables, "l_orderkey")
    return edges.select("l_orderkey", F.size("edges").cast("long").alias("n"), F.round(F.element_at("edges", -1), 6).alias("bottom"), F.round(F.element_at("edges", 2), 6).alias("second"))


@query("f48_cell_boxes", f"with {_GRID}, hh as (select *, case when size >= 100 then greatest(coalesce(cell, 0), size / 7200.0 * 25.4) when coalesce(cell, 0) > 0 then cell else coalesce(th / n, 0) end as rh from m), b as (select c.*, coalesce((select sum(o.w) from c o where o.l_orderkey = c.l_orderkey and o.r = c.r and o.k < c.k), 0.0) as x, coalesce((select sum(rh) from hh where hh.l_orderkey = c.l_orderkey and hh.r < c.r), 0.0) as y, coalesce((select sum(rh) from hh where hh.l_orderkey = c.l_orderkey and hh.r >= c.r and hh.r < c.r + c.s), 0.0) as z from c) select l_orderkey, r::int as \"row\", k::int as col, x::double as \"left\", round(y, 6)::double as top, round(case when z < 0.1 and h > 0.1 then h else z end, 6)::double as high from b")
def _(spark, d):
    cell, tables = _grid(spark, d)
    return cells.cell_boxes(cell, tables, "l_orderkey").select("l_orderkey", "row", "col", "left", F.round("top", 6).alias("top"), F.round("high", 6).alias("high"))


@query("r31_table_sizes", f"with {_GRID}, q as (select l_orderkey, sum(coalesce(cell, case when th > 0 then th / n end, size / 7200.0 * 25.4)) as rows_mm, any_value(th) as th from m group by l_orderkey), w as (select l_orderkey, sum(w) as wide from c where r = 0 group by l_orderkey), z as (select l_orderkey, coalesce(wide, 0) as wide, case when th is null or rows_mm > th * 1.1 then rows_mm else th end as high from q left join w using (l_orderkey)) select l_orderkey, floor(wide * 100 + 0.5) / 100 as content_width, floor(high * 100 + 0.5) / 100 as content_height from z")
def _(spark, d):
    cell, tables = _grid(spark, d)
    return cells.content_sizes(cell, tables, "l_orderkey")


@query("j19_segment_lines", "with b as (select l_orderkey, (l_linenumber - 1) // 3 as r, (l_linenumber - 1) % 3 as k, case when l_partkey % 6 = 0 then null else l_returnflag || l_linenumber end as f from " + _CELLS + "), g as (select distinct l_orderkey, (x * 10)::double as x, (y * 10)::double as y0, (y * 10 + 10)::double as y1 from b, lateral (select unnest(range(4)) as x), lateral (select unnest(range(3)) as y)) select g.l_orderkey, g.x, g.y0, g.y1, coalesce((select min_by(f, (r, k)) from b where b.l_orderkey = g.l_orderkey and b.k * 10 + 10 = g.x and b.r * 10 = g.y0 and f is not null), (select min_by(f, (r, k)) from b where b.l_orderkey = g.l_orderkey and b.k * 10 = g.x and b.r * 10 = g.y0 and f is not null)) as line from g")
def _(spark, d):
    n = F.col("l_linenumber") - 1
    r, k = F.floor(n / 3), n % 3
    line = F.when(F.col("l_partkey") % 6 > 0, F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    at = lambda c, more=0: (c * 10 + more).cast("double")
    boxes = grid_cells(spark, d).select("l_orderkey", r.alias("row"), k.alias("col"), at(k).alias("begin"), at(k, 10).alias("end"), at(r).alias("from"), at(r, 10).alias("to"), line.alias("left"), line.alias("right"))
    segments = boxes.select("l_orderkey").distinct().withColumn("x", F.explode(F.array(*[F.lit(10.0 * i) for i in range(4)]))).withColumn("y0", F.explode(F.array(*[F.lit(10.0 * i) for i in range(3)]))).withColumn("y1", F.col("y0") + 10)
    return cells.segment_lines(segments, boxes, "l_orderkey", "right", "left")


@query("a09_line_heights", "select l_orderkey, sum(l_partkey)::bigint as height from " + _CELLS + " group by l_orderkey")
def _(spark, d):
    rows = grid_cells(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("line_height"))).alias("segments"))
    return rows.select("l_orderkey", cells.line_height(F.col("segments")).alias("height"))


@query("a13_first_page_def", "select o_custkey, min_by(o_orderpriority, o_orderkey) as paper, min(o_orderkey) as first from orders group by o_custkey")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("paper"), F.col("o_orderkey").alias("first"))
    return lookups.first_row(rows, "o_custkey", "o_orderkey", ["paper", "first"])


@query("p08_blocks", "select p_partkey, p_size % 4 <> 3 as block from part")
def _(spark, d):
    part = F.when(F.col("p_size") % 4 == 0, media.image_markdown(F.lit("x"))).when(F.col("p_size") % 4 == 1, F.lit("| a |")).when(F.col("p_size") % 4 == 2, F.lit("---")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.is_block(part).alias("block"))


@query("p07_controls", "select p_partkey, p_size % 6 < 4 as shown, case p_size % 6 when 0 then case when p_partkey % 2 = 0 then '' else '**표**: ' || p_name || chr(10) || chr(10) || '*[표 내용은 추출되지 않았습니다]*' end when 1 then '' when 2 then '## 머리말' when 3 then '## 꼬리말' when 4 then '## 각주' else '' end as placeholder from part")
def _(spark, d):
    names = F.array(*[F.lit(n) for n in ("tbl ", "gso ", "head", "foot", "fn  ", "pgnp")])
    ident = F.get(names, F.col("p_size") % 6)
    return table(spark, d, "part").select("p_partkey", text.shows_control(ident).alias("shown"), text.control_placeholder(ident, F.concat(F.lit(" "), "p_name"), F.col("p_partkey") % 2 == 0).alias("placeholder"))


@query("p09_plausible_cells", "select l_orderkey, l_linenumber, l_partkey % 4 < 3 and l_suppkey % 3 < 2 and l_partkey % 5 <> 0 and l_suppkey % 7 <> 0 as plausible from " + _CELLS)
def _(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return grid_cells(spark, d).select("l_orderkey", "l_linenumber", cells.plausible(p % 4, s % 3, p % 5, s % 7, F.lit(3), F.lit(2)).alias("plausible"))


@query("f10_byte_index", "select doc_id, ord, case when ord % 7 < length(line) then strlen(substr(line, 1, (ord % 7)::int))::bigint end as at from (" + _LINES + ")")
def _(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.byte_index("line", F.col("ord") % 7).alias("at"))


_PLACES = ["none", "top_left", "top_center", "top_right", "bottom_left", "bottom_center", "bottom_right", "outside_top"]


@query("f49_page_number_place", "select p_partkey, case p_size % 8 when 0 then null when 1 then 12.7 when 3 then 101.6 when 4 then 12.7 when 6 then 101.6 else 63.5 end::double as x, case p_size % 8 when 0 then null when 1 then 50.8 when 2 then 50.8 when 3 then 50.8 else 190.5 end::double as y from part")
def _(spark, d):
    u = lambda inches: F.lit(int(inches * 7200))
    position = F.get(F.array(*[F.lit(n) for n in _PLACES]), F.col("p_size") % 8)
    x, y = units.page_number_place(position, u(5), u(8), u(0.25), u(0.75), u(2), u(0.5), u(0.25))
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query("f09_local_names", "select p_partkey, case when p_size % 2 = 0 then 'tbl' else 'p' end as name from part")
def _(spark, d):
    tag = F.when(F.col("p_size") % 2 == 0, F.lit("hp:tbl")).otherwise(F.lit("p"))
    return table(spark, d, "part").select("p_partkey", text.local_name(tag).alias("name"))


@query("f68_relative_folder", "select p_partkey, '../images/BIN' || format('{:04X}', p_partkey) || '.png' as url from part")
def _(spark, d):
    folder = media.relative_folder("/out/images", "/out/html")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit(folder + "/"), media.item_name("p_partkey", F.lit("png"))).alias("url"))


@query("r25_image_box", f"select p_partkey, '<div class=\"hsR\" style=\"top:' || {_num('p_size * 127')} || 'mm;left:1.27mm;width:' || {_num('p_partkey * 127')} || 'mm;height:2.54mm;background-repeat:no-repeat;background-size:contain;background-image:url(''images/x.png'');\"></div>' as box from part")
def _(spark, d):
    u = lambda c: c.cast("long") * 360
    box = render.image_box(F.lit("images/x.png"), F.lit(360), u(F.col("p_size")), u(F.col("p_partkey")), F.lit(720))
    return table(spark, d, "part").select("p_partkey", box.alias("box"))


@query("j21_captions", "with a as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as k from " + _CELLS + " where l_partkey % 2 = 0), b as (select l_orderkey, l_returnflag || l_linenumber as caption, row_number() over (partition by l_orderkey order by l_linenumber) as k from " + _CELLS + " where l_suppkey % 2 = 0) select a.l_orderkey, a.l_linenumber, caption from a left join b using (l_orderkey, k)")
def _(spark, d):
    rows = grid_cells(spark, d)
    captions = rows.where("l_suppkey % 2 = 0").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("caption"))
    out = intervals.positional(rows.where("l_partkey % 2 = 0").select("l_orderkey", "l_linenumber"), captions, "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "caption")


@query("f67_package_mime", "select p_partkey, case p_size % 9 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/svg+xml' when 3 then 'image/webp' when 4 then 'image/tiff' when 5 then 'image/x-icon' when 6 then 'image/emf' when 7 then 'image/wmf' else 'application/octet-stream' end as mime from part")
def _(spark, d):
    ends = F.array(*[F.lit(e) for e in ("JPG", "png", "svg", "webp", "tif", "ico", "emf", "WMF", "xyz")])
    return table(spark, d, "part").select("p_partkey", media.package_mime(F.get(ends, F.col("p_size") % 9)).alias("mime"))
