"""Containers, framing and decoders on generated files and hand-made vectors."""

import struct

import fixture_writer as W
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import documents
from quillspark.sources import compound, layouts, package, records, sinks, streams, summary


def files(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_compound_streams_small_and_large():
    wanted = {"FileHeader": b"x" * 256, "BodyText/Section0": bytes(range(256)) * 40, "BodyText/Section1": b"", "Scripts/A": b"y" * 65}
    assert compound.read_compound(W.compound(wanted)) == wanted


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=9000), min_size=1, max_size=4))
def test_compound_round_trip(bodies):
    wanted = {f"S{k}": b for k, b in enumerate(bodies)}
    assert compound.read_compound(W.compound(wanted)) == wanted


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 3000))
def test_broken_compound_raises_only_its_own_errors(noise, cut):
    data = bytearray(W.compound({"A": b"z" * 5000, "B": b"q" * 100}))
    data[512 : 512 + len(noise)] = noise
    try:
        compound.read_compound(bytes(data[: max(0, len(data) - cut)]))
    except (compound.CompoundError, struct.error):
        pass


def test_framing_and_extended_size():
    data = W.record(66, 0, b"ab") + W.record(67, 1, b"c" * 5000) + W.record(1023, 1023, b"")
    assert [(t, lv, len(p)) for t, lv, p in records.frame(data)] == [(66, 0, 2), (67, 1, 5000), (1023, 1023, 0)]
    with pytest.raises(layouts.RecordError):
        list(records.frame(W.record(66, 0, b"abcd")[:-1]))


def test_documents_end_to_end(spark):
    body = ["첫 문단", "  ", "two\tb", "끝"]
    xml = '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:t>하나</hp:t></hp:run></hp:p><hp:p/><hp:p><hp:run><hp:t>a</hp:t><hp:tab leader="3" width="6000"/><hp:t>b</hp:t></hp:run></hp:p></hs:sec>'
    df = files(spark, {"a": W.document(body), "b": W.package({"section0": xml, "section10": xml, "section2": xml}), "c": b"no document", "d": W.document(["x"])[:700], "e": None or b""})
    got = {r["doc"]: r["text"] for r in documents.plain_texts(spark, df).collect()}
    assert got["a"].split("\n")[0] == "첫 문단" and got["a"].split("\n")[-1] == "끝"
    assert got["b"] == "\n".join(["하나", "a.....b"] * 3)
    assert set(got) == {"a", "b"}
    assert {r["doc"]: r["format"] for r in documents.formats(df).collect()} == {"a": "compound", "b": "package", "c": "unknown", "d": "compound", "e": "unknown"}
    md = {r["doc"]: r["markdown"] for r in documents.markdowns(spark, df).collect()}
    assert md["a"].startswith("# HWP 문서\n\n\n\n**버전**: 5.01.00.00\n\n\n\n첫 문단\n\n")
    assert {r["doc"]: r["sections"] for r in documents.section_counts(spark, df).collect()} == {"a": 1, "b": 3}
    assert compound.streams(df).where("error is not null").count() == 1


def test_dictionaries_and_header(spark):
    s = compound.streams(files(spark, {"a": W.document(["x"])}))
    framed = records.records(compound.inflated(s.where("name = 'DocInfo'")))
    assert records.dictionary(framed, "face_name").select("idx", "name").collect()[0] == (0, "바탕")
    style = records.dictionary(framed, "style").first()
    assert (style["local_name"], style["english_name"], style["kind"], style["para_shape_id"]) == ("본문", "Body", "paragraph", 3)
    assert records.typed(framed, "document_properties").first()["area_count"] == 1
    head = records.file_headers(s)
    assert head.select(sinks.header_json(head).alias("j")).first()["j"] == '{"signature":"HWP Document File","version":"5.1.0.0","document_flags":["compressed"],"license_flags":[],"encrypt_version":4,"kogl_country":0}'


def test_text_runs():
    units = [0x41, 9, 600, 0, 0, 0, 0, 0, 9, 0x42, 10, 0x43, 11, 0x6C62, 0x2074, 0, 0, 0, 0, 11, 13]
    runs = records.text_runs(struct.pack(f"<{len(units)}H", *units))
    assert [(r["kind"], r["position"]) for r in runs] == [("text", 0), ("control", 1), ("text", 9), ("control", 10), ("text", 11), ("control", 12), ("control", 20)]
    assert runs[1]["width"] == 600 and runs[5]["chid"] == "blt "
    assert records.text_runs(struct.pack("<2H", 0xD800, 0x41)) == []


@pytest.mark.parametrize("kind", sorted(set(layouts.LAYOUTS) | set(records.SPECIAL)))
def test_short_payloads_raise_record_errors(kind):
    _, decode = records.decoder(kind, layouts.LAYOUTS | layouts.CONTROL_LAYOUTS)
    for n in range(0, 120, 3):
        try:
            row = decode(bytes(n))
        except layouts.RecordError:
            continue
        assert isinstance(row, dict)


@pytest.mark.parametrize("kind", sorted(set(layouts.LAYOUTS) | set(layouts.CONTROL_LAYOUTS)))
def test_layouts_make_columns(kind):
    layout = (layouts.LAYOUTS | layouts.CONTROL_LAYOUTS)[kind]
    row = layout.decode(bytes(max(layout.least, 200)))
    assert all(f"`{k}`" in layout.ddl() for k in row)


@pytest.mark.parametrize("kind", sorted(set(layouts.LAYOUTS) | set(layouts.CONTROL_LAYOUTS)))
def test_rows_at_once_are_the_same_rows(kind):
    import numpy as np
    import pyarrow as pa

    layout = (layouts.LAYOUTS | layouts.CONTROL_LAYOUTS)[kind]
    fixed = layout.record_type()
    if fixed is None:
        assert layout.decode_all(pa.array([bytes(300)], pa.binary())) is None
        return
    rng = np.random.default_rng(1)
    size = max(layout.least, fixed.itemsize)
    rows = [rng.bytes(4 + size + int(rng.integers(0, 5))) for _ in range(50)]
    whole = layout.decode_all(pa.array([b"x", *rows], pa.binary()).slice(1), 4)
    assert {k: v.to_pylist() for k, v in whole.items()} == {k: [layout.decode(r[4:])[k] for r in rows] for k in whole} and set(whole) == set(layout.decode(rows[0][4:]))
    assert layout.decode_all(pa.array([*rows, bytes(4 + size - 1)], pa.binary()), 4) is None


def test_record_vectors(spark):
    char = struct.pack("<7H7B7b7B7b", *range(7), *[100] * 7, *[0] * 7, *[100] * 7, *[0] * 7) + struct.pack("<iIbbIIII", 1000, 0b11 | 1 << 18, 0, 0, 0xFF0000, 0, 0, 0) + struct.pack("<HI", 2, 5)
    row = layouts.LAYOUTS["char_shape"].decode(char)
    assert row["base_size"] == 1000 and row["bold"] and row["italic"] and row["strikethrough"] == 1 and row["text_color"] == 0xFF0000 and row["border_fill_id"] == 2 and row["strikethrough_color"] == 5
    assert layouts.LAYOUTS["char_shape"].decode(char[:68])["border_fill_id"] is None
    table = struct.pack("<IHHh4h2HHH", 0, 2, 2, 0, 1, 2, 3, 4, 1, 2, 7, 1) + struct.pack("<5H", 0, 0, 1, 1, 3)
    t = records._table(table)
    assert (t["rows"], t["cols"], t["border_fill_id"], t["zones"]) == (2, 2, 7, [{"start_col": 0, "start_row": 0, "end_col": 1, "end_row": 1, "fill": 3}])
    cell = struct.pack("<hHI", 1, 0, 1 << 5) + struct.pack("<4H2I4hH", 1, 2, 1, 3, 500, 600, 1, 2, 3, 4, 9)
    assert records._list_header(cell)["cell"]["row_span"] == 3 and records._list_header(cell)["vertical_align"] == "center"
    assert records.fill(struct.pack("<IIIi", 1, 0xFFFFFF, 0, -1))["background_color"] == 0xFFFFFF
    assert records.fill(struct.pack("<I6h2I", 4, 1, 0, 0, 0, 50, 2, 1, 2))["gradient_colors"] == [1, 2]
    bag = struct.pack("<Hh", 5, 2) + struct.pack("<HH", 1, 4) + struct.pack("<i", -3) + struct.pack("<HH", 2, 1) + W.text("가")
    assert records.parameter_set(bag)[0]["items"] == [{"id": 1, "type": "i4", "value": -3}, {"id": 2, "type": "bstr", "value": "가"}]
    body = W.record(71, 1, b" lbt" + bytes(60)) + W.record(71, 1, b"wonk\1\2")
    framed = records.records(spark.createDataFrame([("d", "s", bytearray(body))], "doc string, name string, data binary"))
    assert records.controls(framed, "object_common").first()["ctrl_id"] == "tbl "
    assert records.controls(framed, "other").count() == 1
    ns = records.tree(records.records(spark.createDataFrame([("d", "s", bytearray(W.record(66, 0, b"") + W.record(71, 1, b"") + W.record(72, 3, b"") + W.record(77, 2, b"") + W.record(66, 0, b"")))], "doc string, name string, data binary")))
    assert [r["parent"] for r in ns.orderBy("seq").collect()] == [None, 0, 1, 1, None]


def test_summary_property_set():
    def prop(kind, body):
        return struct.pack("<I", kind) + body

    texts = {2: "제목".encode("cp949") + b"\0", 4: "김".encode("cp949") + b"\0"}
    props = [(1, prop(2, struct.pack("<hh", 949, 0)))] + [(k, prop(30, struct.pack("<I", len(v)) + v.ljust(8, b"\0"))) for k, v in texts.items()]
    props += [(14, prop(3, struct.pack("<i", 12))), (12, prop(64, struct.pack("<Q", 116444736000000000 + 10_000_000 * 86_400))), (13, prop(64, struct.pack("<Q", 5)))]
    at, table, body = 8 + 8 * len(props), b"", b""
    for k, v in props:
        table += struct.pack("<II", k, at + len(body))
        body += v
    data = b"\xfe\xff\0\0" + bytes(20) + struct.pack("<I", 1) + bytes(16) + struct.pack("<I", 48) + struct.pack("<II", at + len(body), len(props)) + table + body
    got = summary.read_summary(data)
    assert got == {"title": "제목", "author": "김", "page_count": 12, "created": "1970-01-02T09:00:00+09:00", "last_saved": "1970-01-01T00:00:00+09:00"}
    with pytest.raises((ValueError, struct.error)):
        summary.read_summary(b"zz" * 40)


def test_package_tables_and_items(spark):
    xml = (
        '<s xmlns:hp="p"><hp:p><hp:run><hp:tbl><hp:caption><hp:p><hp:t>표 1</hp:t></hp:p></hp:caption><hp:tr><hp:tc><hp:cellAddr rowAddr="0" colAddr="0"/><hp:cellSpan rowSpan="1" colSpan="2"/><hp:p><hp:t>x</hp:t></hp:p></hp:tc>'
        "<hp:tc><hp:p><hp:t>y</hp:t></hp:p></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></s>"
    )
    rows = package.entries(files(spark, {"p": W.package({"section0": xml, "section1": "<broken"}, {"BinData/image1.png": b"png", "Preview/PrvText.txt": "미리".encode()}), "q": b"PK\3\4broken"}))
    got = package.nodes(package.sections(rows)).orderBy("section", "ord").collect()
    assert [(r["kind"], r["row"], r["col"], r["col_span"], r["text"]) for r in got if r["section"] == 0] == [("caption", None, None, None, "표 1"), ("cell", 0, 0, 2, "x"), ("cell", 0, 2, 1, "y")]
    assert [r["error"] is not None for r in got if r["section"] == 1] == [True]
    assert package.binary_items(rows).first()["stem"] == "image1"
    assert package.preview_text(rows).first()["text"] == "미리"
    assert rows.where("doc = 'q' and error is not null").count() == 1


def test_binary_items_and_previews(spark, tmp_path):
    more = {"BinData/BIN0001.png": W.deflate(b"image"), "PrvText": "보기".encode("utf-16-le"), "PrvImage": b"GIF89a...", "Scripts/JScriptVersion": W.deflate(struct.pack("<II", 1, 2))}
    s = compound.streams(files(spark, {"a": W.document(["x"], more)}))
    info = W.record(18, 1, struct.pack("<HH", 1, 1) + W.text("png"))
    framed = records.records(spark.createDataFrame([("a", "DocInfo", bytearray(info))], "doc string, name string, data binary"))
    items = streams.binary_items(s, records.dictionary(framed, "bin_data"))
    assert [(r["index"], bytes(r["data"])) for r in items.collect()] == [(1, b"image")]
    assert streams.preview_text(s).first()["text"] == "보기" and streams.preview_images(s).first()["format"] == "GIF"
    assert streams.script_versions(s).first()["low"] == 2
    sinks.write_images(items, f"{tmp_path}/images")
    assert spark.read.parquet(f"{tmp_path}/images").first()["file"] == "BIN0001.png"
    assert sinks.export_images(items, f"file://{tmp_path}/files") == 1


def test_streaming_files(spark, tmp_path):
    from quillspark.streaming.files import arriving_files, decode_arriving, event_windows

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(W.document(["하나"]))
    query = decode_arriving(arriving_files(spark, f"{tmp_path}/in"), lambda b: documents.plain_texts(spark, b), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.processAllAvailable()
    (tmp_path / "in" / "b.bin").write_bytes(W.document(["둘"]))
    query.processAllAvailable()
    query.stop()
    assert {r["text"].strip() for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"하나", "둘"}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()
