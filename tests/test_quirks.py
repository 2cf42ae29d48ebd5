"""Decisions on odd cases of whole documents, each on a small file of its own."""

import struct

import pytest

from quillspark import catalog_assembly as A
from quillspark.operators import assembly
from quillspark.sources import compound, layouts, records, writers


def document(body, info=b"", more=None, properties=(1, 1, 1, 1, 1, 1, 1)):
    head = writers.record(16, 0, struct.pack("<7H3I", *properties, 0, 0, 0))
    streams = {"FileHeader": writers.file_header(0x05010000, 1), "DocInfo": writers.deflate(head + info), "BodyText/Section0": writers.deflate(body)}
    return assembly.Document(compound.read_compound(writers.compound(streams | (more or {}))), "images")


def text(s, **kw):
    return A._para(0, A._units(s), **kw)


def body(d):
    return d.parts()["body"]


def test_page_breaks_are_not_joined():
    assert body(document(text("A") + text("", divide=4) + text("B", divide=1))) == ["A", "---\n", "---\n", "B"]
    assert body(document(text("A", divide=4) + text("B", divide=2))) == ["A", "B"]  # the first paragraph breaks nothing, columns break no page


def outline(level, spacing=None):
    raw = struct.pack("<I6i3H4h", 1 << 23 | level << 25, *[0] * 6, 0, 0, 0, 0, 0, 0, 0) + bytes(4)
    return writers.record(25, 1, raw + (b"" if spacing is None else bytes(4) + struct.pack("<i", spacing)))


def numbering(formats, extended=()):
    levels = b"".join(struct.pack("<IhhI", 0, 0, 0, 0) + writers.string(f) + struct.pack("<HI", 1, 1) for f in formats)
    return writers.record(23, 1, levels + b"".join(writers.string(e) for e in extended))


def test_outline_levels():
    shapes = A._shape(0) + outline(0) + outline(1) + outline(6) + outline(6, 7) + outline(6, 9)
    got = body(document(b"".join(text(f"t{k}", shape=k) for k in (0, 1, 2, 2, 1, 2, 3, 3, 4, 1)), A._style(0) + numbering(["^1."] * 7, ["^8.", "\0\0"]) + shapes))
    # the eighth level counts nothing; a higher level restarts those below it
    assert got == ["t0", "1. t1", "가. t2", "나. t2", "2. t1", "가. t2", "① t3", "② t3", "0. t4", "3. t1"]
    # a format of NULs hides the number and does not count, an empty one shows it; a tenth level without a format is plain
    hidden = document(b"".join(text(f"t{k}", shape=k) for k in (1, 2, 1, 5)), A._style(0) + numbering(["\0", "", *["^1"] * 5]) + shapes)
    assert body(hidden) == ["t1", "가. t2", "t1", "t5"]


def test_deep_levels_come_from_line_spacing_not_from_the_name():
    styles = writers.record(26, 1, writers.string("개요 9") + writers.string("x") + struct.pack("<BBhHH", 0, 0, 0, 0, 0))
    assert body(document(text("a", shape=1), A._style(0) + styles + numbering(["^1"] * 7, ["^8"]) + A._shape(0) + outline(6, 7))) == ["0. a"]


def test_positions_of_styles_count_stored_units():
    # a tab takes eight units but shows one character; Markdown uses the stored position as it is, HTML corrects it
    raw = "a".encode("utf-16-le") + A._mark(9, bytes(4)) + "bcdefghij".encode("utf-16-le") + b"\r\0"
    head = struct.pack("<IIHBBHHHI", len(raw) // 2, 0, 0, 0, 0, 2, 0, 1, 0)
    lines = writers.record(69, 1, struct.pack("<IiiiiiiiI", 0, 0, 1, 1, 1, 0, 0, 1, 0) + struct.pack("<IiiiiiiiI", 10, 0, 1, 1, 1, 0, 0, 1, 0))
    made = writers.record(66, 0, head) + writers.record(67, 1, raw) + writers.record(68, 1, struct.pack("<4I", 0, 0, 4, 1)) + lines
    d = document(made, A._style(0) + A._style(2) + A._shape(0))
    assert body(d) == ["a\tbc**defghij**"]
    assert ["".join(r["text"] for r in row[-2]) for row in d.lines()] == ["a\tb", "cdefghij"]


def test_text_of_lines_that_start_at_the_same_place_is_shown_once():
    # half of one character is none: both lines start at 0
    raw = compound.read_compound(A.lined_file(1, "A\nbc", "ko", "web"))
    d = assembly.Document(raw, "images")
    assert [[r["text"] for r in row[-2]] for row in d.lines()] == [[], ["A"], ["b"], ["c"]]


def test_first_style_in_markdown_last_in_html():
    raw = A._units("abcd")
    head = struct.pack("<IIHBBHHHI", 5, 0, 0, 0, 0, 3, 0, 1, 0)
    made = writers.record(66, 0, head) + writers.record(67, 1, raw) + writers.record(68, 1, struct.pack("<6I", 0, 0, 2, 1, 2, 2)) + writers.record(69, 1, struct.pack("<IiiiiiiiI", 0, 0, 1, 1, 1, 0, 0, 1, 0))
    d = document(made, A._style(0) + A._style(2) + A._style(1) + A._shape(0))
    assert body(d) == ["ab**cd**"] and [r["style"] for row in d.lines() for r in row[-2]] == [0, 2]


def test_bare_items_and_embedded_images():
    info = writers.record(18, 1, struct.pack("<HH", 1, 1) + writers.string("png")) + A._style(0) + A._shape(0)
    picture = writers.record(76, 2, b"cip$" * 2 + bytes(60)) + writers.record(85, 3, bytes(68) + bytes(3) + struct.pack("<H", 1) + bytes(5))
    shown = A._para(0, A._units(""), A._control(b"gso ", bytes(42), picture), mask=1 << 11)
    for stored in (b"BMxx", writers.deflate(b"BMxx")):
        d = document(shown, info, {"BinData/BIN0001": stored})
        d.folder = None
        assert body(d) == ["![이미지](data:image/bmp;base64,Qk14eA==)"]
    assert body(document(shown, info, {"BinData/BIN0001": b"", "BinData/BIN0001.png": b"x"})) == ["![이미지](images/BIN0001.png)"]
    assert body(document(shown, info)) == []


def note(ident, *paragraphs):
    return A._para(0, A._units(""), A._control(ident, bytes(8), A._list() + b"".join(paragraphs)), mask=1 << 17)


def test_notes_of_both_kinds_count_from_one():
    d = document(text("a") + note(b"fn  ", A._para(2, A._units("one"))) + note(b"en  ", A._para(2, A._units("two"))) + note(b"fn  ", A._para(2, A._units("three")), A._para(2, A._units("four"))))
    got = d.parts()
    assert got["body"] == ["a [^1] [^1] [^2]"] and got["footnotes"] == ["one", "three", "four"] and got["endnotes"] == ["two"]
    assert body(document(note(b"fn  ", A._para(2, A._units("x"))))) == ["[^1]"]


def test_texts_of_paragraphs_that_carry_notes_inside_controls_are_left_out():
    inner = writers.record(66, 2, struct.pack("<IIHBBHHHI", 5, 1 << 17, 0, 0, 0, 0, 0, 0, 0)) + writers.record(67, 3, A._units("lost")) + writers.record(71, 3, b"  nf" + bytes(8))
    d = document(text("a") + note(b"fn  ", inner, A._para(2, A._units("kept"))))
    assert d.parts()["footnotes"] == ["kept"]


def numbers_of(d):
    return [row[3:5] for row in d.display_numbers()]


def auto(kind, shape=0):
    return A._control(b"atno", struct.pack("<IH3H", kind | shape << 4, 0, 0, 0, 0), b"")


def new(kind, n):
    return A._control(b"newn", struct.pack("<IHH", kind, n, 0), b"")


def test_new_numbers_count_before_automatic_ones():
    numbered = lambda *controls: A._para(0, A._mark(18, b"onta") + A._units("x"), b"".join(controls), mask=1 << 18)
    made = numbered(auto(4)) + numbered(auto(4), new(4, 9), new(4, 20)) + numbered(auto(4, 2)) + numbered(auto(3)) + numbered(auto(9))
    assert numbers_of(document(made, properties=(1, 1, 1, 1, 5, 7, 1))) == [(0, 7), (0, 20), (2, 21), (0, 5)]


def test_numbers_in_notes_are_arabic_and_go_on_over_pages():
    one = A._para(2, A._mark(18, b"onta") + A._units("x"))
    for method in (0, 2):  # to go on, and to restart with each page
        shape = writers.record(74, 1, struct.pack("<I3HH4hBBI", 2 | method << 10, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0))
        first = A._para(0, A._units("s"), shape)
        assert numbers_of(document(first + note(b"fn  ", one) + note(b"fn  ", one) + note(b"en  ", one))) == [(0, 3), (0, 4), (0, 3)]


def test_cells_at_one_place_and_outside():
    cell = lambda r, c, *t: A._list(*[A._para(2, A._units(x)) for x in t], cell=(c, r, 1, 1))
    grid = lambda *cells: A._para(0, A._units(""), A._control(b"tbl ", bytes(42), writers.record(77, 2, struct.pack("<IHHh4h2HHH", 0, 2, 2, 0, 0, 0, 0, 0, 2, 2, 1, 0)) + b"".join(cells)), mask=1 << 11)
    assert body(document(grid(cell(0, 0), cell(0, 0, "a"), cell(0, 1, "b"), cell(0, 1, "c"), cell(1, 0, "d|e", "f"), cell(7, 0, "out")))) == ["\n| a  | b  |\n|---|---|\n| d\\|e <br>f  |   |\n  \nc  \nout"]  # what is in no cell follows
    assert body(document(grid())) == ["\n\n[Empty Table: 2x2]\n\n"]
    # all cells in one row: a new row begins where the column does not grow
    assert body(document(grid(cell(0, 0, "a"), cell(0, 1, "b")))) == ["\n| a  | b  |\n|---|---|\n|   |   |\n"]


def test_short_records_are_errors_of_their_row():
    char = layouts.LAYOUTS["char_shape"]
    for n in (66, 67):
        with pytest.raises(layouts.RecordError):
            char.decode(bytes(n))
    with pytest.raises(layouts.RecordError):
        records._table(struct.pack("<IHHh4h", 0, 60_000, 2, 0, 0, 0, 0, 0) + bytes(4))
    assert layouts.CONTROLS.get("%hlk") is None


def test_broken_documents_give_one_row(spark):
    good = A.rich_file(3, "a\nb", "x", "y")
    files = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[:900])), ("none", bytearray(b"zz")), ("empty", bytearray(b""))], "path string, content binary")
    got = assembly.parts(files).collect()
    assert {r["doc"] for r in got if r["error"] is None} == {"good"} and [r["doc"] for r in got if r["error"]] == ["cut"]
    assert assembly.markdowns(files).count() == 1 and assembly.lines(files).where("doc = 'cut'").count() == 0
