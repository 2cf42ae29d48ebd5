"""Values that have to be just these, written out once more: the queries' SQL is made from the library's own tables."""

from quillspark.functions import bits, media, numbers, text, units
from quillspark.operators import render
from quillspark.plans import lookups
from quillspark.sources import layouts


def test_numbers():
    assert "".join(numbers.SYLLABLES) == "가나다라마바사아자차카타파하" and "".join(numbers.JAMO) == "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
    assert "".join(numbers.HANGUL_DIGITS) == "일이삼사오육칠팔구" and "".join(numbers.CHINESE_DIGITS) == "一二三四五六七八九"
    assert "".join(numbers.STEMS) == "갑을병정무기경신임계" and "".join(numbers.STEMS_CHINESE) == "甲乙丙丁戊己庚辛壬癸"
    assert [ord(c) for c in numbers.CIRCLED] == [*range(0x2460, 0x2474), *range(0x3251, 0x3260)]
    assert [ord(c) for c in numbers.CIRCLED_UPPER] == list(range(0x24B6, 0x24D0)) and [ord(c) for c in numbers.CIRCLED_LOWER] == list(range(0x24D0, 0x24EA))
    assert [ord(c) for c in numbers.CIRCLED_SYLLABLES] == list(range(0x326E, 0x327C)) and [ord(c) for c in numbers.CIRCLED_JAMO] == list(range(0x3260, 0x326E))
    assert [ord(c) for c in numbers.CIRCLED_CHINESE] == list(range(0x3280, 0x328A))
    assert numbers.ROMAN["C"][4] == "CD" and numbers.ROMAN["X"][9] == "XC" and numbers.ROMAN["I"][8] == "VIII" and numbers.ROMAN["M"][3] == "MMM"
    assert numbers.SHAPES[2] == "roman_upper" and numbers.SHAPES[9] == "circled_hangul" and numbers.SHAPES[16] == "heavenly_stem_chinese" and len(numbers.SHAPES) == 17


def test_flags():
    assert bits.DOCUMENT_FLAGS == (
        "compressed encrypted distribution script drm xml_template history electronic_signature certificate_encryption signature_preview certificate_drm ccl mobile_optimized privacy_security track_change kogl video_control table_of_contents"
    ).split()
    assert bits.LICENSE_FLAGS == "ccl_kogl copy_restricted copy_allowed_same_condition".split()
    assert sorted(bits.CONTROL_FLAGS) == [2, 3, 4, 8, 9, 10, 11, 13, 15, 16, 17, 18, 21, 22, 23, 24, 30, 31] and bits.CONTROL_FLAGS[16] == "header_footer" and bits.CONTROL_FLAGS[17] == "footnote_endnote"


def test_lengths_and_names():
    assert units.BORDER_WIDTHS == [0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1, 1.5, 2, 3, 4, 5]
    assert units.PAGE_DEFAULTS == {"height": 297.0, "top": 24.99, "bottom": 10.0, "header": 0.0, "footer": 0.0}
    assert media.MIME == {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp"} and media.FILETIME_EPOCH == 116444736000000000
    assert text.SINGLE == (0, 10, 13, 24, 30, 31) and text.CONVERTIBLE == (9, 10, 13, 24, 30, 31) and text.CONTROL_NAMES[18] == "AUTO_NUMBER" and text.CONTROL_NAMES[31] == "FIXED_SPACE"
    assert lookups.DEFAULT_FONT == render.DEFAULT_FONT == "함초롬바탕"


def test_tags():
    assert layouts.FIRST == 16 and layouts.DOC_TAGS["style"] == 10 and layouts.DOC_TAGS["para_shape"] == 9 and layouts.DOC_TAGS["numbering"] == 7
    assert layouts.BODY_TAGS["para_header"] == 50 and layouts.BODY_TAGS["ctrl_header"] == 55 and layouts.BODY_TAGS["table"] == 61 and layouts.BODY_TAGS["picture"] == 69
    assert {k: v for k, v in layouts.DOC_LEVELS.items() if v == 0}.keys() == {"document_properties", "id_mappings", "doc_data", "distribute_doc_data", "compatible_document", "forbidden_char"}


def test_fixed_texts():
    assert render.TITLE == "# HWP 문서" and render.VERSION_LABEL == "**버전**: " and (render.FOOTNOTES, render.ENDNOTES) == ("## 각주", "## 미주")
    assert render.TABLE_OPEN == '\n<table border="1" cellpadding="5" cellspacing="0" style="border-collapse: collapse;">\n'
    rules = render.FIXED_CSS.split("\n")
    assert rules[0] == "body {margin:0;padding-left:0;padding-right:0;padding-bottom:0;padding-top:2mm;}" and rules[4] == ".hhi {display:inline-block;margin:0;padding:0;position:relative;background-size:contain;}"
    assert rules[22:30] == [f".hs{x} {{margin:0;padding:0;position:absolute;{y}}}" for x, y in (("L", ""), ("T", "overflow:hidden;"), ("E", "overflow:hidden;"), ("A", "overflow:hidden;"), ("P", "overflow:hidden;"), ("V", "overflow:hidden;"), ("O", ""), ("U", "overflow:hidden;"))]
    assert rules[-2:] == ["[onclick] {cursor:pointer;}", ""] and rules[-3] == ".hls {clear:both;}" and len(rules) == 58
