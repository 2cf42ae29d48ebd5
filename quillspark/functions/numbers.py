"""Numbers as text: list and page numbers in the shapes that documents use. All are JVM-side expressions over an integer column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SYLLABLES = ["가", "나", "다", "라", "마", "바", "사", "아", "자", "차", "카", "타", "파", "하"]
JAMO = ["ㄱ", "ㄴ", "ㄷ", "ㄹ", "ㅁ", "ㅂ", "ㅅ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
HANGUL_DIGITS = ["일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]
CHINESE_DIGITS = ["一", "二", "三", "四", "五", "六", "七", "八", "九"]
STEMS = ["갑", "을", "병", "정", "무", "기", "경", "신", "임", "계"]
STEMS_CHINESE = ["甲", "乙", "丙", "丁", "戊", "己", "庚", "辛", "壬", "癸"]
ROMAN = {
    "M": ["", "M", "MM", "MMM", "MMMM", "MMMMM", "MMMMMM", "MMMMMMM", "MMMMMMMM", "MMMMMMMMM"],
    "C": ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    "X": ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    "I": ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
}


def _run(first: int, n: int) -> list[str]:
    return [chr(first + k) for k in range(n)]


CIRCLED = [*_run(0x2460, 20), *_run(0x3251, 15)]
CIRCLED_UPPER, CIRCLED_LOWER = _run(0x24B6, 26), _run(0x24D0, 26)
CIRCLED_SYLLABLES, CIRCLED_JAMO = _run(0x326E, 14), _run(0x3260, 14)
CIRCLED_CHINESE = _run(0x3280, 10)

#: Codes of number shapes, as attribute bits hold them.
SHAPES = [
    "arabic", "circled_arabic", "roman_upper", "roman_lower", "alpha_upper", "alpha_lower", "circled_alpha_upper", "circled_alpha_lower",
    "hangul", "circled_hangul", "hangul_jamo", "circled_hangul_jamo", "hangul_number", "chinese_number", "circled_chinese_number",
    "heavenly_stem", "heavenly_stem_chinese",
]


def _n(n: Column | str) -> Column:
    return (F.col(n) if isinstance(n, str) else n).cast("long")


def _look_up(n: Column, values: list[str]) -> Column:
    """The n-th value from 1; null beyond."""
    return F.get(F.array(*[F.lit(v) for v in values]), (n - 1).cast("int"))


def arabic(n: Column | str) -> Column:
    return _n(n).cast("string")


def roman(n: Column | str) -> Column:
    """Upper case; empty for 0, as many M as there are thousands."""
    n = _n(n)

    def digit(letter: str, unit: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in ROMAN[letter]]), (F.floor(n / unit) % 10).cast("int"))

    return F.concat(F.repeat(F.lit("M"), F.floor(n / 10_000).cast("int") * 10), digit("M", 1000), digit("C", 100), digit("X", 10), digit("I", 1))


def alpha(n: Column | str, upper: bool = True) -> Column:
    """Bijective base 26: 1 is A, 27 is AA; empty for 0. Unsigned 32-bit numbers have at most seven letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"
    start = F.struct(_n(n).alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        letter = F.substring(F.lit(letters), ((acc["left"] - 1) % 26 + 1).cast("int"), F.lit(1))
        more = acc["left"] > 0
        return F.struct(
            F.when(more, F.floor((acc["left"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("left"),
            F.when(more, F.concat(letter, acc["out"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["out"])


def circled_number(n: Column | str) -> Column:
    return F.coalesce(_look_up(_n(n), CIRCLED), arabic(n))


def circled_alpha(n: Column | str, upper: bool = True) -> Column:
    return F.coalesce(_look_up(_n(n), CIRCLED_UPPER if upper else CIRCLED_LOWER), alpha(n, upper))


def _cyclic(n: Column | str, values: list[str]) -> Column:
    n = _n(n)
    return F.when(n == 0, arabic(n)).otherwise(_look_up((n - 1) % len(values) + 1, values))


def gana(n: Column | str) -> Column:
    return _cyclic(n, SYLLABLES)


def jamo(n: Column | str) -> Column:
    return _cyclic(n, JAMO)


def circled_gana(n: Column | str) -> Column:
    return F.coalesce(_look_up(_n(n), CIRCLED_SYLLABLES), gana(n))


def circled_jamo(n: Column | str) -> Column:
    return F.coalesce(_look_up(_n(n), CIRCLED_JAMO), jamo(n))


def _counted(n: Column | str, digits: list[str], ten: str) -> Column:
    """1 to 99 in words, without a one before ten; else arabic."""
    n = _n(n)
    tens, ones = F.floor(n / 10).cast("long"), n % 10
    word = F.concat(
        F.when(tens > 1, _look_up(tens, digits)).otherwise(F.lit("")),
        F.when(tens > 0, F.lit(ten)).otherwise(F.lit("")),
        F.when(ones > 0, _look_up(ones, digits)).otherwise(F.lit("")),
    )
    return F.when((n >= 1) & (n <= 99), word).otherwise(arabic(n))


def hangul_number(n: Column | str) -> Column:
    return _counted(n, HANGUL_DIGITS, "십")


def chinese_number(n: Column | str) -> Column:
    return _counted(n, CHINESE_DIGITS, "十")


def circled_chinese(n: Column | str) -> Column:
    return F.coalesce(_look_up(_n(n), CIRCLED_CHINESE), chinese_number(n))


def heavenly_stem(n: Column | str, chinese: bool = False) -> Column:
    return _cyclic(n, STEMS_CHINESE if chinese else STEMS)


def format_number(shape: Column | str, n: Column | str) -> Column:
    """n in the shape named by a column; shapes that repeat user symbols, and unknown ones, are arabic."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    made = {
        "roman_upper": roman(n), "roman_lower": F.lower(roman(n)), "alpha_upper": alpha(n), "alpha_lower": alpha(n, False),
        "circled_arabic": circled_number(n), "circled_alpha_upper": circled_alpha(n), "circled_alpha_lower": circled_alpha(n, False),
        "hangul": gana(n), "hangul_jamo": jamo(n), "circled_hangul": circled_gana(n), "circled_hangul_jamo": circled_jamo(n),
        "hangul_number": hangul_number(n), "chinese_number": chinese_number(n), "circled_chinese_number": circled_chinese(n),
        "heavenly_stem": heavenly_stem(n), "heavenly_stem_chinese": heavenly_stem(n, True),
    }
    out = None
    for name, value in made.items():
        out = F.when(shape == name, value) if out is None else out.when(shape == name, value)
    return out.otherwise(arabic(n))


def outline_label(level: Column | str, n: Column | str) -> Column:
    """Label of an outline paragraph: ``1.`` ``가.`` ``1)`` ``가)`` ``(1)`` ``(가)`` and circled numbers for levels 1 to 7."""
    level = F.col(level) if isinstance(level, str) else level
    n = _n(n)
    number, syllable = arabic(n), F.when(n == 0, F.lit("")).otherwise(gana(n))
    circled = F.when(n <= 20, circled_number(n)).otherwise(number)
    return (
        F.when(level == 2, F.concat(syllable, F.lit(".")))
        .when(level == 3, F.concat(number, F.lit(")")))
        .when(level == 4, F.concat(syllable, F.lit(")")))
        .when(level == 5, F.concat(F.lit("("), number, F.lit(")")))
        .when(level == 6, F.concat(F.lit("("), syllable, F.lit(")")))
        .when(level == 7, circled)
        .otherwise(F.concat(number, F.lit(".")))
    )


def version(v: Column | str, padded: bool = False) -> Column:
    """0xMMnnPPrr as ``M.n.P.r``, or with two digits a part after the first."""
    v = _n(v)
    parts = [F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]
    return F.format_string("%d.%02d.%02d.%02d", *parts) if padded else F.concat_ws(".", *[p.cast("string") for p in parts])
