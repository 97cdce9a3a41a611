"""Text normalisation as column functions.

White space means what it means in the source material: Unicode spaces, the no-break space and the byte-order mark
included. Word borders are ASCII ones, written as lookarounds, because \\b is Unicode-aware here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold import schema

WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
DASH = "[-~至到]"
LEFT, RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Regex replacements one after the other."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none. The group must not be able to match nothing: one pass tells both."""
    return filled(F.regexp_extract(c, pattern, group))


def filled(c: Column) -> Column:
    """Null for an empty text. ``nullif`` would compute the text twice, and twice more in every text made from it."""
    return F.try_element_at(F.array_remove(F.array(c), F.lit("")), F.lit(1))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


# fixed values: misreadings of character recognition, as pairs of pattern and replacement
MISREAD = [("颥", "颐"), ("刈象", "对象"), ("健从", "健康"), (rf"颐德楼{WS}*旧{WS}*([0-9]{{2}})", "颐德楼H1$1"), ("经肚楼", "经世楼")]
MISREAD_SIGNS = "颥|刈象|健从|旧|经肚楼"
SEAT_WORDS = "分散|集中|闭卷|开卷"


def normalize(c: Column) -> Column:
    """Full-width punctuation, dashes and split digits put right; known misreadings repaired; trimmed."""
    times = ((rf"{LEFT}([0-9]){WS}+([0-9]){WS}*:", "$1$2:"), (rf"([0-9]{{1,2}}){WS}*:{WS}*([0-9]{{2}})", "$1:$2"), (rf"([0-9]{{1,2}}:[0-9]{{2}}){WS}*[一-]{WS}*([0-9]{{1,2}}:[0-9]{{2}})", "$1-$2"))
    seats = (rf"{LEFT}([0-9]){WS}+([0-9])(?={WS}*(?:{SEAT_WORDS}|\z))", "$1$2")
    # each group of repairs only where a text holds what it looks for
    c = let(F.translate(c, "：—–－～\u00a0", ":---~ "), lambda x: F.when(x.rlike(rf"[0-9]{WS}*:"), chain(x, *times)).otherwise(x))
    c = let(c, lambda x: F.when(x.rlike(MISREAD_SIGNS), chain(x, *MISREAD)).otherwise(x))
    return let(c, lambda x: trim(F.when(x.rlike(rf"[0-9]{WS}+[0-9]"), F.regexp_replace(x, *seats)).otherwise(x)))


def pieces(c: Column, separators: str) -> Column:
    """Trimmed, non-empty parts of a trimmed text: separators take the white space around them."""
    return F.array_remove(F.split(c, f"{WS}*{separators}{WS}*"), "")


def lines(c: Column) -> Column:
    return pieces(normalize(c), "[\n\r；;]")


def sentences(c: Column) -> Column:
    return pieces(normalize(c), "[\n\r。；;]")


def exam_text(c: Column) -> Column:
    """Exam tables from character recognition: repaired dates, a line for each date with a time."""
    return chain(normalize(c), ("[丨|]", " "), ("[QO]300", "(13:00"), ("I300", "(13:00"), (r"2026[^0-9]{0,3}[0-9]{0,2}([0-9]{2})([0-9]{2})[H日]?", "2026年$1月$2日"),
                 (rf"(\A|[^0-9])(0?[1-9]|1[0-2]){WS}*([0-9]{{2}}){WS}*[H日]?{WS}*(?=\()", "$1$2月$3日"),
                 (rf"(?=(?:20[0-9]{{2}}{WS}*年{WS}*)?[0-9]{{1,2}}{WS}*月{WS}*[0-9]{{1,2}}{WS}*日?{WS}*\(?{WS}*[0-9]{{1,2}}{WS}*:{WS}*[0-9]{{2}})", "\n"))


def exam_sentences(c: Column) -> Column:
    return let(pieces(trim(exam_text(c)), "[\n\r。；;]"), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(sentences(c)))


def route_text(c: Column) -> Column:
    c = F.translate(c, "：—–－一", ":----")
    return chain(c, (rf"{LEFT}([0-9]){WS}+([0-9]){WS}*:", "$1$2:"), (rf"([0-9]{{1,2}}){WS}*:{WS}*([0-9]{{2}})", "$1:$2"))


_WORDY = "[\u4e00-\u9fa5A-Za-z0-9]"
# fixed values: misreadings in cells of images
CELL_MISREAD = [("箅法", "算法"), ("计机网络", "计算机网络"), ("顳德|颐律|颐德接|颐德檯|颐德妾", "颐德楼"), ("经世DI", "经世楼D1"), ("经世拶", "经世楼"), ("晨排球场", "晨曦排球场")]


def compact_cell(c: Column) -> Column:
    """Text of a recognised cell: no spaces between letters or digits."""
    c = F.translate(c, "：／〈《〉》．", ":/(()).")
    return trim(chain(c, (rf"(?<={_WORDY}){WS}+(?={_WORDY})", ""), *CELL_MISREAD, (rf"{WS}+", " ")))


def compact_exam_row(c: Column) -> Column:
    """Text of a recognised exam row."""
    c = F.translate(c, "：／（）．—–－一", ":/().----")
    han = "[\u4e00-\u9fa5]"
    c = chain(c, (rf"(?<={han}){WS}+(?={han})", ""), *MISREAD, *[(rf"{b}{WS}*([A-Za-z]){WS}+([0-9]{{2,4}})", f"{b}$1$2") for b in ("经世楼", "颐德楼")],
              (rf"{LEFT}([0-9]){WS}+([0-9])(?={WS}*(?:{SEAT_WORDS}|\z))", "$1$2"), (rf"{WS}+", " "))
    return trim(c)


def number(c: Column, last: int = 24) -> Column:
    """Digits or a Chinese numeral as a number, else null."""
    table = F.create_map(*[F.lit(x) for pair in schema.numeral_map(last).items() for x in pair])
    return let(c, lambda x: F.when(x.rlike(r"\A[0-9]+\z"), x.try_cast("int")).otherwise(F.try_element_at(table, x)))


def remove_first(c: Column, literal: Column) -> Column:
    """The first occurrence of a literal becomes a space; null or empty literals leave the text."""
    at = F.instr(c, literal)
    return F.when(F.nullif(literal, F.lit("")).isNull() | (at == 0), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(" "), F.substring(c, at + F.length(literal), F.length(c))))


def clock_text(c: Column) -> Column:
    """Spoken clock times (8点半, 8点5分, 8点) as H:MM."""
    c = chain(c, (rf"([0-9]{{1,2}}){WS}*点{WS}*半", "$1:30"), (rf"([0-9]{{1,2}}){WS}*点{WS}*([0-9]{{2}}){WS}*分?", "$1:$2"), (rf"([0-9]{{1,2}}){WS}*点{WS}*([0-9]){WS}*分?", "$1:0$2"))
    return F.regexp_replace(c, rf"([0-9]{{1,2}}){WS}*点", "$1:00")


def schedule_line(c: Column) -> Column:
    return trim(F.regexp_replace(F.translate(clock_text(c), "：—–－～", ":---~"), rf"{WS}+", " "))


def padded_time(c: Column) -> Column:
    return let(F.split(c, ":"), lambda x: F.concat(F.lpad(x[0], 2, "0"), F.lit(":"), F.lpad(x[1], 2, "0")))
