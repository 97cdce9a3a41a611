"""Bell schedules from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import text as N
from chronofold.operators.events import numbered, once, spread

_CLOCK = "[0-9]{1,2}:[0-9]{2}"
_NUMBER = "[一二三四五六七八九十]{1,2}|[0-9]{1,2}"
_HEAD = "节次|上课时间|下课时间|开始时间|结束时间"


def period_of(line: Column) -> Column:
    """struct(number, start, end) of one line, number first or times first; null for anything else."""
    by_number = rf"(?:第{N.WS}*)?({_NUMBER}){N.WS}*[节课]?[^0-9]+({_CLOCK})[^0-9]+({_CLOCK})"
    by_time = rf"({_CLOCK}){N.WS}*{N.DASH}{N.WS}*({_CLOCK})[^0-9]+(?:第{N.WS}*)?({_NUMBER}){N.WS}*[节课]?"

    def pick(n: Column, p: str, a: int, b: int, c: int) -> Column:
        # searched once; what was found is taken apart
        part = lambda m: F.struct(N.number(F.regexp_replace(F.regexp_extract(m, p, a), "[第节课]", ""), 15).alias("number"), N.padded_time(F.regexp_extract(m, p, b)).alias("start"), N.padded_time(F.regexp_extract(m, p, c)).alias("end"))
        return N.let(N.found(n, p, 0), lambda m: F.when(m.isNotNull(), part(m)))

    out = N.let(N.schedule_line(line), lambda n: F.when(n.rlike(_HEAD) & ~n.rlike(_CLOCK), None).otherwise(F.coalesce(pick(n, by_number, 1, 2, 3), pick(n, by_time, 3, 1, 2))))
    return N.let(out, lambda x: F.when(x["number"] > 0, x))


def period_label(number: Column) -> Column:
    names = F.array(*[F.lit(x) for x in schema.NUMERALS[1:16]])
    return F.concat(F.lit("第"), F.when(number.between(1, 15), F.try_element_at(names, number)).otherwise(number.cast("string")), F.lit("节"))


def parse_schedule(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(periods, warnings). The first line that defines a period number counts; lines that are neither periods nor headings are warned about by number."""
    rows = once(numbered(spread(df, key), N.pieces(N.trim(F.col(text_col)), "[\n\r；;]"), [key]), p=period_of(F.col("line")))
    good = rows.where("p is not null").groupBy(key, F.col("p.number").alias("period_number")).agg(F.min_by("p", "line_no").alias("p"))
    periods = good.select(key, "period_number", F.col("p.start").alias("start_time"), F.col("p.end").alias("end_time"), period_label(F.col("period_number")).alias("label"))
    bad = rows.where(F.col("p").isNull() & ~F.col("line").rlike(_HEAD))
    return periods, bad.select(key, "line_no", F.concat(F.lit("第 "), F.col("line_no"), F.lit(" 行未识别为作息节次："), F.col("line")).alias("warning"))
