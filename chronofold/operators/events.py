"""From texts to validated events.

Texts become lines or sentences with a sequence number; each line's fields are columns of one wide projection; validation
adds a reason column instead of raising. Per document only the fill-down of the weekday (a window) and the choice of the branch
(a partial aggregate) need a shuffle, both by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import extract as X
from chronofold.functions import text as N
from chronofold.operators.calendar import first_meeting
from chronofold.sources.tables import kept


def numbered(df: DataFrame, parts: Column, keys: list[str]) -> DataFrame:
    """One row per part with its 1-based ``line_no``."""
    return df.select(*keys, F.posexplode(parts).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as the session shuffles to. Texts made from a few columns lie in few and small files, and their rules cost far more than their bytes tell;
    with a number of its own this exchange is not coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row. A projection above another may be merged with it, which repeats costly
    expressions wherever they are used; a generator of one row in between keeps them apart."""
    each = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once"))
    return each.select(*df.columns, *[F.col(f"__once.{k}").alias(k) for k in columns])


def course_lines(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Course rows of each document; a line without a weekday takes the last one above it."""
    return _course_lines(spread(df, key), text_col, key)


def _course_lines(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """``course_lines`` of documents that are dealt by ``key`` already."""
    rows = numbered(df, N.lines(F.col(text_col)), [key]).withColumn("own_day", X.weekday(F.col("line")))
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("day_of_week", F.last("own_day", ignorenulls=True).over(above))
    line = F.col("line")
    rows = once(once(rows.where("day_of_week is not null"), n=N.normalize(line)), period=X.period_range(F.col("n"))).where("period is not null")
    rows = once(rows, location=X.location(F.col("n")), teacher=X.teacher(line), rule=X.week_rule(line))
    rows = once(rows, name=X.course_name(F.col("n"), F.col("teacher"), F.col("location"))).where("name <> ''")
    return rows.select(key, "line_no", "name", "teacher", "location", "day_of_week", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "rule.*", X.course_confidence(F.col("teacher"), F.col("location"), line, F.col("name")).alias("confidence"))


def clamp_confidence(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def date_time(date: Column, time: Column) -> Column:
    """Date and time as one string; any time but HH:MM becomes 09:00; null without a date."""
    return F.when(F.nullif(date, F.lit("")).isNotNull(), F.concat(date, F.lit("T"), F.when(time.rlike(r"\A[0-9]{2}:[0-9]{2}\z"), time).otherwise("09:00"), F.lit(":00")))


def validate_courses(raw: DataFrame) -> DataFrame:
    """``raw`` with a ``rejected`` reason (null if valid) and defaults filled in; checks in the order name, day, period."""
    name = N.trim(F.coalesce("name", F.lit("")))
    reason = (F.when(name == "", "缺少课程名称").when(~F.coalesce(F.col("day_of_week").between(1, 7), F.lit(False)), F.concat("name", F.lit(": 缺少星期信息")))
              .when(~F.coalesce(F.col("period_start") >= 1, F.lit(False)), F.concat("name", F.lit(": 缺少节次信息"))))
    first = F.coalesce("week_start", F.lit(1))
    return raw.withColumns({
        "rejected": reason, "name": name, "week_type": F.when(F.col("week_type").isin(schema.WEEK_TYPES), F.col("week_type")).otherwise("EVERY_WEEK"), "week_start": first, "week_end": F.coalesce(F.col("week_end"), first),
        "period_end": F.coalesce("period_end", "period_start"), "confidence": clamp_confidence(F.col("confidence")), "reminder_minutes": F.lit(10)})


def validate_events(raw: DataFrame) -> DataFrame:
    """``raw`` (title, type, date, time_start, time_end, seat_number, confidence, uncertain_fields) with a ``rejected`` reason and the event's fields."""
    title = N.trim(F.coalesce("title", F.lit("")))
    kind = F.when(F.col("type").isin(schema.EVENT_TYPES), F.col("type")).otherwise("REMINDER")
    start = date_time(F.col("date"), F.col("time_start"))
    reason = F.when(title == "", "缺少事件标题").when(start.isNull(), F.concat(title, F.lit(": 缺少日期")))
    warnings = F.when(F.size("uncertain_fields") > 0, F.transform("uncertain_fields", lambda f: F.concat(F.lit("字段不确定: "), f)))
    return raw.withColumns({"rejected": reason, "title": title, "type": kind, "start_time": start, "end_time": date_time(F.col("date"), F.col("time_end")), "seat_number": F.nullif(N.trim(F.col("seat_number")), F.lit("")),
                            "reminder_minutes": F.when(kind == "HOMEWORK", 120).otherwise(30), "confidence": clamp_confidence(F.col("confidence")), "warnings": warnings}).drop("date", "time_start", "time_end", "uncertain_fields")


def general_events(df: DataFrame, as_of: Column, forced: str | None = None, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Raw events of the sentences. Without a forced type, and for exams, a sentence needs a date; otherwise it falls on ``as_of``."""
    parts = N.exam_sentences(F.col(text_col)) if forced == "EXAM" else N.sentences(F.col(text_col))
    s = once(numbered(df, parts, [key]), n=N.normalize(F.col("line")), type=F.lit(forced) if forced else X.event_type(F.col("line")))
    s = once(s.where((F.col("type") != "EXAM") | ~X.is_exam_noise(F.col("line"))), date=X.date_of(F.col("n"), as_of))
    named = F.col("line").rlike("今天|今晚|明天|后天|本周|这周|下周|周[一二三四五六日天]")
    if forced in (None, "EXAM"):
        s = s.where(F.col("date").isNotNull() | named)
    s = once(s.withColumn("date", F.coalesce("date", as_of.cast("string"))), time=X.time_of(F.col("n")), location=X.location(F.col("n")))
    s = once(s, stripped=X.without_when_and_where(F.col("n"), F.col("location")))
    s = once(s, title=X.title_for(F.col("n"), F.col("type"), F.col("location"), F.col("stripped")))
    late = (F.col("type") == "HOMEWORK") & ~F.col("line").rlike("[0-9]{1,2}:[0-9]{2}|点")
    return s.select(key, "line_no", "title", "type", "date", F.when(late, "23:59").otherwise(F.col("time.start")).alias("time_start"), F.when(late, "23:59").otherwise(F.col("time.end")).alias("time_end"), "location",
                    F.when(F.col("type") == "EXAM", X.seat(F.col("n"), F.col("location"))).alias("seat_number"), F.when(F.col("type") == "HOMEWORK", "从校园信息中识别出的提交截止时间。").alias("description"), F.lit(0.82).alias("confidence"))


def natural_events(df: DataFrame, as_of: Column, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """One raw event for each text; without a date it falls on ``as_of``."""
    s = once(df.select(key, F.lit(1).alias("line_no"), F.col(text_col).alias("line")), n=N.normalize(F.col("line")), type=X.event_type(F.col("line")))
    s = once(s, time=X.time_of(F.col("n")), location=X.location(F.col("n")))
    s = once(s, stripped=X.without_when_and_where(F.col("n"), F.col("location")))
    s = once(s, title=X.title_for(F.col("n"), F.col("type"), F.col("location"), F.col("stripped")), date=F.coalesce(X.date_of(F.col("n"), as_of), as_of.cast("string")))
    late = (F.col("type") == "HOMEWORK") & ~F.col("line").rlike("[0-9]{1,2}:[0-9]{2}|点")
    return s.select(key, "line_no", "title", "type", "date", F.when(late, "23:59").otherwise(F.col("time.start")).alias("time_start"), F.when(late, "23:59").otherwise(F.col("time.end")).alias("time_end"),
                    "location", F.lit(None).cast("string").alias("seat_number"), F.lit(None).cast("string").alias("description"), F.lit(0.78).alias("confidence"))


def recognize(df: DataFrame, as_of: Column, text_col: str = "text", key: str = "doc_id", intent: Column | None = None, schedule: tuple[Column, DataFrame] | None = None) -> DataFrame:
    """All events of all texts: of the branches that apply to a text the first one with any event is taken.

    Branches in order: courses (course intent, or a text that speaks of courses), exams, homework, notices, one event for
    the whole text. A branch that gives nothing falls through, so the choice is a minimum over the events found. Texts are normalised and routed once and the events of the
    first branches are kept, so the last branch reads only the texts that these left.
    schedule: first day of the term and periods; with it courses get the times of their first week's meeting, or a ``warning`` where
    the periods are not defined.
    """
    raw = spread(df.select(key, F.col(text_col).alias("__raw"), F.lit(None).cast("string").alias("__asked") if intent is None else intent.alias("__asked")), key)
    # as generated columns they stay columns: the branches' filters do not repeat the expressions
    docs = kept(once(raw, text=N.normalize(F.col("__raw")), intent=X.route(F.col("__raw")) if intent is None else F.col("__asked")).select(key, "text", "intent"))
    event = "struct<title:string,type:string,start_time:string,end_time:string,location:string,seat_number:string,description:string,reminder_minutes:int,confidence:double,teacher:string,day_of_week:int,period_start:int,period_end:int,week_start:int,week_end:int,week_type:string,specific_weeks:array<int>" + (",warning:string>" if schedule else ">")
    fields = [f.split(":")[0] for f in event[7:-1].replace("array<int>", "x").split(",")]
    kinds = dict(f.split(":", 1) for f in event[7:-1].split(","))

    def shaped(e: DataFrame, branch: int) -> DataFrame:
        return e.where("rejected is null").select(key, "line_no", F.lit(branch).alias("branch"), *[(F.col(c) if c in e.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in fields])

    courses = docs.where((F.col("intent") == "COURSE") | F.col("text").rlike("课程|课表|教学计划"))
    c = validate_courses(_course_lines(courses, "text", key)).withColumn("title", F.col("name")).withColumn("type", F.lit("COURSE"))
    if schedule:
        c = first_meeting(c, *schedule).withColumnsRenamed({"first_start": "start_time", "first_end": "end_time"})
    empty = F.array().cast("array<string>")
    general = lambda d, forced: validate_events(general_events(d, as_of, forced, "text", key).withColumn("uncertain_fields", empty))
    parts = [shaped(c, 1), shaped(general(docs.where("intent = 'EXAM'"), "EXAM"), 2), shaped(general(docs.where("intent = 'HOMEWORK'"), "HOMEWORK"), 3),
             shaped(general(docs.where("intent in ('NOTICE', 'SCHEDULE')"), None), 4)]
    early = kept(reduce(DataFrame.unionByName, parts))
    had = early.select(F.col(key).alias("__had")).distinct().hint("merge")
    left = docs.where("text <> ''").join(had, F.col(key).eqNullSafe(F.col("__had")), "left_anti")
    last = shaped(validate_events(natural_events(left, as_of, "text", key).withColumn("uncertain_fields", empty)), 5)
    return early.withColumn("b", F.min("branch").over(Window.partitionBy(key))).where("branch = b").drop("b").unionByName(last).drop("branch")


def dashboard(events: DataFrame) -> DataFrame:
    """Mean confidence (0 without events), events to check, number of types."""
    return events.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count_if((F.col("confidence") < 0.85) | F.col("start_time").isNull()).alias("to_check"), F.count_distinct("type").alias("types"))
