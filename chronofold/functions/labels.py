"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels
WEEKDAY_NAMES = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]
WEEK_TYPE_LABELS = {"EVERY_WEEK": "每周", "ODD_WEEK": "单周", "EVEN_WEEK": "双周", "SPECIFIC_WEEKS": "指定周"}
EVENT_TYPE_LABELS = {"COURSE": "课程", "EXAM": "考试", "HOMEWORK": "作业", "MEETING": "会议", "ACTIVITY": "活动", "REMINDER": "提醒"}
SOURCE_LABELS = {"IMAGE": "图片", "PDF": "PDF", "EXCEL": "Excel", "TEXT": "文本", "MANUAL": "手动", "OCR_STUB": "识别示例", "AI": "AI"}


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The label of a code; the code itself if it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def weekday_name(day: Column) -> Column:
    return F.when(day.between(1, 7), F.try_element_at(F.array(*[F.lit(x) for x in WEEKDAY_NAMES]), day)).otherwise("未知星期")


def week_rule(start: Column, end: Column, kind: Column) -> Column:
    return F.concat(F.lit("第 "), start, F.lit("-"), end, F.lit(" 周 "), looked_up(kind, WEEK_TYPE_LABELS))


def week_type_label(kind: Column) -> Column:
    return F.when(kind == "ODD_WEEK", "单周").when(kind == "EVEN_WEEK", "双周").when(kind == "SPECIFIC_WEEKS", "指定周").otherwise("全周")


def slot(start: Column, end: Column) -> Column:
    return F.concat(F.lit("第 "), start, F.lit("-"), end, F.lit(" 节"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "高置信").when(c >= 0.7, "需核对").otherwise("低置信")


def event_time(start: Column, end: Column) -> Column:
    """Start and end in words; the end's date only where it differs."""
    flat = lambda x: F.substring(F.replace(x, F.lit("T"), F.lit(" ")), 1, 16)
    tail = F.when(F.substring(end, 1, 10) == F.substring(start, 1, 10), F.substring(end, 12, 5)).otherwise(flat(end))
    return F.when(F.nullif(start, F.lit("")).isNull(), "时间待确认").when(F.nullif(end, F.lit("")).isNull(), flat(start)).otherwise(F.concat(flat(start), F.lit("-"), tail))


def event_place(location: Column, classroom: Column) -> Column:
    return F.coalesce(location, classroom, F.lit("地点待补充"))


def event_rule(kind: Column, start: Column, end: Column, week_type: Column, rrule: Column) -> Column:
    """The week rule of a course; whether any other event repeats."""
    return F.when((kind == "COURSE") & start.isNotNull(), week_rule(start, end, week_type)).otherwise(F.when(F.nullif(rrule, F.lit("")).isNotNull(), "重复事件").otherwise("单次事件"))


def when_text(kind: Column, day: Column, period_start: Column, period_end: Column, start: Column, end: Column) -> Column:
    """Weekday and slot of a course, start and end of any other event."""
    return F.when((kind == "COURSE") & day.isNotNull(), F.concat(weekday_name(day), F.lit(" "), slot(period_start, period_end))).otherwise(event_time(start, end))
