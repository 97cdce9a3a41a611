"""Requests, older shapes and fallbacks brought to the engine's own form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions.extract import DAY, route
from chronofold.functions.text import WS, found, trim


def requested_intent(asked: Column, text: Column) -> Column:
    """An explicit intent as it is; AUTO, natural language and none are routed by the text."""
    return F.when(asked.isNull() | asked.isin("AUTO", "NATURAL_LANGUAGE", ""), route(text)).otherwise(asked)


def requested_source(asked: Column, natural_input: Column) -> Column:
    """A request's source; without one, text where something was typed in, else the example of recognition."""
    return F.coalesce(F.nullif(asked, F.lit("")), F.when(natural_input != "", "TEXT").otherwise("OCR_STUB"))


def requested_periods(periods: Column) -> Column:
    """The periods of a request's template, an array of structs like ``schema.PERIOD``; those of the default template where there are none."""
    names = [f.split()[0] for f in schema.PERIOD.split(", ")]
    default = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in schema.PERIODS])
    return F.when(F.size(periods) > 0, periods).otherwise(default)


def first_result(df: DataFrame, strategies: list[str]) -> DataFrame:
    """The first strategy's text that is not blank, with the strategy's name. Costly strategies are computed for rows where the cheaper ones gave nothing: filter, compute, union."""
    text = F.coalesce(*[F.nullif(trim(F.col(s)), F.lit("")) for s in strategies])
    name = F.coalesce(*[F.when(F.nullif(trim(F.col(s)), F.lit("")).isNotNull(), s) for s in strategies])
    return df.withColumn("result", text).withColumn("strategy", name)


def from_flat_course(flat: DataFrame) -> DataFrame:
    """Flat course rows (course_name, teacher, location, day_of_week, ...) as events with a nested course."""
    course = F.struct("course_name", "teacher", F.col("location").alias("classroom"), "day_of_week", "period_start", "period_end", "week_start", "week_end", "week_type", "specific_weeks")
    return flat.select("id", F.col("course_name").alias("title"), F.lit("COURSE").alias("type"), "location", F.lit("AI").alias("source"), "confidence", "user_edited", "week_type", course.alias("course"))


def draft_of(events: DataFrame) -> DataFrame:
    """The editable form of events: defaults for what is missing."""
    c = lambda f, d: F.coalesce(F.col(f"course.{f}"), F.lit(d))
    return events.select("id", "title", F.coalesce("location", "course.classroom", F.lit("")).alias("place"), c("day_of_week", 1).alias("day_of_week"), c("period_start", 1).alias("period_start"), F.coalesce("course.period_end", "course.period_start", F.lit(1)).alias("period_end"),
                         c("week_start", 1).alias("week_start"), c("week_end", 16).alias("week_end"), F.coalesce("reminder_minutes", F.lit(30)).alias("reminder_minutes"))


def entry_line(title: Column, details: Column, header: Column) -> Column:
    """The line of a page entry: weekday, periods, title, teacher, place, weeks; null without weekday or periods."""
    d = F.regexp_replace(details, rf"{WS}+", "")
    day = F.when(header.rlike(f"\\A星期{DAY}\\z"), F.replace(F.concat(F.lit("周"), F.substring(header, 3, 1)), F.lit("天"), F.lit("日")))
    period = lambda g: found(d, r"\(([0-9]{1,2})-([0-9]{1,2})节\)", g)
    week = F.replace(F.replace(found(d, r"\)([^/]*?周(?:\([^)]*\))?)/"), F.lit("(单)"), F.lit(" 单周")), F.lit("(双)"), F.lit(" 双周"))
    place, teacher = found(d, r"场地:([^/]+?)(?:/教师:|\z)"), found(d, r"教师:([^/]+?)(?:/课程|/学分|\z)")
    name = F.replace(F.regexp_replace(title, rf"{WS}+", ""), F.lit("▲"), F.lit(""))
    return F.when(day.isNotNull() & period(1).isNotNull(), F.concat_ws(" ", day, F.concat(period(1), F.lit("-"), period(2), F.lit("节")), name, F.concat(teacher, F.lit("老师")), place, week))


def repaired(cells: DataFrame, catalogue: DataFrame, field: str) -> DataFrame:
    """A field replaced by the catalogue's canonical value where its text is a known misreading; catalogue: misread, canonical."""
    c = catalogue.groupBy("misread").agg(F.min("canonical").alias("canonical"))
    return cells.join(c, F.col(field) == F.col("misread"), "left").withColumn(field, F.coalesce("canonical", field)).drop("misread", "canonical")
