"""Calendar arithmetic: week rules, dates, bell-schedule joins, holiday exclusion.

A course frame has one row per arrangement with ``id, day_of_week, period_start, period_end, week_start, week_end,
week_type, specific_weeks`` and, per row or as a parameter, ``semester_start``. The dimensions (periods, days without classes) are
small by nature; they are broadcast when they have at most ``DIMENSION_ROWS`` rows and joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schema

DIMENSION_ROWS = 100_000


def small(dim: DataFrame) -> DataFrame:
    """``dim`` with a broadcast hint if its size allows it."""
    return F.broadcast(dim) if dim.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else dim


def periods_frame(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(schema.PERIODS if rows is None else rows, schema.PERIOD)


def no_class_frame(spark: SparkSession, dates: list[str] | None = None) -> DataFrame:
    """Distinct calendar dates; anything that is not written YYYY-MM-DD after trimming is left out."""
    given = spark.createDataFrame([(d,) for d in (schema.NO_CLASS_DATES if dates is None else dates)], "d string")
    return normalized_dates(given, "d").select(F.to_date("d").alias("no_class_date"))


def normalized_dates(df: DataFrame, col: str) -> DataFrame:
    """Trimmed, well-formed, distinct date strings."""
    value = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    return df.select(value.alias(col)).where(F.col(col).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")).distinct()


def in_week_type(week: Column, week_type: Column) -> Column:
    return F.when(week_type == "ODD_WEEK", week % 2 == 1).when(week_type == "EVEN_WEEK", week % 2 == 0).otherwise(F.lit(True))


def expand_weeks(week_start: Column, week_end: Column, week_type: Column, specific: Column) -> Column:
    """The week numbers of a rule, ascending. Listed weeks are taken once and inside the bounds only; an empty range has none."""
    listed = F.array_sort(F.array_distinct(F.filter(F.coalesce(specific, F.array().cast("array<int>")), lambda w: (w >= week_start) & (w <= week_end))))
    span = F.when(week_end >= week_start, F.sequence(week_start, F.greatest(week_start, week_end))).otherwise(F.array().cast("array<int>"))
    return F.when(week_type == "SPECIFIC_WEEKS", listed).otherwise(F.filter(span, lambda w: in_week_type(w, week_type)))


def rule_weeks() -> Column:
    return expand_weeks(F.col("week_start"), F.col("week_end"), F.col("week_type"), F.col("specific_weeks"))


def course_date(semester_start: Column, day: Column, week: Column) -> Column:
    """The date of a weekday (Monday = 1) in a week counted from the term's first day."""
    offset = F.pmod(day - (F.weekday(semester_start) + 1), F.lit(7))
    return F.date_add(semester_start, (offset + 7 * (week - 1)).cast("int"))


def next_weekday(base: Column, day: Column, next_week: Column) -> Column:
    """The next such weekday from ``base`` on; a week later with ``next_week``."""
    return F.date_add(base, (F.pmod(day - (F.weekday(base) + 1), F.lit(7)) + F.when(next_week, 7).otherwise(0)).cast("int"))


def first_occurrence(courses: DataFrame, semester_start: Column) -> DataFrame:
    week = F.coalesce(F.try_element_at(rule_weeks(), F.lit(1)), F.col("week_start"))
    return courses.withColumn("first_date", course_date(semester_start, F.col("day_of_week"), week))


def first_definitions(periods: DataFrame, order: str | None = None) -> DataFrame:
    """One row per period number; of several the first in ``order`` counts (the least start time without one)."""
    by = F.col(order) if order else F.struct("start_time", "end_time")
    return periods.groupBy("period_number").agg(F.min_by("start_time", by).alias("start_time"), F.min_by("end_time", by).alias("end_time"))


def with_clock_times(df: DataFrame, periods: DataFrame, how: str = "inner") -> DataFrame:
    """Joined with the start of period_start and the end of period_end as ``clock_start`` and ``clock_end``."""
    p = first_definitions(periods)
    hint = F.broadcast if periods.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else (lambda x: x)
    starts = hint(p.select(F.col("period_number").alias("period_start"), F.col("start_time").alias("clock_start")))
    ends = hint(p.select(F.col("period_number").alias("period_end"), F.col("end_time").alias("clock_end")))
    return df.join(starts, "period_start", how).join(ends, "period_end", how)


def at_time(date: Column, clock: Column) -> Column:
    """date and HH:MM as a wall-clock timestamp."""
    return F.concat_ws(" ", date.cast("string"), F.concat(clock, F.lit(":00"))).cast("timestamp_ntz")


def unscheduled(courses: DataFrame, periods: DataFrame) -> DataFrame:
    """Arrangements with a period that the schedule lacks, with the reason: they have no meetings and no calendar entries."""
    missing = with_clock_times(courses, periods, "left").where("clock_start is null or clock_end is null")
    return missing.select("id", "period_start", "period_end", F.concat(F.lit("节次不存在: "), F.col("period_start").cast("string"), F.lit("-"), F.col("period_end").cast("string")).alias("rejected"))


def course_occurrences(courses: DataFrame, semester_start: Column, periods: DataFrame, no_class: DataFrame | None = None) -> DataFrame:
    """(id, week, date, starts_at, ends_at): every meeting with known periods, holidays excluded. ``unscheduled`` gives those without."""
    meetings = courses.withColumn("week", F.explode(rule_weeks()))
    meetings = meetings.withColumn("date", course_date(semester_start, F.col("day_of_week"), F.col("week")))
    if no_class is not None:
        meetings = meetings.join(small(no_class), F.col("date") == F.col("no_class_date"), "left_anti")
    timed = with_clock_times(meetings, periods)
    return timed.select("id", "week", "date", at_time(F.col("date"), F.col("clock_start")).alias("starts_at"), at_time(F.col("date"), F.col("clock_end")).alias("ends_at"))


def first_meeting(courses: DataFrame, semester_start: Column, periods: DataFrame) -> DataFrame:
    """``courses`` with ``first_start`` and ``first_end`` of the first week's meeting, null where a period is not defined, and then a ``warning``. Rows without periods get neither."""
    week = F.coalesce(F.try_element_at(rule_weeks(), F.lit(1)), F.col("week_start"), F.lit(1))
    out = with_clock_times(courses.withColumn("first_date", course_date(semester_start, F.col("day_of_week"), week)), periods, "left")
    known = F.col("clock_start").isNotNull() & F.col("clock_end").isNotNull()
    text = lambda clock: F.when(known, F.concat(F.col("first_date").cast("string"), F.lit("T"), F.col(clock), F.lit(":00")))
    warning = F.concat(F.lit("作息模板缺少第 "), F.col("period_start"), F.lit("-"), F.col("period_end"), F.lit(" 节"))
    return out.withColumns({"first_start": text("clock_start"), "first_end": text("clock_end"), "warning": F.when(~known, warning)}).drop("first_date", "clock_start", "clock_end")


def apply_template(courses: DataFrame, semester_start: Column, periods: DataFrame) -> DataFrame:
    """Start and end of the first week's meeting; where a period is not defined, a warning and no times.

    With columns ``location`` and ``classroom`` a missing place is the classroom where the periods are known.
    """
    place = [F.when(F.col("first_start").isNotNull(), F.coalesce("location", "classroom")).otherwise(F.col("location")).alias("location")] if {"location", "classroom"} <= set(courses.columns) else []
    return first_meeting(courses, semester_start, periods).select("id", F.col("first_start").alias("start_time"), F.col("first_end").alias("end_time"), "warning", *place)


def semester_start_of(text: Column) -> Column:
    """Term start named in a text: first Monday from 1 September (term 1) or from 20 February of the next year (term 2)."""
    pattern = r"(20[0-9]{2})-(20[0-9]{2})学年第?([12])学期"
    year = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    term = F.regexp_extract(text, pattern, 3)
    floor = F.when(term == "1", F.make_date(year, F.lit(9), F.lit(1))).when(term == "2", F.make_date(year + 1, F.lit(2), F.lit(20)))
    return F.next_day(F.date_sub(floor, 1), "MO")


def gather_weeks(occurrences: DataFrame) -> DataFrame:
    """The inverse of the expansion: (id, weeks) as sorted arrays."""
    return occurrences.groupBy("id").agg(F.array_sort(F.collect_list("week")).alias("weeks"))
