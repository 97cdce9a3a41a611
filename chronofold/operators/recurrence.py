"""Recurrence compression and calendar text (RFC 5545 lines with floating local times)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import at_time, course_date, rule_weeks, small, with_clock_times

UID_DOMAIN = "chronofold.invalid"
PRODUCT = "-//chronofold//schedule//EN"
TIMEZONE = "Asia/Shanghai"


def escape_text(c: Column) -> Column:
    """Backslash, line end, comma and semicolon, in this order; null as empty."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), (",", "\\,"), (";", "\\;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def compact_text(c: Column) -> Column:
    """A date or datetime string without separators and with seconds; null for other forms."""
    plain = F.regexp_replace(c, "[-:]", "")
    return (F.when(plain.rlike(r"^[0-9]{8}T[0-9]{4}\z"), F.concat(plain, F.lit("00")))
            .when(plain.rlike(r"^[0-9]{8}T[0-9]{6}\z"), plain)
            .when(plain.rlike(r"^[0-9]{8}\z"), F.concat(plain, F.lit("T000000"))))


def add_minutes(c: Column, minutes: Column) -> Column:
    """A YYYY-MM-DDTHH:MM[:SS] string moved by minutes, seconds set to 00."""
    ts = F.try_to_timestamp(F.concat(F.substring(c, 1, 16), F.lit(":00")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes), "yyyy-MM-dd'T'HH:mm:ss")


def meetings(courses: DataFrame, semester_start: Column, periods: DataFrame, no_class: DataFrame) -> DataFrame:
    """All meetings with times and a flag ``off`` for days without classes."""
    m = courses.select("id", "day_of_week", "period_start", "period_end", "week_type", F.explode(rule_weeks()).alias("week"))
    m = m.withColumn("date", course_date(semester_start, F.col("day_of_week"), F.col("week")))
    m = with_clock_times(m, periods)
    m = m.join(small(no_class.distinct()), F.col("date") == F.col("no_class_date"), "left")
    return m.select("id", "week", "week_type", at_time(F.col("date"), F.col("clock_start")).alias("starts_at"), at_time(F.col("date"), F.col("clock_end")).alias("ends_at"), F.col("no_class_date").isNotNull().alias("off"))


def recurrences(courses: DataFrame, semester_start: Column, periods: DataFrame, no_class: DataFrame) -> DataFrame:
    """(id, suffix, starts_at, ends_at, rrule, exdates), one row per calendar entry.

    A regular course is one entry: it begins at its first active meeting, ends by UNTIL at the end of its last, and lists all
    its holidays, those before the beginning too. Listed weeks give an entry each, numbered after the holidays are taken out.
    A course without active meetings has none. One aggregation per course; no window over all rows.
    """
    m = meetings(courses, semester_start, periods, no_class)
    active = F.struct("starts_at", "ends_at")
    g = m.groupBy("id", "week_type").agg(
        F.min(F.when(~F.col("off"), active)).alias("first"), F.max(F.when(~F.col("off"), F.col("ends_at"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("off"), F.col("starts_at")))).alias("ex"), F.array_sort(F.collect_list(F.when(~F.col("off"), active))).alias("each"))
    interval = F.when(F.col("week_type") == "EVERY_WEEK", "1").otherwise("2")
    rule = F.concat(F.lit("FREQ=WEEKLY;INTERVAL="), interval, F.lit(";UNTIL="), compact_time(F.col("last")))
    listed = F.col("week_type") == "SPECIFIC_WEEKS"
    one = F.array(F.col("first"))
    g = g.where("first is not null").select("id", F.posexplode(F.when(listed, F.col("each")).otherwise(one)).alias("n", "o"), F.when(~listed, rule).alias("rrule"), F.when(~listed, F.array_join(F.transform("ex", compact_time), ",")).alias("exdates"))
    return g.select("id", (F.col("n") + 1).cast("string").alias("suffix"), "o.starts_at", "o.ends_at", "rrule", F.nullif("exdates", F.lit("")).alias("exdates"))


def description(details: Column, teacher: Column, week_type: Column, seat: Column, source: Column, confidence: Column) -> Column:
    """The lines of an entry's description; empty ones are left out."""
    labelled = lambda label, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(label), c))
    percent = F.concat(F.lit("置信度: "), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws("\n", F.nullif(details, F.lit("")), labelled("教师: ", teacher), labelled("周次规则: ", week_type), labelled("座位号: ", seat), F.concat(F.lit("来源: "), source), percent)


def entry_lines(uid: Column, start: Column, end: Column, title: Column, location: Column, text: Column, rrule: Column, exdates: Column, reminder: Column, stamp: Column) -> Column:
    """The lines of one entry. The stamp is a parameter, so that the same input gives the same text."""
    tag = lambda name, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(name), c))
    alarm = F.coalesce(reminder, F.lit(10))
    rings = alarm > 0
    return F.filter(F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), stamp), F.concat(F.lit("DTSTART:"), start), F.concat(F.lit("DTEND:"), end),
        F.concat(F.lit("SUMMARY:"), escape_text(title)), F.when(F.nullif(location, F.lit("")).isNotNull(), F.concat(F.lit("LOCATION:"), escape_text(location))),
        F.when(F.nullif(text, F.lit("")).isNotNull(), F.concat(F.lit("DESCRIPTION:"), escape_text(text))), tag("RRULE:", rrule), tag("EXDATE:", exdates),
        F.when(rings, "BEGIN:VALARM"), F.when(rings, F.concat(F.lit("TRIGGER:-PT"), alarm.cast("string"), F.lit("M"))), F.when(rings, "ACTION:DISPLAY"),
        F.when(rings, F.concat(F.lit("DESCRIPTION:"), escape_text(F.concat(title, F.lit(" 即将开始"))))), F.when(rings, "END:VALARM"), F.lit("END:VEVENT")), lambda x: x.isNotNull())


def event_entries(events: DataFrame) -> DataFrame:
    """Calendar entries of events that are no courses: suffix 0, an end an hour after the start where it is missing, their own rule; those without a start are left out.

    ``events`` with dtstart and dtend beside its columns start_time, end_time, rrule (null where there is none).
    """
    start, end = F.nullif("start_time", F.lit("")), F.nullif("end_time", F.lit(""))
    timed = events.where(start.isNotNull())
    return timed.withColumn("suffix", F.lit("0")).withColumn("dtstart", compact_text(F.col("start_time"))).withColumn("dtend", compact_text(F.coalesce(end, add_minutes(F.col("start_time"), F.lit(60)))))


def calendars(entries: DataFrame, calendar: str, order: list[str], lines: str, name: Column | None = None) -> DataFrame:
    """(calendar, ics): the entries' lines in order between the calendar's head and end, joined by CR LF.

    One group per calendar: a calendar is one document, so its entries meet by nature.
    """
    g = entries.groupBy(calendar).agg(F.array_sort(F.collect_list(F.struct(*order, lines))).alias("e"))
    title = escape_text(F.col(calendar).cast("string") if name is None else name)
    head = F.array(*[F.lit(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"PRODID:{PRODUCT}")], F.concat(F.lit("X-WR-CALNAME:"), title), F.lit(f"X-WR-TIMEZONE:{TIMEZONE}"))
    body = F.flatten(F.transform("e", lambda x: x[lines]))
    return g.select(calendar, F.array_join(F.concat(head, body, F.array(F.lit("END:VCALENDAR"))), "\r\n").alias("ics"))
