"""Calendar and recurrence queries on course arrangements derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.operators import calendar as C
from chronofold.operators import recurrence as R
from chronofold.sources.tables import arrangements, table

START = schema.SEMESTER_START
def _d():
    return F.lit(START).cast("date")

# ---- shared parts of the SQL
COURSES = """courses as (
  select o_orderkey as id, cast(o_orderkey % 7 + 1 as int) as day_of_week, cast(o_orderkey % 11 + 1 as int) as period_start,
         cast(least(12, o_orderkey % 11 + 1 + o_custkey % 3) as int) as period_end, cast(o_custkey % 5 + 1 as int) as week_start,
         cast(o_custkey % 5 + 1 + o_orderkey % 16 as int) as week_end,
         case o_orderpriority when '1-URGENT' then 'SPECIFIC_WEEKS' when '2-HIGH' then 'ODD_WEEK' when '3-MEDIUM' then 'EVEN_WEEK' else 'EVERY_WEEK' end as week_type,
         [cast(o_custkey % 5 + 1 as int), cast(o_custkey % 5 + 4 as int), cast(o_custkey % 5 + 41 as int)] as specific_weeks
  from orders)"""
WEEKS = """weeks as (
  select *, case when week_type = 'SPECIFIC_WEEKS' then list_sort(list_distinct(list_filter(specific_weeks, lambda w: w >= week_start and w <= week_end)))
    else list_filter(list_transform(range(week_start, week_end + 1), lambda w: cast(w as int)), lambda w: case week_type when 'ODD_WEEK' then w % 2 = 1 when 'EVEN_WEEK' then w % 2 = 0 else true end) end as ws
  from courses)"""
PERIODS = "periods(period_number, start_time, end_time, label) as (values " + ", ".join(str(p) for p in schema.PERIODS) + ")"
PERIODS10 = "periods(period_number, start_time, end_time, label) as (values " + ", ".join(str(p) for p in schema.PERIODS[:10]) + ")"
OFF = "off(d) as (select cast(column0 as date) from (values " + ", ".join(f"('{d}')" for d in schema.NO_CLASS_DATES) + ") t(column0))"
DATE = f"cast(date '{START}' + cast(((day_of_week - isodow(date '{START}')) % 7 + 7) % 7 + 7 * (w - 1) as int) as date)"
MEETINGS = f"""m as (select id, week_type, day_of_week, period_start, period_end, w as week, {DATE} as date from (select *, unnest(ws) as w from weeks))"""
TIMED = """timed as (select m.*, cast(m.date || ' ' || s.start_time || ':00' as timestamp) as starts_at, cast(m.date || ' ' || e.end_time || ':00' as timestamp) as ends_at, off.d is not null as is_off
  from m join periods s on s.period_number = period_start join periods e on e.period_number = period_end left join off on off.d = m.date)"""
ENTRIES = """g as (select id, week_type, min(starts_at) filter (not is_off) as first, arg_min(ends_at, starts_at) filter (not is_off) as first_end, max(ends_at) filter (not is_off) as last,
    string_agg(strftime(starts_at, '%Y%m%dT%H%M%S'), ',' order by starts_at) filter (is_off) as ex from timed group by all),
entries as (
  select id, '1' as suffix, first as starts_at, first_end as ends_at, 'FREQ=WEEKLY;INTERVAL=' || case week_type when 'EVERY_WEEK' then '1' else '2' end || ';UNTIL=' || strftime(last, '%Y%m%dT%H%M%S') as rrule, ex as exdates
  from g where week_type <> 'SPECIFIC_WEEKS' and first is not null
  union all
  select id, cast(row_number() over (partition by id order by starts_at) as varchar), starts_at, ends_at, null, null from timed where week_type = 'SPECIFIC_WEEKS' and not is_off)"""


def week_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrangements(spark, sf_dir).select("id", F.explode(C.rule_weeks()).alias("week"))


def course_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrangements(spark, sf_dir).select("id", "day_of_week", F.explode(C.rule_weeks()).alias("week")).select("id", "week", C.course_date(_d(), F.col("day_of_week"), F.col("week")).alias("date"))


def course_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.course_occurrences(arrangements(spark, sf_dir), _d(), C.periods_frame(spark), C.no_class_frame(spark))


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_occurrence(arrangements(spark, sf_dir), _d()).select("id", "first_date")


def template_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_template(arrangements(spark, sf_dir), _d(), C.periods_frame(spark, schema.PERIODS[:10]))


def semester_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("o_custkey") % 30 + 2010
    text = F.concat(F.lit("课表 "), year.cast("string"), F.lit("-"), (year + 1).cast("string"), F.lit("学年第"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("学期"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.semester_start_of(text).alias("semester_start"))


def semester_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("o_orderkey") % 4 == 0, "2026/9/7").when(F.col("o_orderkey") % 4 == 1, F.col("o_orderdate").cast("date").cast("string")).when(F.col("o_orderkey") % 4 == 2, "")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(given.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), given).otherwise(START).alias("semester_start"))


def no_class_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("  "), day, F.lit(" "))).when(F.col("o_orderkey") % 5 == 1, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)
    return C.normalized_dates(table(spark, sf_dir, "orders").select(raw.alias("d")), "d")


def next_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.next_weekday(F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 2 == 1).alias("day"))


def rrule_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recurrences(arrangements(spark, sf_dir), _d(), C.periods_frame(spark), C.no_class_frame(spark))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.concat(F.lit("课程,"), F.col("o_custkey").cast("string"), F.lit(";\\")).alias("title"))
    e = rrule_compress(spark, sf_dir).join(o, "id")
    uid = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("suffix"), F.lit(f"@{R.UID_DOMAIN}"))
    place = F.when(F.col("id") % 3 == 0, F.concat(F.lit("教学楼 A"), (F.col("id") % 500).cast("string")))
    text = R.description(F.lit(None).cast("string"), F.lit("甲老师"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("AI"), (F.col("id") % 101) / 100)
    lines = R.entry_lines(uid, R.compact_time(F.col("starts_at")), R.compact_time(F.col("ends_at")), F.col("title"), place, text, F.col("rrule"), F.col("exdates"), (F.col("id") % 3 * 5).cast("int"), F.lit("20260101T000000"))
    return e.select("o_custkey", "id", "suffix", lines.alias("lines"))


def ics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("id", "suffix", F.array_join("lines", "\r\n").alias("vevent"))


def ics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.calendars(_entries(spark, sf_dir), "o_custkey", ["id", "suffix"], "lines")


def ics_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.escape_text(F.col("text")).alias("escaped"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported start and end of events: an end that is missing lies an hour after the start."""
    e = table(spark, sf_dir, "events").withColumn("start_time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    end = F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts") + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm"))
    end = F.coalesce(end, R.add_minutes(F.col("start_time"), F.lit(60)))
    return e.select("event_id", R.compact_text(F.col("start_time")).alias("dtstart"), R.compact_text(end).alias("dtend"))


def week_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gather_weeks(week_expand(spark, sf_dir))


_VEVENT = r"""lines as (
  select o_custkey, e.id, e.suffix, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || e.id || '-' || e.suffix || '@chronofold.invalid', 'DTSTAMP:20260101T000000',
    'DTSTART:' || strftime(starts_at, '%Y%m%dT%H%M%S'), 'DTEND:' || strftime(ends_at, '%Y%m%dT%H%M%S'), 'SUMMARY:课程\,' || o_custkey || '\;\\',
    case when e.id % 3 = 0 then 'LOCATION:教学楼 A' || (e.id % 500) end,
    'DESCRIPTION:教师: 甲老师\n来源: AI\n置信度: ' || cast(floor(e.id % 101 / 100.0::double * 100 + 0.5) as bigint) || '%',
    'RRULE:' || rrule, 'EXDATE:' || exdates,
    case when e.id % 3 > 0 then concat_ws(chr(13) || chr(10), 'BEGIN:VALARM', 'TRIGGER:-PT' || (e.id % 3 * 5) || 'M', 'ACTION:DISPLAY', 'DESCRIPTION:课程\,' || o_custkey || '\;\\ 即将开始', 'END:VALARM') end,
    'END:VEVENT') as vevent
  from entries e join orders on o_orderkey = e.id)"""
_BASE = f"with {COURSES}, {WEEKS}, {PERIODS}, {OFF}, {MEETINGS}, {TIMED}, {ENTRIES}"

QUERIES = {f.__name__: f for f in (week_expand, course_dates, course_occurrences, first_occurrence, template_apply, semester_infer, semester_default, no_class_normalize, next_weekday, rrule_compress, ics_lines, ics_document, ics_escape, event_times, week_round_trip)}
ORACLES = {
    "week_expand": f"with {COURSES}, {WEEKS} select id, unnest(ws) as week from weeks",
    "week_round_trip": f"with {COURSES}, {WEEKS} select id, ws as weeks from weeks where len(ws) > 0",
    "course_dates": f"with {COURSES}, {WEEKS}, {MEETINGS} select id, week, date from m",
    "course_occurrences": f"with {COURSES}, {WEEKS}, {PERIODS}, {OFF}, {MEETINGS}, {TIMED} select id, week, date, starts_at, ends_at from timed where not is_off",
    "first_occurrence": f"with {COURSES}, {WEEKS} select id, {DATE} as first_date from (select *, coalesce(ws[1], week_start) as w from weeks)",
    "template_apply": f"""with {COURSES}, {WEEKS}, {PERIODS10}, f as (select *, {DATE} as d from (select *, coalesce(ws[1], week_start, 1) as w from weeks))
      select id, case when s.start_time is not null and e.end_time is not null then d || 'T' || s.start_time || ':00' end as start_time, case when s.start_time is not null and e.end_time is not null then d || 'T' || e.end_time || ':00' end as end_time,
        case when s.start_time is null or e.end_time is null then '作息模板缺少第 ' || period_start || '-' || period_end || ' 节' end as warning
      from f left join periods s on s.period_number = period_start left join periods e on e.period_number = period_end""",
    "semester_infer": """with t as (select o_orderkey, o_custkey % 30 + 2010 as y, o_orderkey % 3 + 1 as term from orders),
      f as (select o_orderkey, case term when 1 then make_date(y, 9, 1) when 2 then make_date(y + 1, 2, 20) end as d from t)
      select o_orderkey, cast(d + cast((8 - isodow(d)) % 7 as int) as date) as semester_start from f""",
    "semester_default": f"""select o_orderkey, case when o_orderkey % 4 = 1 then cast(cast(o_orderdate as date) as varchar) else '{START}' end as semester_start from orders""",
    "no_class_normalize": "select distinct cast(cast(o_orderdate as date) as varchar) as d from orders where o_orderkey % 5 <> 1",
    "next_weekday": "select o_orderkey, cast(cast(o_orderdate as date) + cast(((o_orderkey % 7 + 1 - isodow(o_orderdate)) % 7 + 7) % 7 + case when o_custkey % 2 = 1 then 7 else 0 end as int) as date) as day from orders",
    "rrule_compress": f"{_BASE} select * from entries",
    "ics_lines": f"{_BASE}, {_VEVENT} select id, suffix, vevent from lines",
    "ics_document": f"""{_BASE}, {_VEVENT} select o_custkey, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'PRODID:-//chronofold//schedule//EN', 'X-WR-CALNAME:' || o_custkey, 'X-WR-TIMEZONE:Asia/Shanghai',
      string_agg(vevent, chr(13) || chr(10) order by id, suffix), 'END:VCALENDAR') as ics from lines group by o_custkey""",
    "ics_escape": r"select doc_id, coalesce(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), ',', '\,'), ';', '\;'), '') as escaped from documents",
    "event_times": "select event_id, strftime(ts, '%Y%m%dT%H%M%S') as dtstart, case when event_id % 2 = 0 then strftime(date_trunc('minute', ts + interval 90 minute), '%Y%m%dT%H%M%S') else strftime(date_trunc('minute', ts + interval 60 minute), '%Y%m%dT%H%M%S') end as dtend from events",
}
