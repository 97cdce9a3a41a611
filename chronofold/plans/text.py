"""Queries on text: lines, routing, field extraction, validation, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import extract as X
from chronofold.functions import labels as L
from chronofold.functions import text as N
from chronofold.operators import events as E
from chronofold.operators import templates as T
from chronofold.plans.calendar import COURSES
from chronofold.sources.tables import arrangements, course_texts, notices, table

_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _norm(t: str) -> str:
    out = f"translate({t}, '：—–－～' || chr(160), ':---~ ')"
    for p, r in ((rf"\b([0-9]){_WS}+([0-9]){_WS}*:", r"\1\2:"), (rf"([0-9]{{1,2}}){_WS}*:{_WS}*([0-9]{{2}})", r"\1:\2"), (rf"([0-9]{{1,2}}:[0-9]{{2}}){_WS}*[一-]{_WS}*([0-9]{{1,2}}:[0-9]{{2}})", r"\1-\2"), (rf"\b([0-9]){_WS}+([0-9])({_WS}*(?:分散|集中|闭卷|开卷|\z))", r"\1\2\3"), (rf"\A{_WS}+|{_WS}+\z", "")):
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return out


def _trim(t: str) -> str:
    return rf"regexp_replace({t}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.numbered(table(spark, sf_dir, "documents"), N.lines(F.col("text")), ["doc_id"])


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.numbered(table(spark, sf_dir, "conversations"), N.sentences(F.col("text")), ["conv_id", "turn"])


def dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(spark, sf_dir).groupBy("doc_id", "line").agg(F.min("line_no").alias("line_no"))


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("event_id", X.route(F.col("text")).alias("intent"))


def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.once(E.once(notices(spark, sf_dir), n=N.normalize(F.col("text"))), t=X.time_of(F.col("n")))
    return n.select("event_id", X.date_of(F.col("n"), F.col("as_of")).alias("date"), F.col("t.start").alias("time_start"), F.col("t.end").alias("time_end"), X.event_type(F.col("text")).alias("type"), X.location(F.col("n")).alias("location"))


def course_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.course_lines(course_texts(spark, sf_dir).select("id", "text"), "text", "id")
    return rows.select("id", "name", "teacher", "location", "day_of_week", "period_start", "period_end", "week_start", "week_end", "week_type", "confidence")


def week_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_texts(spark, sf_dir).select("id", X.week_rule(F.col("text")).alias("r")).select("id", "r.*")


def period_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_texts(spark, sf_dir).select("id", X.period_range(N.normalize(F.col("text"))).alias("p")).select("id", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


def weekday_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = course_texts(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    line = F.when(F.col("id") % 4 == 0, F.col("text")).otherwise(F.expr("substring(text, 3)"))
    docs = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return E.course_lines(docs, "text", "o_custkey").select("o_custkey", "line_no", "day_of_week")


def exam_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    row = F.concat(F.lit("2026年06月23日 13:00-15:00 教学楼A101 分散"))
    text = F.when(k == 0, F.concat(F.lit("1 "), row)).when(k == 1, F.concat(row, F.lit("\n"), row)).when(k == 2, row).otherwise("通知 2026年06月23日 无")
    return table(spark, sf_dir, "events").select("event_id", X.looks_like_exam_table(text).alias("exam_table"), X.route(text).alias("intent"))


def schedule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("节次 上课时间\n第"), (k % 12 + 1).cast("string"), F.lit("节 08:20-09:05；"), (F.floor(k / 12) % 12 + 1).cast("string"), F.lit(" 9:15 10:00\n午休\n14点半到15点5分 第"), (k % 5 + 3).cast("string"), F.lit("节"))
    return T.parse_schedule(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "c_custkey")[0]


def schedule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("节次 上课时间\n第一节 08:20-09:05\n"), F.col("c_name"), F.lit("\n第二节 09:10"))
    return T.parse_schedule(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "c_custkey")[1]


def sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.is_sparse(F.col("text")).alias("sparse"))


def prefer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    line = F.concat(F.lit("周一 1-2节 "), F.when(F.col("o_orderkey") % 5 == 0, "选修").otherwise("1-16周 教师:甲"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return docs.select(k, X.prefers_rules(F.col("text")).alias("rules_first"))


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("l_linenumber", "l_quantity"), F.struct("l_quantity", -F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.l_quantity")


def _raw_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = arrangements(spark, sf_dir), F.col("id") % 11
    return a.select("id", F.when(m == 0, "  ").otherwise(F.concat(F.lit("课"), F.col("id").cast("string"), F.lit(" "))).alias("name"), F.when(m == 1, 9).when(m == 2, None).otherwise(F.col("day_of_week")).alias("day_of_week"), F.when(m == 3, 0).otherwise(F.col("period_start")).alias("period_start"),
                    F.when(m == 4, None).otherwise(F.col("period_end")).alias("period_end"), F.when(m == 5, None).otherwise(F.col("week_start")).alias("week_start"), F.when(m.isin(5, 6), None).otherwise(F.col("week_end")).alias("week_end"), F.when(m == 7, "WEEKLY").otherwise(F.col("week_type")).alias("week_type"),
                    F.when(m == 8, None).otherwise((F.col("id") % 150) / 100.0 - 0.2).alias("confidence"))


def validate_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.validate_courses(_raw_courses(spark, sf_dir))


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 7
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(m == 0, " ").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("title"), F.when(m == 1, "PARTY").when(m == 2, "HOMEWORK").otherwise("EXAM").alias("type"), F.when(m == 3, None).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(m == 4, "9:5").otherwise(F.date_format("ts", "HH:mm")).alias("time_start"), F.when(m == 5, None).otherwise("24:59").alias("time_end"), F.when(m == 6, " ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("seat_number"),
        (F.col("value") / 100).alias("confidence"), F.when(m == 2, F.array(F.lit("date"), F.lit("place"))).otherwise(F.array().cast("array<string>")).alias("uncertain_fields"))
    return E.validate_events(raw)


def review_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("value")).cast("int").alias("v"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("start_time"))
    return E.dashboard(e.withColumn("confidence", F.least(F.lit(64), F.pmod("v", F.lit(65))) / 64.0))


def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 64 / 64.0).alias("c"), (F.col("event_id") % 3 == 0).alias("course"))
    return e.groupBy("user_id").agg(F.coalesce(F.avg(F.when(F.col("course"), F.col("c"))), F.lit(0.0)).alias("confidence"), F.bool_or("course").alias("any_course"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrangements(spark, sf_dir).withColumn("c", (F.col("id") % 101) / 100)
    day = F.col("day_of_week") + F.when(F.col("id") % 10 == 0, 7).otherwise(0)
    start = F.concat(F.lit("2026-06-23T"), F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    end = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "2026-06-23T23:30:00").otherwise("2026-06-24T01:00:00")
    kind = F.try_element_at(F.array(*[F.lit(x) for x in [*schema.EVENT_TYPES, "OTHER"]]), (F.col("id") % 7 + 1).cast("int"))
    return a.select("id", L.weekday_name(day).alias("weekday"), L.week_rule(F.col("week_start"), F.col("week_end"), F.col("week_type")).alias("rule"), L.week_type_label(F.col("week_type")).alias("week_label"), L.slot(F.col("period_start"), F.col("period_end")).alias("slot"), L.confidence_band(F.col("c")).alias("band"),
                    L.event_time(F.when(F.col("id") % 13 > 0, start), end).alias("when_text"), L.looked_up(kind, L.EVENT_TYPE_LABELS).alias("type_label"))


def event_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir)
    return E.recognize(n, F.lit("2026-06-15").cast("date"), "text", "event_id")


def ocr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("event_id", X.ocr_score(F.col("text")).alias("score"))


def first_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.remove_first(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 2, 2)).when(F.col("p_partkey") % 3 == 1, "e")).alias("rest"))


_LINE_SQL = "(select doc_id, list_filter(list_transform(regexp_split_to_array({n}, '[\n\r；;]'), lambda x: {t}), lambda x: x <> '') as l from documents)"
_LINES = "lines as (select doc_id, cast(unnest(generate_series(1, len(l))) as int) as line_no, unnest(l) as line from " + _LINE_SQL.format(n=_norm("text"), t=_trim("x")) + ")"
_NOTICE = """n as (select event_id, cast(ts as date) as as_of, event_id % 6 as v, event_id % 300 + 100 as k, cast(user_id % 7 + 1 as int) as wd, hour(ts) as h, minute(ts) as mi, month(ts) as mo, day(ts) as da, ts from events)"""
_FORWARD = "cast(((wd - isodow(as_of)) % 7 + 7) % 7 as int)"
_DOC_COURSES = f"with {COURSES}"
_SPARSE = r"text"
for _p in (r"(?i)https?://\S+", r"\b20\d{2}[/-]\d{1,2}[/-]\d{1,2}\b", r"\b\d{1,2}:\d{2}\b", rf"选课结果|课程表|第{_WS}*\d+{_WS}*页|\d+{_WS}*/{_WS}*\d+"):
    _SPARSE = f"regexp_replace({_SPARSE}, '{_p}', ' ', 'g')"

QUERIES = {f.__name__: f for f in (split_lines, split_sentences, dedupe_lines, route_intent, notice_fields, course_parse, week_rule, period_range, weekday_fill, exam_shape, schedule_text, schedule_warnings, sparse_text, prefer_rules, best_variant,
                                   validate_courses, validate_events, review_dashboard, overall_confidence, display_labels, event_recognition, ocr_scores, first_literal)}
ORACLES = {
    "split_lines": f"with {_LINES} select * from lines",
    "split_sentences": f"select conv_id, turn, cast(unnest(generate_series(1, len(l))) as int) as line_no, unnest(l) as line from (select conv_id, turn, list_filter(list_transform(regexp_split_to_array({_norm('text')}, '[\n\r。；;]'), lambda x: {_trim('x')}), lambda x: x <> '') as l from conversations)",
    "dedupe_lines": f"with {_LINES} select doc_id, line, min(line_no) as line_no from lines group by all",
    "route_intent": "select event_id, case event_id % 6 when 0 then 'EXAM' when 1 then 'HOMEWORK' when 2 then 'NOTICE' when 3 then 'NOTICE' when 4 then 'NATURAL_LANGUAGE' else case when user_id % 7 < 5 then 'COURSE' else 'COURSE' end end as intent from events",
    "notice_fields": f"""with {_NOTICE} select event_id,
      case v when 0 then '2026-' || lpad(mo::varchar, 2, '0') || '-' || lpad(da::varchar, 2, '0') when 1 then strftime(as_of, '%Y-%m-%d') when 2 then cast(cast(as_of + {_FORWARD} + 7 as date) as varchar) when 3 then cast(cast(as_of + 1 as date) as varchar) when 4 then cast(as_of as varchar) else cast(cast(as_of + {_FORWARD} as date) as varchar) end as date,
      case v when 0 then strftime(ts, '%H:%M') when 1 then '23:59' when 2 then '19:00' when 3 then '15:00' when 4 then strftime(ts, '%H:%M') else '08:00' end as time_start,
      case v when 0 then lpad((h + 1)::varchar, 2, '0') || strftime(ts, ':%M') when 1 then '24:59' when 2 then '20:00' when 3 then '16:00' when 4 then lpad((h + 1)::varchar, 2, '0') || strftime(ts, ':%M') else '10:00' end as time_end,
      case v when 0 then 'EXAM' when 1 then 'HOMEWORK' when 2 then 'MEETING' when 3 then 'ACTIVITY' when 4 then 'REMINDER' else 'ACTIVITY' end as type,
      case v when 0 then '教学楼 A' || k when 2 then '线上会议' when 3 then '图书馆报告厅' when 5 then 'B' || k end as location from n""",
    "course_parse": f"""{_DOC_COURSES} select id, '操作系统' || (id % 97) as name, case id % 4 when 0 then '甲' when 1 then '乙' when 2 then '丙' else '丁' end || '老师' as teacher, '教学楼B' || (id % 900 + 100) as location, day_of_week, period_start, period_end,
      week_start, case week_type when 'SPECIFIC_WEEKS' then week_start else week_end end as week_end, week_type, 0.55::double + 0.12::double + 0.12::double + 0.08::double as confidence from courses""",
    "week_rule": f"{_DOC_COURSES} select id, week_start, case week_type when 'SPECIFIC_WEEKS' then week_start else week_end end as week_end, week_type, case week_type when 'SPECIFIC_WEEKS' then [week_start] end as specific_weeks from courses",
    "period_range": f"{_DOC_COURSES} select id, period_start, period_end from courses",
    "weekday_fill": f"""{_DOC_COURSES}, l as (select o_custkey, cast(row_number() over w as int) as line_no, last_value(case when id % 4 = 0 then day_of_week end ignore nulls) over (partition by o_custkey order by id rows unbounded preceding) as day_of_week
      from courses join orders on o_orderkey = id window w as (partition by o_custkey order by id)) select * from l where day_of_week is not null""",
    "exam_shape": "select event_id, event_id % 4 < 2 as exam_table, case event_id % 4 when 0 then 'EXAM' when 1 then 'EXAM' when 2 then 'NATURAL_LANGUAGE' else 'NOTICE' end as intent from events",
    "schedule_text": """with l as (select c_custkey, 2 as n, cast(c_custkey % 12 + 1 as int) as p, '08:20' as s, '09:05' as e from customer union all select c_custkey, 3, cast(c_custkey // 12 % 12 + 1 as int), '09:15', '10:00' from customer union all select c_custkey, 5, cast(c_custkey % 5 + 3 as int), '14:30', '15:05' from customer)
      select c_custkey, p as period_number, arg_min(s, n) as start_time, arg_min(e, n) as end_time, '第' || (['一','二','三','四','五','六','七','八','九','十','十一','十二'])[p] || '节' as label from l group by c_custkey, p""",
    "schedule_warnings": "select c_custkey, 3 as line_no, '第 3 行未识别为作息节次：' || c_name as warning from customer union all select c_custkey, 4, '第 4 行未识别为作息节次：第二节 09:10' from customer",
    "sparse_text": rf"select doc_id, length(regexp_replace({_SPARSE}, '[^\x{{4e00}}-\x{{9fa5}}A-Za-z0-9]', '', 'g')) < 30 and len(regexp_extract_all(text, '星期[一二三四五六日天]|周[一二三四五六日天]|\d{{1,2}}\s*[-~至到]\s*\d{{1,2}}\s*节|教师|场地')) < 2 as sparse from documents",
    "prefer_rules": "select o_custkey, count(*) >= 3 and 5 * count(*) filter (o_orderkey % 5 <> 0) >= 4 * count(*) as rules_first from orders group by o_custkey",
    "best_variant": "select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as r from lineitem) where r = 1",
    "validate_courses": f"""{_DOC_COURSES}, raw as (select id, id % 11 as m, case when id % 11 = 0 then '' else '课' || id end as name, case id % 11 when 1 then 9 when 2 then null else day_of_week end as day_of_week, case id % 11 when 3 then 0 else period_start end as period_start, case id % 11 when 4 then null else period_end end as period_end,
        case id % 11 when 5 then null else week_start end as week_start, case when id % 11 in (5, 6) then null else week_end end as week_end, week_type, case id % 11 when 8 then null else (id % 150)::double / 100 - 0.2::double end as confidence from courses)
      select id, name, day_of_week, period_start, coalesce(period_end, period_start) as period_end, coalesce(week_start, 1) as week_start, coalesce(week_end, week_start, 1) as week_end, case m when 7 then 'EVERY_WEEK' else week_type end as week_type, case when confidence is null then 0.5::double else greatest(0, least(1, confidence)) end as confidence,
        case when m = 0 then '缺少课程名称' when m in (1, 2) then name || ' : 缺少星期信息' when m = 3 then name || ' : 缺少节次信息' end as rejected, 10 as reminder_minutes from raw""",
    "validate_events": """with r as (select *, event_id % 7 as m, case when event_id % 7 = 3 then null else strftime(ts, '%Y-%m-%d') end as d from events)
      select event_id, case m when 0 then '' else event_type end as title, case m when 1 then 'REMINDER' when 2 then 'HOMEWORK' else 'EXAM' end as type, case m when 6 then null else user_id::varchar end as seat_number, greatest(0, least(1, value / 100)) as confidence,
        case when m = 0 then '缺少事件标题' when d is null then event_type || ': 缺少日期' end as rejected, d || 'T' || case m when 4 then '09:00' else strftime(ts, '%H:%M') end || ':00' as start_time, d || 'T' || case m when 5 then '09:00' else '24:59' end || ':00' as end_time,
        case m when 2 then 120 else 30 end as reminder_minutes, case m when 2 then ['字段不确定: date', '字段不确定: place'] end as warnings from r""",
    "review_dashboard": "with e as (select least(64, (floor(value)::int % 65 + 65) % 65) / 64.0::double as c, event_type, case when event_id % 9 > 0 then ts end as s from events) select coalesce(avg(c), 0) as mean_confidence, count(*) filter (c < 0.85 or s is null) as to_check, count(distinct event_type) as types from e",
    "overall_confidence": "select user_id, coalesce(avg(event_id % 64 / 64.0::double) filter (event_id % 3 = 0), 0) as confidence, bool_or(event_id % 3 = 0) as any_course from events group by user_id",
    "display_labels": f"""{_DOC_COURSES} select id, case when id % 10 = 0 then '未知星期' else (['周一','周二','周三','周四','周五','周六','周日'])[day_of_week] end as weekday, '第 ' || week_start || '-' || week_end || ' 周 ' || case week_type when 'EVERY_WEEK' then '每周' when 'ODD_WEEK' then '单周' when 'EVEN_WEEK' then '双周' else '指定周' end as rule,
      case week_type when 'EVERY_WEEK' then '全周' when 'ODD_WEEK' then '单周' when 'EVEN_WEEK' then '双周' else '指定周' end as week_label, '第 ' || period_start || '-' || period_end || ' 节' as slot, case when id % 101 >= 85 then '高置信' when id % 101 >= 70 then '需核对' else '低置信' end as band,
      case when id % 13 = 0 then '时间待确认' else '2026-06-23 ' || lpad((id % 24)::varchar, 2, '0') || ':00' || case id % 3 when 0 then '' when 1 then '-23:30' else '-2026-06-24 01:00' end end as when_text, (['课程','考试','作业','会议','活动','提醒','OTHER'])[id % 7 + 1] as type_label from courses""",
    "event_recognition": """with e as (select event_id, event_id % 6 as m, event_id % 300 + 100 as k, cast(user_id % 7 as int) as wd, hour(ts) as h, strftime(ts, '%M') as mi, '2026-' || strftime(ts, '%m-%d') as md from events),
      d as (select *, case m when 0 then md when 1 then md when 2 then cast(cast(date '2026-06-15' + (wd + 7) as date) as varchar) when 3 then '2026-06-16' when 4 then '2026-06-15' else cast(cast(date '2026-06-15' + wd as date) as varchar) end as day,
        case m when 1 then '23:59' when 2 then '19:00' when 3 then '15:00' when 5 then '08:00' else lpad(h::varchar, 2, '0') || ':' || mi end as s, case m when 1 then '24:59' when 2 then '20:00' when 3 then '16:00' when 5 then '10:00' else lpad((h + 1)::varchar, 2, '0') || ':' || mi end as t from e)
      select event_id, case m when 0 then 2 else 1 end::int as line_no, (['操作系统考试', '提交实验报告', '班会', '下午3点讲座，', '记得带伞', '8点到10点 活动 教室'])[m + 1] as title, (['EXAM', 'HOMEWORK', 'MEETING', 'ACTIVITY', 'REMINDER', 'ACTIVITY'])[m + 1] as type, day || 'T' || s || ':00' as start_time, day || 'T' || t || ':00' as end_time,
        case m when 0 then '教学楼 A' || k when 2 then '线上会议' when 3 then '图书馆报告厅' when 5 then 'B' || k end as location, null::varchar as seat_number, case m when 1 then '从校园信息中识别出的提交截止时间。' end as description, case m when 1 then 120 else 30 end::int as reminder_minutes, case when m < 4 then 0.82 else 0.78 end::double as confidence,
        null::varchar as teacher, null::int as day_of_week, null::int as period_start, null::int as period_end, null::int as week_start, null::int as week_end, null::varchar as week_type, null::int[] as specific_weeks from d""",
    "ocr_scores": r"""with e as (select *, (['一','二','三','四','五','六','日'])[user_id % 7 + 1] as wd, event_id % 300 + 100 as k, strftime(ts, '%-m月%-d日 ') as md, hour(ts) as h, strftime(ts, ':%M') as mi from events),
      n as (select event_id, case event_id % 6 when 0 then '2026年' || md || h || mi || '-' || (h + 1) || mi || ' 操作系统考试 地点：教学楼 A' || k when 1 then md || '23:59 截止提交实验报告' when 2 then '下周' || wd || '晚上七点开班会，地点线上会议' when 3 then '明天下午3点讲座，地点：图书馆报告厅'
        when 4 then '今天 ' || h || mi || ' 记得带伞' else '周' || wd || ' 8点到10点 活动 教室B' || k end as text from e),
      a as (select event_id, translate(text, '：／（）．—–－一', ':/().----') as t from n), b as (select event_id, regexp_replace(regexp_replace(t, '([\x{4e00}-\x{9fa5}])\s+([\x{4e00}-\x{9fa5}])', '\1\2', 'g'), '([\x{4e00}-\x{9fa5}])\s+([\x{4e00}-\x{9fa5}])', '\1\2', 'g') as t from a)
      select event_id, len(regexp_extract_all(t, '(?:20[0-9]{2}\s*年?)?\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日?')) * 8.0::double + len(regexp_extract_all(t, '[0-9]{1,2}\s*:\s*[0-9]{2}')) * 5.0::double + len(regexp_extract_all(t, '(?:经世楼|颐德楼|明德楼|笃行楼|教学楼|实验楼|晨曦排球场)\s*[A-Za-z]?\s*[0-9]{0,4}')) * 7.0::double
        + len(regexp_extract_all(t, '数据结构|离散数学|高等数学|计算机网络')) * 6.0::double + len(regexp_extract_all(t, '周[一二三四五六日天]|[0-9]{1,2}\s*[-~至到]\s*[0-9]{1,2}\s*节')) * 4.0::double + least(length(t), 900) / 120.0::double as score from b""",
    "first_literal": "with t as (select p_partkey, p_name, case p_partkey % 3 when 0 then substring(p_name, 2, 2) when 1 then 'e' end as x from part) select p_partkey, case when x is null or x = '' or instr(p_name, x) = 0 then p_name else substring(p_name, 1, instr(p_name, x) - 1) || ' ' || substring(p_name, instr(p_name, x) + length(x)) end as rest from t",
}
