"""Queries on recognised cells, pages with timetables, model outputs and calendars of mixed events.

Inputs are written from keys of the tables in several forms, so that every branch is taken; the SQL runs its own patterns over the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import cells as X
from chronofold.functions import labels as L
from chronofold.functions.names import split_names_column
from chronofold.operators import calendar as C
from chronofold.operators import cells as K
from chronofold.operators import events as E
from chronofold.operators import pages as P
from chronofold.operators import recurrence as R
from chronofold.plans.calendar import COURSES, START
from chronofold.sources import uploads as U
from chronofold.sources.tables import arrangements, course_texts, notices, table


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _pick(values: list[str], n: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- cells of timetables

HEADS = ["操作系统_0{d}王小明", "数据结构（ ）II-1_0{d}李明、赵大", "线性 代数甲乙*丙", "无号课程", "工程训练(I)", "大学英语(A)_1{d}夏侯惇王小明"]
WEEKS = ["第{d}-1{d}周", "{d}，1{d}周", "{d}—9周 双周", "无", "第{d}周", "2·1{d}周"]
SLOTS = ["{d}-1{d}节", "{d} - 9 节", "第{d}节", "周 1一{d}节", "3～{d}节", "{d}-9节"]
PLACES = ["江女一教 A{d}03", "江安实验至c座3101", "B座3101>>", "", "工程训练中心工程训练中", "江安综合楼\nC座{d}"]


def _cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))  # noqa: E741
    d = (F.col("p") % 9 + 1).cast("string")
    fill = lambda values, n: F.replace(_pick(values, n % 6), F.lit("{d}"), d)
    text = F.concat_ws("\n", fill(HEADS, F.col("p")), fill(WEEKS, F.col("s")), fill(SLOTS, F.floor(F.col("p") / 6)), fill(PLACES, F.floor(F.col("s") / 6)))
    kind = F.when(F.col("l_linenumber") == 1, "weekdayHeader").otherwise("cell")
    text = F.when(kind == "weekdayHeader", _say("星 期", _pick(list("一二三四五六日"), F.col("l_orderkey") % 7))).otherwise(text)
    return l.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"), F.lit(0).alias("row_index"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("column_index"),
                    F.when((F.col("l_linenumber") > 1) & (F.col("p") % 4 == 0), 3).alias("day_of_week"), F.lit(None).cast("int").alias("period_start"), F.lit(None).cast("int").alias("period_end"), text.alias("text"))


def timetable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.main_courses(_cell_rows(spark, sf_dir))


DETAILS = ["10000012{d}数据结构(一)_0{d}回历大纲01 第{d}-1{d}周 星期三 {d}-9节 江安综合楼B 20{d}", "线性代数 {d}，1{d}周 双周 星期日 3 - {d} 节 江女一教A{d}03 99", "操作 系统大纲1 第{d}周 星期天 {d}-9节", "离散数学 1-16周 {d}-9节", "1{d}周 星期一 1-2节", "物理 星期二 L{d}节 2—{d}周 5-6节|>"]


def detail_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.replace(_pick(DETAILS, F.col("o_orderkey") % 6), F.lit("{d}"), (F.col("o_custkey") % 9 + 1).cast("string"))
    cells = o.select(F.col("o_orderkey").alias("image_id"), F.lit(1).alias("seq"), F.lit("courseDetailRow").alias("kind"), text.alias("text"))
    return K.detail_courses(cells)


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = timetable_cells(spark, sf_dir)
    return m.select("image_id", "seq", X.structured_line(*[F.col(c) for c in ("day_of_week", "period_start", "period_end", "name", "teacher", "place", "weeks")]).alias("line"))


def teacher_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 4 == 0, "夏侯惇王小明李四").when(F.col("c_custkey") % 4 == 1, _say("王小", F.col("c_custkey") % 10, "、李 明")).when(F.col("c_custkey") % 4 == 2, _say("外聘", F.col("c_custkey") % 10, "（日语）王")).otherwise("甲乙丙丁戊")
    return table(spark, sf_dir, "customer").select("c_custkey", split_names_column(text).alias("names"))


def _exam_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_custkey") % 9 + 1
    title = F.when(k % 5 == 0, "笮 了 0真").when(k % 5 == 1, "面 向 刈 象").when(k % 5 == 2, "数据结构(c语言)").when(k % 5 == 3, "")
    place = F.when(k % 3 == 0, "经 世 楼 B 3").when(k % 3 == 1, _say("颐德楼 H 10", d))
    parts = [(2, _say("2026年06月2", d, "日（1", d, "：00—1", d + 1, "：00）")), (3, title), (4, place), (5, F.when(k % 4 == 0, _say(d, " 1 "))), (6, F.when(k % 2 == 0, "分 散"))]
    row = _say("1 离散数学 经世楼B10", d, " 2", d, " 集中")
    cells = [F.struct(F.lit("examCell").alias("kind"), F.lit(1).alias("row_index"), F.lit(c).alias("column_index"), F.coalesce(t, F.lit("")).alias("text")) for c, t in parts]
    whole = F.struct(F.lit("examRow").alias("kind"), F.when(k % 2 == 0, 1).otherwise(7).alias("row_index"), F.lit(0).alias("column_index"), F.when(k % 7 > 0, row).otherwise("").alias("text"))
    full = F.struct(F.lit("full").alias("kind"), F.lit(0).alias("row_index"), F.lit(0).alias("column_index"), F.when(k % 10 == 0, "科目 高等数学 II").otherwise("科目").alias("text"))
    return o.select(k.alias("image_id"), F.posexplode(F.array(*cells, whole, full)).alias("seq", "c")).select("image_id", "seq", "c.*")


def exam_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.exam_lines(_exam_cells(spark, sf_dir))


def _browser_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, _say("数 字 经 济 ", k % 9, " 地：颐德接 师：甲，")).when(k % 4 == 1, "创 新 鹞 序 设 计 实 践 学分：3").when(k % 4 == 2, "星期一").otherwise("箅法分析 〈1-155 〉")
    return table(spark, sf_dir, "orders").select((k % 500).alias("image_id"), k.alias("seq"), (k % 7 + 1).cast("int").alias("day_of_week"), (k % 3).cast("int").alias("period_start"), (k % 3 + 1).cast("int").alias("period_end"), text.alias("text"))


def browser_cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("course_no"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("day_of_week"), (F.col("n_nationkey") % 2 + 1).cast("int").alias("period_start"), (F.col("n_nationkey") % 2 + 2).cast("int").alias("period_end"),
                                                  F.array(F.lit("数字.*济"), F.lit("经济")).alias("aliases"), _say("数字经济", F.col("n_nationkey")).alias("title"), F.lit("甲").alias("teacher"), F.lit("").alias("place"), F.lit("1-17周").alias("weeks"))
    return K.browser_lines(_browser_cells(spark, sf_dir), known)


def detail_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = _say("课程号 ", k + 1000000, " 操作系统 日历 大纲 第 ", k % 9 + 1, " - 16 周 单周 >> 星期三 >>", k % 9 + 1, "-12节 江安 综合楼B2+ ", k + 2000000, F.when(k % 2 == 0, " 课程号 日历").otherwise(" ：离散|大纲"), " 2-4周>>星期日>>1至2节 ", k + 3000000, " 物理")
    made = E.once(E.spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), lines=K.detail_lines(text))
    return made.select("o_orderkey", F.posexplode("lines").alias("n", "line"))


def cleaned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "大 学 物 理 〈 1 2 节 ） 地 ． 颐 德 檯 HI 教 师 ： 甲 / 课 程 性 质 简 称 ： 学").when(k % 5 == 1, _say("数字逻辑 ( 3-4节 ) 地：教学楼 B", k % 900 + 100, " 学分：3")).when(k % 5 == 2, "算 法 分 析 与 设 计 地 ： 经 世 楼 E 师：甲").when(k % 5 == 3, "上午").otherwise("工程训练III-")
    c = table(spark, sf_dir, "orders").select("o_orderkey", X.clean_cell(text, [("大学物理", "颐德楼H103"), ("算法分析", "经世楼E302")]).alias("clean"), F.when(k % 3 > 0, 1).alias("slot"))
    return c.select("o_orderkey", "clean", X.keeps_cell(F.col("clean"), F.lit("cell"), F.col("slot"), F.col("slot"), F.col("slot")).alias("kept"))


# ---------------------------------------------------------------- pages

def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: a heading, headers of three weekdays, two titles in each column with details below them."""
    k = F.col("c_custkey")
    item = lambda seq, text, x, y: F.struct(F.lit(seq).alias("seq"), (text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    items = [item(0, F.when(k % 7 > 0, _say("学生课表 ", k % 20 + 2010, "-", k % 20 + 2011, "学年第", k % 2 + 1, "学期")).otherwise("通知"), 10, 500), item(1, "上午", 5, 470), item(2, "12", 5, 460)]
    for n, day in enumerate(("星期一", "星期三", "星期日")):
        x = 100 * n + 60
        items += [item(10 * n + 10, day, x + 20, 480), item(10 * n + 11, _say("课 程", (k + n) % 5, "▲"), x, 450), item(10 * n + 12, _say("(", k % 4 + 1, "-5节)", n + 1, "-16周(单)/"), x + 1, 440), item(10 * n + 13, F.when(k % 3 > 0, "场地:B1/教师:甲/学分:2").otherwise("场地:B2"), x, 435),
                  item(10 * n + 14, "实验▲", x + 0.5, 400), item(10 * n + 15, F.when(k % 2 == 0, "(6-7节)3周/").otherwise("待定"), x + 1, 390)]
    items.append(item(50, "远处▲", 900, 450))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(F.array(*items)).alias("i")).select("doc_id", "i.*")


def page_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_schedules(_page_items(spark, sf_dir))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_texts(_page_items(spark, sf_dir))


def _table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cell = lambda r, c, text: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    cells = [cell(0, 0, "课表"), cell(1, 0, "节次"), cell(1, 1, "星 期 二"), cell(1, 2, F.when(k % 2 == 0, "星期五").otherwise("备注")), cell(2, 0, "▲(1-2节)/"),
             cell(2, 1, _say("前言\n高 数▲\n(", k % 9 + 1, "-10节)1-8周(双)/\n场地:A", k % 50, "/教师:甲\n\n物理 ▲\n(3-4节)")), cell(3, 2, "化学▲\n(5-6节)9周/"), cell(3, 1, F.lit(None).cast("string"))]
    return E.spread(table(spark, sf_dir, "customer").select(k.alias("doc_id"), "c_custkey"), "doc_id").select("doc_id", F.explode(F.array(*cells)).alias("c")).select("doc_id", "c.*")


def table_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_lines(_table_cells(spark, sf_dir))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text of all documents, tables of a half of them."""
    return P.document_texts(_page_items(spark, sf_dir), _table_cells(spark, sf_dir).where("doc_id % 2 = 0"))


# ---------------------------------------------------------------- events of any type

def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, ',"type":"HOMEWORK"').when(k % 3 == 1, ',"eventType":"EXAM"').otherwise(',"type":"PARTY"')
    raw = F.when(k % 5 == 4, "no json").otherwise(_say('{"events":[{"title":" ', F.col("c_name"), '"', kind, F.when(k % 4 > 0, ',"date":"2026-06-23"').otherwise(""), ',"timeStart":"', F.when(k % 2 == 0, "08:30").otherwise("8:30"), '","seatNumber":" 7 ","confidence":', (k % 3).cast("double"), ',"uncertainFields":', F.when(k % 2 == 0, '["date"]').otherwise("[]"), '},{"title":" "}]}'))
    return U.model_events(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey").select("c_custkey", "title", "type", "start_time", "end_time", "seat_number", "reminder_minutes", "confidence", "warnings", "rejected")


def period_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unscheduled(arrangements(spark, sf_dir), C.periods_frame(spark, schema.PERIODS[:8]))


def recognise_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = course_texts(spark, sf_dir).select("id", "text")
    out = E.recognize(t, F.lit("2026-06-15").cast("date"), "text", "id", schedule=(F.lit(START).cast("date"), C.periods_frame(spark, schema.PERIODS[:10])))
    return out.select("id", "title", "type", "start_time", "end_time", "location", "warning")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    e = e.select("user_id", k.alias("id"), _say("会议;", k).alias("title"), F.when(k % 6 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("start_time"), F.when(k % 2 == 0, F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm")).alias("end_time"),
                 F.when(k % 3 == 0, "FREQ=WEEKLY").alias("rrule"), F.when(k % 4 == 0, "礼堂").alias("location"))
    e = R.event_entries(e)
    uid = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("suffix"), F.lit(f"@{R.UID_DOMAIN}"))
    text = R.description(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(F.col("id") % 5 == 0, "12"), F.lit("TEXT"), F.lit(0.5))
    lines = R.entry_lines(uid, F.col("dtstart"), F.col("dtend"), F.col("title"), F.col("location"), text, F.col("rrule"), F.lit(None).cast("string"), F.lit(30), F.lit("20260101T000000"))
    return e.select("user_id", "id", "suffix", lines.alias("lines"))


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.calendars(_event_lines(spark, sf_dir), "user_id", ["id", "suffix"], "lines")


def display_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrangements(spark, sf_dir)
    kind = F.when(F.col("id") % 2 == 0, "COURSE").otherwise("EXAM")
    rrule, place, room = F.when(F.col("id") % 3 == 0, "FREQ=WEEKLY"), F.when(F.col("id") % 4 == 0, "礼堂"), F.when(F.col("id") % 5 == 0, "B1")
    source = _pick([*L.SOURCE_LABELS, "FAX"], F.col("id") % 8)
    return a.select("id", L.event_place(place, room).alias("place"), L.event_rule(kind, F.col("week_start"), F.col("week_end"), F.col("week_type"), rrule).alias("rule"), L.looked_up(source, L.SOURCE_LABELS).alias("source_label"),
                    L.when_text(kind, F.col("day_of_week"), F.col("period_start"), F.col("period_end"), F.lit("2026-06-23T08:00:00"), F.lit(None).cast("string")).alias("when_text"))


# ---------------------------------------------------------------- SQL

def _chain(t: str, steps) -> str:
    for p, r in steps:
        t = f"regexp_replace({t}, '{p}', '{r}', 'g')"
    return t


_S = r"\s"
_NUM = [("[—–－~～·]", "-"), ("([0-9])一([0-9])", r"\1-\2"), ("L( *-? *[0-9])", r"1\1")]
_NAME = [(r"[（(]\s*[）)]", "（II）"), (r"\(([^)]+)\)", r"（\1）"), (r"\s+", ""), ("_?[0-9]{2}$", ""), ("^工程训练（I）$", "工程训练")]
_PLACE = [(r"\s+", ""), ("江女", "江安"), ("实验至", "实验室"), ("([A-Za-z])座3101", r"\1座B101"), ("c座", "C座"), ("(工程训练中心)工程训练中$", r"\1工程训练中心"), ("[>》]+", "")]
_D = "cast(p % 9 + 1 as varchar)"
_FORM = lambda values, n: f"replace(({_sql_list(values)})[{n} % 6 + 1], '{{d}}', {_D})"
_COMPACT = r"translate({t}, '：／〈《〉》．', ':/(()).')"
_DAYS = "一二三四五六日"

_CELL_SQL = f"""l as (select l_orderkey as image_id, l_linenumber as seq, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all),
  c as (select image_id, seq, case when seq > 1 and p % 4 = 0 then 3 else case when seq % 2 = 1 and image_id in (select l_orderkey from lineitem where l_linenumber = 1) then image_id % 7 + 1 end end as day, concat_ws(chr(10), {_FORM(HEADS, 'p')}, {_FORM(WEEKS, 's')}, {_FORM(SLOTS, '(p // 6)')}, replace({_FORM(PLACES, '(s // 6)')}, '\\n', chr(10))) as text from l where seq > 1),
  t as (select image_id, seq, day, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: {_chain('x', _NUM)}) as ls from c),
  u as (select *, list_position(list_transform(ls, lambda x: contains(x, '周') and regexp_matches(x, '[0-9]')), true) as wa from t),
  v as (select *, list_position(list_transform(ls, lambda x, i: i >= wa and regexp_matches(x, '[0-9]+\\s*-\\s*[0-9]+\\s*节')), true) as pa, regexp_replace(array_to_string(ls[1:wa - 1], ''), '\\s+', '', 'g') as head from u where wa >= 2),
  w as (select *, regexp_matches(head, '(?i)^(.*?)(?:_?((?:[IVX]+-?[0-9]*)?)_?[0-9]{{2}})(.*)$') as coded, regexp_extract(head, '(?i)^(.*?)(?:_?((?:[IVX]+-?[0-9]*)?)_?[0-9]{{2}})(.*)$', ['a', 'b', 'c']) as k,
    regexp_extract(head, '^(.*?)([\\x{{4e00}}-\\x{{9fa5}}·]{{2,4}})[＊*](.*)$', ['a', 'b', 'c']) as st, regexp_replace(ls[wa], '\\s+', '', 'g') as wk from v where pa > 0 and day between 1 and 7),
  x as (select image_id, seq, trim({_chain("case when coded then k.a || k.b else st.a end", _NAME)}) as name, regexp_replace(case when coded then k.c else st.b || st.c end, '[＊*、，,\\s]', '', 'g') as teacher_text, nullif({_chain("array_to_string(ls[pa + 1:], '')", _PLACE)}, '') as place, cast(day as int) as day_of_week,
    cast(regexp_extract(ls[pa], '([0-9]{{1,2}})\\s*-\\s*([0-9]{{1,2}})\\s*节', 1) as int) as period_start, cast(regexp_extract(ls[pa], '([0-9]{{1,2}})\\s*-\\s*([0-9]{{1,2}})\\s*节', 2) as int) as period_end,
    case when regexp_matches(wk, '^[0-9]{{1,2}}[,，、][0-9]{{1,2}}周') then regexp_replace(regexp_extract(wk, '^[0-9]{{1,2}}[,，、][0-9]{{1,2}}周', 0), '^([0-9]+)[,，、]([0-9]+)周', '第\\1周 第\\2周') else regexp_replace(wk, '^第', '') end as weeks from w),
  main as (select image_id, seq, name, nullif(case teacher_text when '夏侯惇王小明' then '夏侯惇、王小明' when '李明赵大无' then '李明、赵大无' else teacher_text end, '') as teacher, place, day_of_week, period_start, period_end, weeks from x where name <> '')"""

_DETAIL_SQL = rf"""t as (select o_orderkey as image_id, regexp_replace({_chain("regexp_replace(" + _COMPACT.format(t="replace((" + _sql_list(DETAILS) + ")[o_orderkey % 6 + 1], '{d}', cast(o_custkey % 9 + 1 as varchar))") + r", '\s+', '', 'g')", _NUM)}, '[>》|]', '', 'g') as t from orders),
  m as (select *, regexp_extract(t, '(?:第\s*)?[0-9]{{1,2}}(?:\s*[-,，、]\s*[0-9]{{1,2}})?\s*周(?:\s*双周|\s*单周)?', 0) as wk, regexp_extract(t, '星期([一二三四五六日天])', 1) as wd, regexp_extract(t, '([0-9]{{1,2}})\s*-\s*([0-9]{{1,2}})\s*节', ['a', 'b']) as p,
    regexp_extract(t, '江[安女](?:一教|综合楼|实验室|工程训练中心).*?[A-Za-z]\s*[0-9]{{3,4}}', 0) as pl from t),
  n as (select *, {_chain("substring(t, 1, instr(t, wk) - 1)", [("^[0-9]{8,}", ""), ("[0-9]{8,}.*$", ""), ("(?:日历|回历|历)?大纲0?1$", "")])} as b from m where wk <> '' and wd <> '' and p.a <> '')"""

_EXAM_SQL = """o as (select o_orderkey as k, o_custkey % 9 + 1 as d from orders),
  e as (select k, d, '2026年06月2' || d || '日(1' || d || ':00-1' || (d + 1) || ':00)' as time, case k % 5 when 0 then case when k % 10 = 0 then '高等数学II' else '笮了 0真' end when 1 then '面向对象' when 2 then '数据结构（C语言）' end as title,
    case k % 3 when 0 then '经世楼B3' when 1 then '颐德楼H10' || d end as cell, case when k % 4 = 0 then d || '1' end as seat, case when k % 2 = 0 then '分散' end as remark, k % 7 > 0 as has_row from o),
  f as (select *, case when has_row then '1 离散数学经世楼B10' || d || ' 2' || d || ' 集中' else '' end as row, case when has_row then '经世楼B10' || d end as rp from e),
  g as (select *, case when rp is not null and (cell is null or length(rp) > length(cell)) then rp else cell end as place from f)"""

_PAGE_SQL = """c as (select c_custkey as k, unnest([0, 1, 2]) as n from customer where c_custkey % 7 > 0),
  d as (select k, n, (['周一', '周三', '周日'])[n + 1] as day from c),
  e as (select k, 10 * n + 11 as pos, day || ' ' || (k % 4 + 1) || '-5节 课程' || ((k + n) % 5) || case when k % 3 > 0 then ' 甲老师 B1' else ' B2' end || ' ' || (n + 1) || '-16周 单周' as line from d
        union all select k, 10 * n + 14, day || ' 6-7节 实验 3周' from d where k % 2 = 0),
  f as (select k, line, min(pos) as pos from e group by all)"""

_ITEM_SQL = """c as (select c_custkey as k from customer), n as (select k, unnest([0, 1, 2]) as n from c),
  i as (select k, 0 as seq, case when k % 7 > 0 then '学生课表' || (k % 20 + 2010) || '-' || (k % 20 + 2011) || '学年第' || (k % 2 + 1) || '学期' else '通知' end as text, 10.0 as x, 500.0 as y from c
    union all select k, 1, '上午', 5, 470 from c union all select k, 2, '12', 5, 460 from c union all select k, 50, '远处', 900, 450 from c
    union all select k, 10 * n + 10, (['星期一', '星期三', '星期日'])[n + 1], 100 * n + 80, 480 from n union all select k, 10 * n + 11, '课程' || ((k + n) % 5), 100 * n + 60, 450 from n
    union all select k, 10 * n + 12, '(' || (k % 4 + 1) || '-5节)' || (n + 1) || '-16周(单)/', 100 * n + 61, 440 from n union all select k, 10 * n + 13, case when k % 3 > 0 then '场地:B1/教师:甲/学分:2' else '场地:B2' end, 100 * n + 60, 435 from n
    union all select k, 10 * n + 14, '实验', 100 * n + 60.5, 400 from n union all select k, 10 * n + 15, case when k % 2 = 0 then '(6-7节)3周/' else '待定' end, 100 * n + 61, 390 from n),
  p as (select *, case when x - lag(x) over (partition by k, y order by x, seq) > 18 then ' ' else '' end || text as piece from i),
  l as (select k, y, string_agg(piece, '' order by x, seq) as line from p group by all)"""

_TABLE_SQL = """select c_custkey as doc_id, 2 as row_index, 1 as column_index, 1 as entry, '周二 ' || (c_custkey % 9 + 1) || '-10节 高数 甲老师 A' || (c_custkey % 50) || ' 1-8周 双周' as line from customer union all select c_custkey, 2, 1, 2, '周二 3-4节 物理' from customer
      union all select c_custkey, 3, 2, 1, '周五 5-6节 化学 9周' from customer where c_custkey % 2 = 0"""

QUERIES = {f.__name__: f for f in (timetable_cells, detail_cells, canonical_lines, teacher_names, exam_line_cells, browser_cell_lines, detail_text_lines, cleaned_cells, page_schedules, page_texts, table_entries, document_texts, model_events, period_rejects, recognise_template, event_calendar, display_events)}
ORACLES = {
    "timetable_cells": f"with {_CELL_SQL} select * from main",
    "canonical_lines": f"""with {_CELL_SQL} select image_id, seq, concat_ws(' ', '周' || '{_DAYS}'[day_of_week], period_start || '-' || period_end || '节', name, '教师:' || teacher, weeks, '地点:' || place) as line from main""",
    "detail_cells": rf"""with {_DETAIL_SQL} select * from (select image_id, 1 as seq, trim({_chain('b', _NAME)}) as name, cast(null as varchar) as teacher, {_chain("nullif(pl, '')", _PLACE)} as place, case wd when '天' then 7 else instr('{_DAYS}', wd) end::int as day_of_week,
      p.a::int as period_start, p.b::int as period_end, regexp_replace(wk, '\s+', '', 'g') as weeks from n) where name <> ''""",
    "teacher_names": "select c_custkey, case c_custkey % 4 when 0 then '夏侯惇、王小明、李四' when 1 then '王小' || (c_custkey % 10) || '、李明' when 2 then '外聘' || (c_custkey % 10) || '（日语）' else '甲乙丙丁戊' end as names from customer",
    "exam_line_cells": f"""with {_EXAM_SQL} select k as image_id, 1 as row_index, concat_ws(' ', time, nullif(case when title is null or title = '' then row else title end, ''), place, coalesce(seat, case when has_row then '2' || d end), coalesce(remark, case when has_row then '集中' end)) as line from g""",
    "browser_cell_lines": f"""with c as (select o_orderkey as k, o_orderkey % 500 as image_id, cast(o_orderkey % 7 + 1 as int) as d, cast(o_orderkey % 3 as int) as s from orders where o_orderkey % 3 > 0 and o_orderkey % 4 <> 2),
      n as (select n_nationkey as no, n_nationkey % 7 + 1 as d, n_nationkey % 2 + 1 as s from nation), h as (select *, '周' || '{_DAYS}'[d] || ' ' || s || '-' || (s + 1) || '节 ' as head from c)
      select image_id, k as seq, coalesce(no + 1, 0)::int as course_no, head || case when no is not null then '数字经济' || no || ' 甲老师 1-17周' when k % 4 = 0 then '数字经济 ' || (k % 9) || '  地点:颐德楼  教师:甲' when k % 4 = 1 then '创新程序设计实践' else '算法分析 (1-15周 )' end as line
      from h left join n on n.d = h.d and n.s = h.s and k % 4 = 0""",
    "detail_text_lines": """select o_orderkey, 0 as n, '周三 ' || (o_orderkey % 9 + 1) || '-12节 操作系统 江安综合楼B2 第' || (o_orderkey % 9 + 1) || '-16周单周' as line from orders
      union all select o_orderkey, 1, '周日 1-2节 离散 2-4周' from orders where o_orderkey % 2 = 1""",
    "cleaned_cells": """with c as (select o_orderkey, case o_orderkey % 5 when 0 then '大学物理 颐德楼H103' when 1 then '数字逻辑 教学楼B' || (o_orderkey % 900 + 100) when 2 then '算法分析与设计 经世楼E302' when 3 then '上午' else '工程训练III' end as clean from orders)
      select o_orderkey, clean, o_orderkey % 5 <> 3 and o_orderkey % 3 > 0 as kept from c""",
    "page_schedules": f"""with {_PAGE_SQL}, g as (select k, '课程表' || chr(10) || string_agg(line, chr(10) order by pos) as text, count(*) as n from f group by k), s as (select *, case when k % 2 = 0 then make_date(k % 20 + 2010, 9, 1) else make_date(k % 20 + 2011, 2, 20) end as d from g)
      select k as doc_id, text, n, cast(d + cast((8 - isodow(d)) % 7 as int) as date) as semester_start from s""",
    "page_texts": f"with {_ITEM_SQL} select k as doc_id, string_agg(line, chr(10) order by y desc) as text, count(*) as n from l group by k",
    "table_entries": _TABLE_SQL,
    "document_texts": f"""select doc_id, text, 'table' as mode, n, 0.95::double as confidence from (with {_PAGE_SQL} select k as doc_id, '课程表' || chr(10) || string_agg(line, chr(10) order by pos) as text, count(*) as n from f group by k)
      union all select doc_id, string_agg(line, chr(10) order by row_index, column_index, entry), 'table', count(*), 0.95 from ({_TABLE_SQL}) where doc_id % 7 = 0 and doc_id % 2 = 0 group by doc_id
      union all select k, string_agg(line, chr(10) order by y desc), 'text', count(*), 0.78 from (with {_ITEM_SQL} select * from l) where k % 7 = 0 and k % 2 = 1 group by k""",
    "model_events": """with k as (select c_custkey, c_name, c_custkey % 4 > 0 as dated from customer where c_custkey % 5 <> 4) select c_custkey, c_name as title, case c_custkey % 3 when 0 then 'HOMEWORK' when 1 then 'EXAM' else 'REMINDER' end as type, case when dated then '2026-06-23T' || case when c_custkey % 2 = 0 then '08:30' else '09:00' end || ':00' end as start_time,
        case when dated then '2026-06-23T09:00:00' end as end_time, '7' as seat_number, case when c_custkey % 3 = 0 then 120 else 30 end as reminder_minutes, least(1, c_custkey % 3)::double as confidence, case when c_custkey % 2 = 0 then ['字段不确定: date'] end as warnings, case when not dated then c_name || ': 缺少日期' end as rejected from k
      union all select c_custkey, '', 'REMINDER', null, null, null, 30, 0.5, null, '缺少事件标题' from k""",
    "period_rejects": f"with {COURSES} select id, period_start, period_end, '节次不存在: ' || period_start || '-' || period_end as rejected from courses where period_start > 8 or period_end > 8",
    "recognise_template": f"""with {COURSES}, p as (select * from (values {", ".join(f"({r[0]}, '{r[1]}', '{r[2]}')" for r in schema.PERIODS[:10])}) t(n, s, e)),
      f as (select *, case when week_type = 'SPECIFIC_WEEKS' then week_start when week_type = 'ODD_WEEK' then case when week_start % 2 = 1 then week_start else week_start + 1 end when week_type = 'EVEN_WEEK' then case when week_start % 2 = 0 then week_start else week_start + 1 end else week_start end as fw from courses),
      g as (select *, case when fw > case when week_type = 'SPECIFIC_WEEKS' then fw else week_end end then week_start else fw end as w from f),
      d as (select *, cast(date '{START}' + cast(((day_of_week - isodow(date '{START}')) % 7 + 7) % 7 + 7 * (w - 1) as int) as date) as day from g)
      select id, '操作系统' || (id % 97) as title, 'COURSE' as type, case when period_start <= 10 and period_end <= 10 then day || 'T' || a.s || ':00' end as start_time, case when period_start <= 10 and period_end <= 10 then day || 'T' || b.e || ':00' end as end_time, '教学楼B' || (id % 900 + 100) as location,
        case when period_start > 10 or period_end > 10 then '作息模板缺少第 ' || period_start || '-' || period_end || ' 节' end as warning from d left join p a on a.n = period_start left join p b on b.n = period_end""",
    "event_calendar": r"""with e as (select user_id, event_id as k, strftime(ts, '%Y%m%dT%H%M%S') as s, case when event_id % 2 = 0 then strftime(date_trunc('minute', ts + interval 2 hour), '%Y%m%dT%H%M%S') else strftime(date_trunc('minute', ts + interval 1 hour), '%Y%m%dT%H%M%S') end as e from events where event_id % 6 > 0),
      l as (select user_id, k, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || k || '-0@chronofold.invalid', 'DTSTAMP:20260101T000000', 'DTSTART:' || s, 'DTEND:' || e, 'SUMMARY:会议\;' || k, case when k % 4 = 0 then 'LOCATION:礼堂' end, 'DESCRIPTION:' || case when k % 5 = 0 then '座位号: 12\n' else '' end || '来源: TEXT\n置信度: 50%',
        case when k % 3 = 0 then 'RRULE:FREQ=WEEKLY' end, 'BEGIN:VALARM', 'TRIGGER:-PT30M', 'ACTION:DISPLAY', 'DESCRIPTION:会议\;' || k || ' 即将开始', 'END:VALARM', 'END:VEVENT') as v from e)
      select user_id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'PRODID:-//chronofold//schedule//EN', 'X-WR-CALNAME:' || user_id, 'X-WR-TIMEZONE:Asia/Shanghai', string_agg(v, chr(13) || chr(10) order by k), 'END:VCALENDAR') as ics from l group by user_id""",
    "display_events": f"""with {COURSES} select id, case when id % 4 = 0 then '礼堂' when id % 5 = 0 then 'B1' else '地点待补充' end as place, case when id % 2 = 0 then '第 ' || week_start || '-' || week_end || ' 周 ' || case week_type when 'EVERY_WEEK' then '每周' when 'ODD_WEEK' then '单周' when 'EVEN_WEEK' then '双周' else '指定周' end when id % 3 = 0 then '重复事件' else '单次事件' end as rule,
      (['图片','PDF','Excel','文本','手动','识别示例','AI','FAX'])[id % 8 + 1] as source_label, case when id % 2 = 0 then (['周一','周二','周三','周四','周五','周六','周日'])[day_of_week] || ' 第 ' || period_start || '-' || period_end || ' 节' else '2026-06-23 08:00' end as when_text from courses""",
}
