"""Recognised cells to lines and events: cases with invented names."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import cells as X
from chronofold.operators import calendar as C
from chronofold.operators import cells as K
from chronofold.operators import events as E
from chronofold.operators import pages as P

ITEM = "image_id int, seq int, kind string, row_index int, column_index int, day_of_week int, period_start int, period_end int, text string"
AS_OF = "2026-06-15"

# a school's rules, given by its user
RULES = [("大学物理", "颐德楼H103"), ("形势与政策III", "经世楼C304"), ("数字经济", "颐德楼H212"), ("算法分析与设计", "经世楼E302")]


def cells(spark, *rows):
    """Rows of (kind, row, column, day, start, end, text) of one image."""
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ITEM)


def slot(day, start, end, text):
    return ("cell", None, None, day, start, end, text)


def composed(df):
    return [r.text for r in K.image_texts(df, RULES).collect()][0]


def recognised(spark, text, intent):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return E.recognize(df, F.lit(AS_OF).cast("date"), intent=F.lit(intent)).orderBy("line_no").collect()


def test_noisy_cells_become_course_lines(spark):
    df = cells(spark, slot(4, 3, 4, "数 字 经 济 04 节 ） 1 凋 地 顳 德 接 H 之 师 甲 乙 程 性 质 简 称 嗵 核 分 ： 20"), slot(2, 10, 12, "大 学 物 理 〈 1 2 节 ） 1 巪 7 周 地 ． 颐 德 檯 HI ／ 教 师 ： 丙 丁 / 课 程 性 质 简 称 ： 学 基"),
               slot(5, 7, 9, "计 算 机 网 络 《 7 节 ） 07 周 地 ： 经 世 DI 师 ： 戊 己 程 性 质 简 称 ： 大 平"), slot(3, 4, 4, "形 势 与 政 策 III 04 节 ） （ 单 ） 地 ： 经 世 C ／ 教 师 ： 庚"))
    got = {r.title: r for r in recognised(spark, composed(df), "COURSE")}
    assert got["数字经济"].day_of_week == 4 and got["大学物理"].period_start == 10 and got["大学物理"].location == "颐德楼H103"
    assert got["计算机网络"].day_of_week == 5 and got["形势与政策III"].location == "经世楼C304"


def test_browser_cells_meet_a_catalogue(spark):
    cat = spark.createDataFrame([(1, 4, 3, 4, ["数字经济"], "数字经济", "甲乙", "颐德楼H212", "1-17周"), (2, 3, 5, 6, ["创新.*实践"], "创新程序设计实践", "丙", "颐德楼H303", "1-4周"), (3, 3, 5, 6, ["创新", "实践"], "创新程序设计实践", "丁", "颐德楼H303", "5-15周")],
                                "course_no int, day_of_week int, period_start int, period_end int, aliases array<string>, title string, teacher string, place string, weeks string")
    df = cells(spark, slot(4, 3, 4, "数 字 经 济 04 节 ）"), slot(3, 5, 6, "创 新 鹞 设 计 实 践 地 ： 颐 德 楼 H"), slot(5, 7, 9, "计 算 机 网 络 地 ： 经 世 DI"), slot(5, 1, 2, "星期五"), slot(1, 1, 2, None))
    lines = [r.line for r in K.browser_lines(df, cat).orderBy("seq", "course_no").collect()]
    assert lines == ["周四 3-4节 数字经济 甲乙老师 颐德楼H212 1-17周", "周三 5-6节 创新程序设计实践 丙老师 颐德楼H303 1-4周", "周三 5-6节 创新程序设计实践 丁老师 颐德楼H303 5-15周", "周五 7-9节 计算机网络  地点:经 世 DI"]
    assert K.browser_lines(df).count() == 3


def test_sparse_cells_give_way_to_the_full_text(spark):
    got = composed(cells(spark, ("full", None, None, None, None, None, "星期二 10-12节 大学物理 颐德楼H103 1-17周"), slot(4, 3, 4, "数字经济 颐德楼H212")))
    assert "大学物理" in got and "周四 3-4节" not in got
    assert composed(cells(spark, slot(4, 3, 4, "数字经济 颐德楼H212"))) == "周四 3-4节 数字经济颐德楼H212 颐德楼H212"


def test_exam_cells_and_rows(spark):
    cell = lambda r, c, t: ("examCell", r, c, None, None, None, t)
    row = lambda r, t: ("examRow", r, None, None, None, None, t)
    got = recognised(spark, composed(cells(spark, cell(1, 1, "1"), cell(1, 2, "2026年06月23日（13:00-15:00）"), cell(1, 3, "数据结构（C语言）"), cell(1, 4, "经世楼E202"), cell(1, 5, "57"))), "EXAM")
    assert [(r.start_time, r.end_time, r.location, r.seat_number) for r in got] == [("2026-06-23T13:00:00", "2026-06-23T15:00:00", "经世楼E202", "57")]
    got = recognised(spark, composed(cells(spark, row(None, "1 2026年06月23日（13:00-15:00） 数据结构（C语言） 经世楼E202 57 分散"), row(None, "2 2026年06月23日（16:00-18:00） 面向对象程序设计（JAVASE） 颐德楼H109 43 分散"))), "EXAM")
    assert [(r.title, r.location, r.seat_number) for r in got][0] == ("数据结构（C语言）考试", "经世楼E202", "57") and got[1].seat_number == "43"
    noisy = cells(spark, row(2, "2 2026 年 06 月 23 日 （ 16 ： 00 一 18 ： 00 ） 面 向 刈 象 程 序 设 计 (JAVASE) 颐 德 楼 旧 09 43 分 散"), cell(2, 2, "2026 年 06 月 23 日 （ 16 ： 00 一 18 ： 00 ）"), cell(2, 3, "面 向 刈 象 程 序 设 计 (JAVASE)"), cell(2, 4, "颥 德 楼 旧 09"), cell(2, 6, "分 散"),
                  row(6, "2026 年 07 月 01 日 0 3 ： 00 一 15 ： 00 ） 6 中 国 近 现 代 史 纲 要 经 世 楼 B103 2 集 中"), cell(6, 2, "2026 年 07 月 01 日 03 ： 00 一 15 ： 00 ）"), cell(6, 3, "中 国 近 现 代 史 纲 要"), cell(6, 4, "经 世 楼 B 3"),
                  row(7, "一 11 ： 00 ） II 7 2026 年 07 月 02 日 （ 09 ： 00 0 的 在 《 数 的 飞 经 世 楼 B404 1 7 集 中"), ("full", None, None, None, None, None, "考试科目 高等数学 II 教室名称 经世楼B404"), cell(7, 2, "2026 年 07 月 02 日 （ 09 ： 00 一 11 ： 00 ）"), cell(7, 3, "笮 了 0 真 《 数 会"), cell(7, 4, "经 世 楼 B404"))
    got = recognised(spark, composed(noisy), "EXAM")
    assert [(r.title, r.location, r.seat_number) for r in got] == [("面向对象程序设计 (JAVASE)考试", "颐德楼H109", "43"), ("中国近现代史纲要考试", "经世楼B103", "2"), ("高等数学II考试", "经世楼B404", "17")]
    assert got[1].start_time == "2026-07-01T13:00:00"


def test_main_cells_and_details(spark):
    df = cells(spark, ("weekdayHeader", 0, 1, None, None, None, "星 期 二"), ("cell", 1, 1, None, None, None, "操作系统_01王小明\n第1-16周\n1-2节\n江女一教 A103"), ("cell", 1, 2, None, None, None, "无星期_01\n1-2周\n1-2节"), ("cell", 2, 1, 5, None, None, "线性 代数甲乙丙丁*\n3，5周\n3 - 4节"),
               ("courseDetailRow", 3, None, None, None, None, "20001234 操作：系统 大纲01 第2-9周 双周 星期三 7-8节 江安综合楼B 202"), ("courseDetailRow", 4, None, None, None, None, "操作系统 2-9周 星期天 7-8节"))
    lines = [r.line for r in K.course_lines(df, RULES).orderBy("part", "seq").collect()]
    assert lines == ["周二 1-2节 操作系统 教师:王小明 1-16周 地点:江安一教A103", "周五 3-4节 线性代数 教师:甲乙丙丁 第3周 第5周", "周三 7-8节 操作:系统 教师:王小明 第2-9周双周 地点:江安综合楼B202", "周日 7-8节 操作系统 教师:王小明 2-9周 地点:江安一教A103"]
    assert composed(df).count("\n") == 3


def test_detail_rows_of_one_text(spark):
    text = "课程号 课程名 30100100 操作系统 日历 大纲 5-6周>>星期一>>1-2节 江安综合楼C101 30100101 离散数学 日历 第7周>> 星期二 >>3至4节 江安一教 A 201 + 30100102 物理 大纲 10-12周双周>>星期三>>5-6节 30100103 没有时间"
    got = spark.createDataFrame([(text,)], "t string").select(K.detail_lines(F.col("t")).alias("x")).first().x
    assert got == ["周一 1-2节 操作系统 江安综合楼C101 5-6周", "周二 3-4节 离散数学 江安一教A201 第7周", "周三 5-6节 物理 10-12周双周"]


def test_a_longer_place_of_the_row_wins(spark):
    place = lambda row, cell: spark.createDataFrame([(row, cell)], "r string, c string").select(X.exam_line(F.lit("t"), F.lit("x"), F.col("c"), F.lit(""), F.lit(""), F.col("r"), F.lit("")).alias("l")).first().l
    assert place("经世楼B103 2 集中", "经世楼B 3") == "t x 经世楼B103 2 集中" and place("经世楼 9 集中", "经世楼B103") == "t x 经世楼B103 9 集中" and place("", None) == "t x"


def test_unknown_periods_are_rejected(spark):
    a = spark.createDataFrame([(1, 1, 1, 2, 1, 2, "EVERY_WEEK", None), (2, 1, 11, 13, 1, 2, "EVERY_WEEK", None)], "id int, day_of_week int, period_start int, period_end int, week_start int, week_end int, week_type string, specific_weeks array<int>")
    p = C.periods_frame(spark, schema.PERIODS)
    assert [tuple(r) for r in C.unscheduled(a, p).collect()] == [(2, 11, 13, "节次不存在: 11-13")]
    assert {r.id for r in C.course_occurrences(a, F.lit("2026-09-07").cast("date"), p).collect()} == {1}


def test_page_guard_and_repeated_lines(spark):
    rows = [(1, 0, "课表 学期 2025-2026学年第2学期", 0.0, 900.0), (1, 1, "星期一", 60.0, 800.0), (1, 2, "高数▲", 50.0, 700.0), (1, 3, "(1-2节)1-8周/场地:A1/教师:甲/学分:1", 51.0, 690.0), (1, 4, "高数▲", 50.0, 600.0), (1, 5, "(1-2节)1-8周/场地:A1/教师:甲/学分:1", 51.0, 590.0), (2, 0, "课表", 0.0, 1.0)]
    items = spark.createDataFrame(rows, "doc_id int, seq int, text string, x double, y double")
    got = P.page_schedules(items).collect()
    assert [(r.doc_id, r.text, r.n, str(r.semester_start)) for r in got] == [(1, "课程表\n周一 1-2节 高数 甲老师 A1 1-8周", 1, "2026-02-23")]
    assert {r.doc_id: r.n for r in P.page_texts(items).collect()} == {1: 6, 2: 1}
