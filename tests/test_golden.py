"""Golden cases; names and rooms are invented."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions import extract as X
from chronofold.functions import labels as L
from chronofold.functions import text as N
from chronofold.functions.names import split_names, split_names_column
from chronofold.operators import calendar as C
from chronofold.operators import events as E
from chronofold.operators import geometry as G
from chronofold.operators import ocr as O
from chronofold.operators import recurrence as R
from chronofold.operators import store as S
from chronofold.operators import templates as T
from chronofold.sources import pdf, sinks, uploads

AS_OF = "2026-06-15"  # a Monday


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(("start", "end", "kind", "listed", "want"), [
    (1, 6, "EVERY_WEEK", None, [1, 2, 3, 4, 5, 6]), (1, 6, "ODD_WEEK", None, [1, 3, 5]), (1, 6, "EVEN_WEEK", None, [2, 4, 6]), (1, 16, "SPECIFIC_WEEKS", [3, 7, 12], [3, 7, 12]),
    (1, 10, "SPECIFIC_WEEKS", [7, 3, 3, 12], [3, 7]), (5, 3, "EVERY_WEEK", None, []), (1, 3, "SPECIFIC_WEEKS", None, [])])
def test_weeks(spark, start, end, kind, listed, want):
    df = spark.createDataFrame([(start, end, kind, listed)], "week_start int, week_end int, week_type string, specific_weeks array<int>")
    assert df.select(C.rule_weeks().alias("w")).first().w == want


def test_first_even_week_and_clock_times(spark):
    c = spark.createDataFrame([(1, 5, 3, 4, 1, 16, "EVEN_WEEK", None)], "id int, day_of_week int, period_start int, period_end int, week_start int, week_end int, week_type string, specific_weeks array<int>")
    start = F.lit("2026-02-23").cast("date")
    assert str(C.first_occurrence(c, start).first().first_date) == "2026-03-06"
    first = C.course_occurrences(c, start, C.periods_frame(spark)).orderBy("week").first()
    assert (str(first.starts_at), str(first.ends_at)) == ("2026-03-06 10:10:00", "2026-03-06 11:50:00")
    assert str(spark.range(1).select(C.course_date(F.lit("2026-09-09").cast("date"), F.lit(1), F.lit(1)).alias("d")).first().d) == "2026-09-14"


COURSES = "id int, day_of_week int, period_start int, period_end int, week_start int, week_end int, week_type string, specific_weeks array<int>"


def test_recurrence_with_holidays(spark):
    c = spark.createDataFrame([(1, 5, 1, 2, 1, 5, "EVERY_WEEK", None), (2, 1, 1, 1, 1, 16, "SPECIFIC_WEEKS", [3, 7, 12])], COURSES)
    off = C.no_class_frame(spark, ["2026-09-25", "2026-10-02", "not a date"])
    rows = sorted(R.recurrences(c, F.lit("2026-09-07").cast("date"), C.periods_frame(spark), off).collect())
    assert rows[0].rrule == "FREQ=WEEKLY;INTERVAL=1;UNTIL=20261009T094000" and rows[0].exdates == "20260925T080000,20261002T080000"
    assert [r.suffix for r in rows[1:]] == ["1", "2", "3"] and rows[1].rrule is None


def test_calendar_text(spark):
    c = spark.createDataFrame([(1, 1, 1, 1, 1, 16, "SPECIFIC_WEEKS", [3, 7, 12])], COURSES)
    e = R.recurrences(c, F.lit("2026-02-23").cast("date"), C.periods_frame(spark), C.no_class_frame(spark, ["2020-01-01"]))
    lines = R.entry_lines(F.concat("id", F.lit("-"), "suffix"), R.compact_time(F.col("starts_at")), R.compact_time(F.col("ends_at")), F.lit("a,b"), F.lit(None).cast("string"), F.lit(""), F.col("rrule"), F.col("exdates"), F.lit(0), F.lit("20260101T000000"))
    ics = R.calendars(e.select(F.lit("x;y").alias("cal"), "id", "suffix", lines.alias("lines")), "cal", ["id", "suffix"], "lines").first().ics
    assert ics.count("BEGIN:VEVENT") == 3 and "SUMMARY:a\\,b" in ics and "X-WR-CALNAME:x\\;y" in ics and "VALARM" not in ics and ics.endswith("END:VCALENDAR")


def test_course_lines(spark):
    text = "周一 1-2节 操作系统 甲老师 教学楼B404 1-16周\n星期二 第3,4节 大学英语 乙老师 二教305 1-8周 单周\n周三 5-6 数据结构 丙老师 主楼A-301 第1-16周\n星期四\n7、8节 计算机网络 丁老师 实验楼3-201 9-16周"
    rows = E.course_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r.day_of_week, r.period_start, r.period_end) for r in rows] == [(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 7, 8)]
    assert [r.teacher for r in rows] == ["甲老师", "乙老师", "丙老师", "丁老师"] and rows[1].week_type == "ODD_WEEK"
    assert [r.name for r in rows] == ["操作系统", "大学英语", "数据结构", "计算机网络"] and rows[3].location == "实验楼3-201"


def test_exam_row(spark):
    df = spark.createDataFrame([(1, "序号 考试时间 考试科目\n1 2026年06月23日（13:00-15:00） 数据结构（C语言） 教学楼E202 57 分散\n打印时间 2026-06-01")], "doc_id int, text string")
    rows = E.validate_events(E.general_events(df, F.lit(AS_OF).cast("date"), "EXAM").withColumn("uncertain_fields", F.array().cast("array<string>"))).collect()
    assert len(rows) == 1
    assert (rows[0].start_time, rows[0].end_time, rows[0].seat_number) == ("2026-06-23T13:00:00", "2026-06-23T15:00:00", "57") and rows[0].title.endswith("考试")


@pytest.mark.parametrize(("text", "start", "end"), [("考试 03 : 00 - 15 : 00", "13:00", "15:00"), ("23:59 截止", "23:59", "24:59"), ("请在6/22晚上8点前提交", "20:00", "21:00"), ("开会", "09:00", "10:00"), ("下午2点到4点", "14:00", "16:00"), ("笔试 上午九点", "09:00", "11:00")])
def test_times(spark, text, start, end):
    t = one(spark, text, lambda c: X.time_of(N.normalize(c)))
    assert (t.start, t.end) == (start, end)


@pytest.mark.parametrize(("text", "want"), [("2026年6月21日", "2026-06-21"), ("2026-02-31", "2026-02-31"), ("2026-13-45 2026-01-02", "2026-01-02"), ("6/22晚上", "2026-06-22"), ("今晚", "2026-06-15"), ("后天", "2026-06-17"), ("下周五", "2026-06-26"), ("周一", "2026-06-15"), ("无", None)])
def test_dates(spark, text, want):
    assert one(spark, text, lambda c: X.date_of(N.normalize(c), F.lit(AS_OF).cast("date"))) == want


@pytest.mark.parametrize(("text", "want"), [("周一 1-2节 操作系统 教师:甲", "COURSE"), ("期末考试安排 考场", "EXAM"), ("作业 提交 截止", "HOMEWORK"), ("微信群截图", "NOTICE"), ("", "NATURAL_LANGUAGE")])
def test_routes(spark, text, want):
    assert one(spark, text, X.route) == want


def test_homework(spark):
    assert one(spark, "6月22日 23:59 截止提交实验报告", lambda c: X.homework_title(N.normalize(c))) == "提交实验报告"
    df = spark.createDataFrame([(1, "提交作业"), (2, "下周五晚上七点开班会，地点线上会议"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in E.recognize(df, F.lit(AS_OF).cast("date")).collect()}
    assert got[1].start_time == "2026-06-15T23:59:00" and got[1].reminder_minutes == 120
    assert (got[2].type, got[2].start_time, got[2].location, got[2].title) == ("MEETING", "2026-06-26T19:00:00", "线上会议", "班会") and 3 not in got and 4 not in got


def test_schedule_text(spark):
    text = "节次 上课时间 下课时间\n1 08:20 09:05\n第2节 09:15 10:00\n第三节 上课 10:20 下课 11:05\n08:00-08:45 第一节\n第二节 09:10"
    periods, warnings = T.parse_schedule(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.period_number, r.start_time, r.label) for r in periods.orderBy("period_number").collect()] == [(1, "08:20", "第一节"), (2, "09:15", "第二节"), (3, "10:20", "第三节")]
    assert [r.line_no for r in warnings.collect()] == [6]
    p = one(spark, "第一节从8点开始，8点45下课", T.period_of)
    assert (p.start, p.end) == ("08:00", "08:45")


def test_labels(spark):
    rows = spark.createDataFrame([(1, 0.92), (7, 0.76), (9, 0.48)], "d int, c double").select(L.weekday_name(F.col("d")).alias("d"), L.confidence_band(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("周一", "高置信"), ("周日", "需核对"), ("未知星期", "低置信")]


def test_detail_rows_and_cells(spark):
    assert one(spark, "x 100001 课一 5-6周 100002 课二 第7周 12345 100003 课三", O.split_details) == ["100001 课一 5-6周", "100002 课二 第7周 12345", "100003 课三"]
    assert one(spark, "计机网络 A 1", N.compact_cell) == "计算机网络A1" and one(spark, "座 5 7", N.compact_exam_row).endswith("57")


def test_visual_lines_are_anchored(spark):
    df = spark.createDataFrame([(1, 1, 100.0), (1, 2, 97.0), (1, 3, 94.0), (1, 4, 50.0)], "page int, seq int, y double")
    assert [r.line_no for r in G.visual_lines(df, "page").orderBy("seq").collect()] == [1, 1, 2, 3]


def test_patch_clears_with_present_null(spark):
    store = spark.createDataFrame([(1, "a", "b", False), (2, "a", "b", False)], "id int, title string, location string, user_edited boolean")
    p = spark.createDataFrame([(1, "z", None, ["location"])], "id int, title string, location string, present array<string>")
    assert sorted(map(tuple, S.patch(store, p, ["title", "location"]).collect())) == [(1, "a", None, True), (2, "a", "b", False)]


def test_names(spark):
    assert split_names("欧阳小明王五李小四") == "欧阳小明、王五、李小四" and split_names("abc") == "abc" and split_names(None) is None and split_names("") == ""
    assert split_names("夏侯惇王小明") == "夏侯惇、王小明" and split_names("王，小*明") == "王小明" and split_names("外聘12（日语）甲") == "外聘12（日语）" and split_names("甲乙丙丁戊") == "甲乙丙丁戊"
    assert split_names("江徐胡高林郭马") == "江徐胡、高林、郭马" and split_names("木子一水二二", surnames="木水") == "木子一、水二二"
    assert spark.createDataFrame([("江徐胡高林郭",)], "t string").select(split_names_column(F.col("t")).alias("x")).first().x == "江徐胡、高林郭"


def make_pdf() -> bytes:
    cmap = b"beginbfchar <0001> <5468> endbfchar beginbfrange <0002> <0003> <4E00> endbfrange"
    page = rb"1 0 0 1 10 700 Tm <00010002> Tj 1 0 0 1 10.5 650 Tm (a\(b\)\101) Tj"
    return b"%PDF-1.4\n" + b"".join(b"stream\n" + zlib.compress(x) + b"\nendstream\n" for x in (cmap, page))


def test_pdf(spark, tmp_path):
    assert pdf.positioned(make_pdf()) == [("周一", 10.0, 700.0), ("a(b)A", 10.5, 650.0)]
    (tmp_path / "a.pdf").write_bytes(make_pdf())
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    rows = pdf.extract_positioned(uploads.read_files(spark, str(tmp_path), "*.pdf")).orderBy("seq").collect()
    assert [r.text for r in rows] == ["周一", "a(b)A"]


def test_text_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x,y\n1,2")
    row = uploads.read_texts(spark, str(tmp_path / "in")).first()
    assert (row.source, row.text) == ("EXCEL", "x,y\n1,2")
    with pytest.raises(sinks.NoEvents):
        sinks.write_calendars(spark.createDataFrame([], "ics string"), str(tmp_path / "out"))
    sinks.write_calendars(spark.createDataFrame([("BEGIN",)], "ics string"), str(tmp_path / "out"))
    answer = sinks.answers(spark.createDataFrame([(1, 1, "t", 0.5)], "doc_id int, line_no int, title string, confidence double"), "doc_id").first().answer
    assert answer == '{"success":true,"confidence":0.5,"events":[{"title":"t","confidence":0.5}]}'
    good = uploads.extraction_result(spark.createDataFrame([(" x ", "table", True), ("", "text", True), ("y", "text", False)], "text string, mode string, success boolean")).collect()
    assert len(good) == 1 and good[0].confidence == 0.95


def test_stream(spark, tmp_path):
    import json

    from chronofold.streaming import intake

    (tmp_path / "a.json").write_text("\n".join(json.dumps({"doc_id": i, "text": "明天下午3点讲座。今天 9:30 会议" if i < 3 else "无", "arrived_at": f"2026-06-15T0{i}:00:00"}) for i in range(4)))
    first = intake.first_uploads(intake.read_arrivals(spark, str(tmp_path)))
    q = intake.sentence_events(first, AS_OF).writeStream.format("memory").queryName("got").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.type, r.date, r.time_start) for r in spark.table("got").collect()) == [("ACTIVITY", "2026-06-16", "15:00"), ("MEETING", "2026-06-15", "09:30")]


def test_expansion_round_trip(spark, sf_dir):
    from chronofold.sources.tables import arrangements

    a = arrangements(spark, sf_dir)
    weeks = C.gather_weeks(a.select("id", F.explode(C.rule_weeks()).alias("week")))
    assert a.select("id", C.rule_weeks().alias("w")).join(weeks, "id").where("w <> weeks").isEmpty()
    assert len(schema.NO_CLASS_DATES) == 33


def test_split_details_keeps_all_pieces(spark):
    got = one(spark, "head " + "123456 " * 100_005 + "654321 last", O.split_details)
    assert len(got) == 100_006 and got[-1] == "654321 last"
    assert one(spark, None, O.split_details) is None and one(spark, "", O.split_details) == []
