"""Faults that a review found on larger tables, in small."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from chronofold.functions import cells as cell_functions
from chronofold.functions import extract
from chronofold.operators import cells as image_cells
from chronofold.operators import events, geometry, ocr, pages, ruled, store, templates
from chronofold.plans import tables


def test_large_uploads_do_not_overflow(spark, tmp_path):
    """A page of 30,000 letters counts as 3,000,000,000 bytes."""
    spark.createDataFrame([(10, "x" * 30_000)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = tables.upload_kinds(spark, str(tmp_path)).first()
    assert row["bytes"] == 3_000_000_000


def test_scores_that_differ_by_rounding_are_equal(spark):
    """0.1 + 0.2 is no better than 0.3, so the first reading is kept."""
    rows = spark.createDataFrame([(1, 1, "full", False, "a", 0.0), (1, 2, "full", False, "b", 0.0)], "image_id int, seq int, kind string, sparse boolean, text string, confidence double")
    score = lambda c: F.when(c == "a", F.lit(0.3)).otherwise(F.lit(0.1) + F.lit(0.2))
    assert ocr.chosen_readings(rows, score).first()["text"] == "a"


def test_documents_are_never_broadcast(spark):
    """Texts of documents are longer than the rows they are made from, whatever their estimated size."""
    items = spark.createDataFrame([(1, 1, "课表", 0.0, 1.0)], "doc_id long, seq int, text string, x double, y double")
    cells = spark.createDataFrame([(1, 1, 1, "星期一")], "doc_id long, row_index int, column_index int, text string")
    for df in (pages.page_schedules(items), pages.table_lines(cells), pages.document_texts(items, cells)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _patterns(df) -> int:
    """How many regular expressions the plan of a frame holds."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_") + plan.count("RLIKE")


def test_fields_search_each_pattern_once(spark):
    """Steps of a field do not repeat the steps below them."""
    line = spark.createDataFrame([("周一 8:00-9:40 考试", )], "c string")
    limits = {extract.time_of: 20, extract.week_rule: 8, extract.period_range: 10, extract.looks_like_exam_table: 10, templates.period_of: 24}
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    assert {f.__name__: n for f, most in limits.items() if (n := _patterns(line.select(f(F.col("c")).alias("x")))) > most} == {}


def test_texts_are_dealt_to_all_tasks(spark):
    """One small file of texts is not worked through by one task, and small bytes do not bring the tasks together again."""
    few = spark.range(8).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("周一 1-2节 数学 1-16周").alias("text"))
    assert events.course_lines(few).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert events.recognize(few, F.lit("2026-06-15").cast("date")).where("title = '数学' and type = 'COURSE'").count() == 8


def test_replay_has_no_frame_to_the_end(spark):
    """A frame up to its partition's end is summed anew for each row: the square of an id's actions."""
    log = spark.createDataFrame([(1, 1, 0, "append", "a", "x", ["t"]), (1, 2, 0, "update", "a", "y", ["t"]), (1, 3, 0, "update", "a", "z", ["t"]), (1, 4, 0, "append", "a", "w", ["t"])], "store_id int, seq long, pos int, action string, id string, t string, present array<string>")
    out = store.replayed(log, ["t"])
    assert "1, unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r.seq, r.t, r.user_edited) for r in out.collect()) == [(1, "z", True), (4, "w", False)]


def test_cells_search_each_pattern_once(spark):
    row = spark.createDataFrame([("1 离散数学 经世楼B101 21 集中",)], "c string")
    c = F.col("c")
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    found = {"exam_line": _patterns(row.select(cell_functions.exam_line(c, c, c, c, c, c, c).alias("x"))), "timetable_cell": _patterns(row.select(cell_functions.timetable_cell(c, F.lit(1)).alias("x"))), "detail_lines": _patterns(row.select(image_cells.detail_lines(c).alias("x")))}
    most = {"exam_line": 220, "timetable_cell": 60, "detail_lines": 50}
    assert {k: n for k, n in found.items() if n > most[k]} == {}


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rules_are_shuffled_once_by_page(spark):
    """Rules are worked on by page; places that come often and pieces that come twice count once."""
    level = [(0.0, 9.0, 31.0), (0.0, 9.0, 31.0), (33.0, 9.0, 100.0), (0.0, 10.0, 100.0), (0.0, 40.0, 30.0), (0.0, 90.0, 100.0)]
    rows = [(1, x, 0.0, x, 95.0) for x in (0.0, 50.0, 50.0, 52.0, 100.0)] + [(1, a, y, b, y) for a, y, b in level]
    rules = spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double")
    columns, bounds = ruled.column_bounds(rules, ["page"])
    assert _exchanges(columns) == 1 and _exchanges(bounds) == 2  # upright and level rules by page
    assert columns.first()["xs"] == [0.0, 51.0, 100.0]
    assert {r.column_index: [tuple(b) for b in r.bounds] for r in bounds.collect()} == {0: [(9.5, 0), (90.0, 2)], 1: [(9.5, 0), (90.0, 2)]}


def test_entries_of_a_cell_are_cut_where_it_stands(spark):
    """Only heads and cells with entries are shuffled, and none where documents are dealt already."""
    text = "before\r\n\r\n 甲▲ \r(1-2节)1-8周/\n 场地:A1\n乙▲\n丙▲\n(3-4节)9周/"
    cells = spark.createDataFrame([(1, 0, 1, "星期一"), (1, 1, 1, text), (1, 2, 1, "no title"), (1, 3, 1, None), (2, 1, 1, text)], "doc_id long, row_index int, column_index int, text string")
    dealt, out = pages.table_lines(events.spread(cells, "doc_id")), pages.table_lines(cells)
    assert set(dealt.collect()) == set(out.collect()) and _exchanges(pages.table_lines(events.spread(cells, "doc_id"))) == 2
    assert sorted((r.doc_id, r.row_index, r.entry, r.line.split()[1:3]) for r in out.collect()) == [(1, 1, 1, ["1-2节", "甲"]), (1, 1, 3, ["3-4节", "丙"])]


def test_details_are_not_multiplied_by_columns(spark):
    """Five columns of titles near each detail: only places meet them. One text at two places of a height is one detail, of the lower title."""
    titles = spark.createDataFrame([(1, float(x) / 2, 10.0 + x, f"t{x}") for x in range(5)] + [(1, 1.0, 5.0, "low")], "page int, x double, y double, title_id string")
    details = spark.createDataFrame([(1, n, f"d{n}", 1.0, 7.0) for n in range(3)] + [(1, 9, "e", 1.0, 2.0), (1, 9, "e", 5.0, 2.0), (1, 8, "out", 1.0, None)], "page int, seq int, text string, x double, y double")
    out = geometry.attach_details(titles, details, "page")
    assert " AS d#" not in out._jdf.queryExecution().optimizedPlan().toString()  # texts of details are not carried through the window
    assert {(r.title_id, r.details) for r in out.collect()} == {("t0", "d0 d1 d2"), ("low", "e")}


def test_literals_that_begin_alike_are_kept_apart(spark):
    """Numbers of one beginning have pieces of their own, and places where no literal begins are left out before pieces are made."""
    index = spark.createDataFrame([(1, f"程{n}号.*{n % 3}") for n in range(123450, 123470)] + [(1, "程1号.*1"), (2, "程7号")], "d int, alias string")
    assert index.select(ocr.required_piece(F.col("alias"))).distinct().count() == 22
    texts = spark.createDataFrame([(1, "第程123456号甲0程123456号"), (1, "第程123457号甲0"), (1, "程1号1"), (2, "程7号"), (1, "程7号"), (1, "")], "d int, t string")
    want = {(1, "第程123456号甲0程123456号", "程123456号.*0"), (1, "程1号1", "程1号.*1"), (2, "程7号", "程7号")}
    out = ocr.pattern_matches(texts, index, ["d"], "t", "alias")
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_courses_of_a_shared_alias_are_joined_as_blocks(spark):
    """all rows of an alias with many courses, repeated and null ones too, and its cells dealt to several tasks."""
    slot = (1, 3, 4)
    courses = [(*slot, "c.*7$", k if k % 50 else None, "x") for k in range(2500)] + [(*slot, "c.*7$", 9, "x")] * 2 + [(*slot, "c1$", 1, None), (2, 3, 4, "c.*7$", 6, "y")]
    cat = spark.createDataFrame(courses, "day_of_week int, period_start int, period_end int, alias string, course_id long, room string")
    cells = [(k, *slot, f"c{k}") for k in range(200)] + [(17, *slot, "c17"), (300, *slot, None), (301, 2, 3, 4, "c7"), (302, None, 3, 4, "c7")]
    out = ocr.catalogue_matches(spark.createDataFrame(cells, "image_id long, day_of_week int, period_start int, period_end int, text string").coalesce(1), cat)
    want = Counter((c[0], p[4], p[5]) for c in cells for p in courses if c[1:4] == p[:3] and c[4] and re.search(p[3], c[4]))
    assert out.columns == ["day_of_week", "period_start", "period_end", "alias", "image_id", "text", "course_id", "room"]
    assert Counter((r.image_id, r.course_id, r.room) for r in out.collect()) == want
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
