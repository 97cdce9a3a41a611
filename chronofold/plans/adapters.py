"""Queries on requests, older shapes and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.operators import adapters as A
from chronofold.plans.calendar import COURSES
from chronofold.sources.tables import arrangements, notices, table


def requested_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 5 == 0, "COURSE").when(F.col("event_id") % 5 == 1, "AUTO").when(F.col("event_id") % 5 == 2, "NATURAL_LANGUAGE")
    return notices(spark, sf_dir).select("event_id", A.requested_intent(asked, F.col("text")).alias("intent"))


def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    d = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" d"), k.cast("string"))).alias("direct"), F.when(k % 2 == 0, F.lit("t")).otherwise("").alias("table"), F.when(k % 7 > 0, F.lit("o")).alias("ocr"))
    return A.first_result(d, ["direct", "table", "ocr"]).select("page_id", "result", "strategy")


def flat_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = arrangements(spark, sf_dir).withColumns({"course_name": F.concat(F.lit("c"), F.col("id").cast("string")), "teacher": F.lit("甲"), "location": F.when(F.col("id") % 2 == 0, "B1"), "confidence": F.lit(0.5), "user_edited": F.lit(False)})
    e = A.from_flat_course(flat)
    return e.select("id", "title", "type", "location", "source", F.col("course.classroom").alias("classroom"), F.col("course.day_of_week").alias("day_of_week"), F.col("course.week_type").alias("week_type"))


def draft_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = arrangements(spark, sf_dir).withColumns({"course_name": F.lit("c"), "teacher": F.lit("甲"), "location": F.when(F.col("id") % 2 == 0, "B1"), "confidence": F.lit(0.5), "user_edited": F.lit(False), "week_end": F.when(F.col("id") % 3 > 0, F.col("week_end")), "period_end": F.when(F.col("id") % 4 > 0, F.col("period_end"))})
    e = A.from_flat_course(flat).withColumn("reminder_minutes", F.when(F.col("id") % 5 > 0, F.lit(10)))
    return A.draft_of(e).drop("title")


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    week = F.when(k % 5 == 0, "(单)").when(k % 5 == 1, "(双)").otherwise("")
    details = F.concat(F.when(k % 7 > 0, "(").otherwise("["), (k % 9 + 1).cast("string"), F.lit("-"), (k % 9 + 2).cast("string"), F.lit("节)1-16周"), week, F.when(k % 6 > 0, F.concat(F.lit("/校区:甲/ 场地:B"), (k % 99).cast("string"))).otherwise("/"), F.when(k % 2 == 0, "/教师:甲/课程号:1").when(k % 4 == 1, "/教师:乙").otherwise(""))
    header = F.when(k % 3 == 0, "星期一").when(k % 3 == 1, "星期天")
    return table(spark, sf_dir, "orders").select("o_orderkey", A.entry_line(F.lit("网 络▲"), details, header).alias("line"))


def misreading_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("place"))
    cat = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("misread"), F.concat(F.lit("→"), "p_brand").alias("canonical")).where(F.length("misread") > 0).distinct()
    return A.repaired(cells, cat, "place")


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with and without source, typed text and template, a row for each period that is in force."""
    k = F.col("c_custkey")
    own = F.struct(F.lit(1).alias("period_number"), F.concat(F.lit("0"), (k % 10).cast("string"), F.lit(":00")).alias("start_time"), F.lit("11:00").alias("end_time"), F.lit("own").alias("label"))
    periods = F.when(k % 5 == 0, F.array(own)).when(k % 5 < 3, F.slice(F.array(own), 1, 0))
    source = F.when(k % 4 == 0, F.col("c_mktsegment")).when(k % 4 < 3, "")
    asked = table(spark, sf_dir, "customer").select("c_custkey", A.requested_source(source, F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "")).alias("source"), A.requested_periods(periods).alias("p"))
    return asked.select("c_custkey", "source", F.explode("p").alias("p")).select("c_custkey", "source", "p.period_number", "p.start_time", "p.end_time")


_ROUTED = "case event_id % 6 when 0 then 'EXAM' when 1 then 'HOMEWORK' when 2 then 'NOTICE' when 3 then 'NOTICE' when 4 then 'NATURAL_LANGUAGE' else 'COURSE' end"

QUERIES = {f.__name__: f for f in (requested_intent, request_defaults, extraction_cascade, flat_courses, draft_defaults, entry_lines, misreading_repair)}
ORACLES = {
    "requested_intent": f"select event_id, case when event_id % 5 = 0 then 'COURSE' else {_ROUTED} end as intent from events",
    "request_defaults": f"""with d(n, a, b) as (values {', '.join(f"({n}, '{a}', '{b}')" for n, a, b, _ in schema.PERIODS)}),
      r as (select c_custkey, case when c_custkey % 4 = 0 and c_mktsegment <> '' then c_mktsegment when c_custkey % 3 = 0 and c_name <> '' then 'TEXT' else 'OCR_STUB' end as source from customer)
      select c_custkey, source, cast(n as int) as period_number, a as start_time, b as end_time from r, d where c_custkey % 5 > 0 union all select c_custkey, source, 1, '0' || (c_custkey % 10) || ':00', '11:00' from r where c_custkey % 5 = 0""",
    "extraction_cascade": "select page_id, case when page_id % 3 = 1 then 'd' || page_id when page_id % 2 = 0 then 't' when page_id % 7 > 0 then 'o' end as result, case when page_id % 3 = 1 then 'direct' when page_id % 2 = 0 then 'table' when page_id % 7 > 0 then 'ocr' end as strategy from pages",
    "flat_courses": f"with {COURSES} select id, 'c' || id as title, 'COURSE' as type, case when id % 2 = 0 then 'B1' end as location, 'AI' as source, case when id % 2 = 0 then 'B1' end as classroom, day_of_week, week_type from courses",
    "draft_defaults": f"with {COURSES} select id, case when id % 2 = 0 then 'B1' else '' end as place, day_of_week, period_start, case when id % 4 > 0 then period_end else period_start end as period_end, week_start, case when id % 3 > 0 then week_end else 16 end as week_end, case when id % 5 > 0 then 10 else 30 end as reminder_minutes from courses",
    "entry_lines": """select o_orderkey, case when o_orderkey % 3 < 2 and o_orderkey % 7 > 0 then '周' || case o_orderkey % 3 when 0 then '一' else '日' end || ' ' || (o_orderkey % 9 + 1) || '-' || (o_orderkey % 9 + 2) || '节 网络' || case when o_orderkey % 2 = 0 then ' 甲老师' when o_orderkey % 4 = 1 then ' 乙老师' else '' end
      || case when o_orderkey % 6 > 0 then ' B' || (o_orderkey % 99) else '' end || ' 1-16周' || case o_orderkey % 5 when 0 then ' 单周' when 1 then ' 双周' else '' end end as line from orders""",
    "misreading_repair": "select p_partkey, case when p_brand in (select p_brand from part where p_partkey % 3 = 0) and length(p_brand) > 0 then '→' || p_brand else p_brand end as place from part",
}
