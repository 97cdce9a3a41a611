"""Input tables and the domain rows derived from them by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course arrangement for every order: day, periods and week rule follow from its keys and priority."""
    week = F.col("o_custkey") % 5
    first = F.col("o_orderkey") % 11 + 1
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "SPECIFIC_WEEKS").when(F.col("o_orderpriority") == "2-HIGH", "ODD_WEEK").when(F.col("o_orderpriority") == "3-MEDIUM", "EVEN_WEEK").otherwise("EVERY_WEEK")
    whole = lambda c: c.cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), whole(F.col("o_orderkey") % 7 + 1).alias("day_of_week"), whole(first).alias("period_start"), whole(F.least(F.lit(12), first + F.col("o_custkey") % 3)).alias("period_end"),
        whole(week + 1).alias("week_start"), whole(week + 1 + F.col("o_orderkey") % 16).alias("week_end"), kind.alias("week_type"), F.array(whole(week + 1), whole(week + 4), whole(week + 41)).alias("specific_weeks"))


def course_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arrangement written as a timetable line: (id, name, teacher, room, text) beside its fields."""
    a = arrangements(spark, sf_dir)
    name = F.concat(F.lit("操作系统"), (F.col("id") % 97).cast("string"))
    teacher = F.concat(F.try_element_at(F.array(*[F.lit(x) for x in "甲乙丙丁"]), (F.col("id") % 4 + 1).cast("int")), F.lit("老师"))
    room = F.concat(F.lit("教学楼B"), (F.col("id") % 900 + 100).cast("string"))
    day = F.try_element_at(F.array(*[F.lit(x) for x in "一二三四五六日"]), F.col("day_of_week"))
    num = lambda c: F.col(c).cast("string")
    weeks = F.when(F.col("week_type") == "SPECIFIC_WEEKS", F.concat(F.lit("第"), num("week_start"), F.lit("周"))).otherwise(F.concat(num("week_start"), F.lit("-"), num("week_end"), F.lit("周"), F.when(F.col("week_type") == "ODD_WEEK", " 单周").when(F.col("week_type") == "EVEN_WEEK", " 双周").otherwise("")))
    line = F.concat(F.lit("周"), day, F.lit(" "), num("period_start"), F.lit("-"), num("period_end"), F.lit("节 "), name, F.lit(" "), teacher, F.lit(" "), room, F.lit(" "), weeks)
    return a.select("*", name.alias("name"), teacher.alias("teacher"), room.alias("room"), line.alias("text"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short notice for every event, in six forms: (event_id, as_of, text)."""
    e = table(spark, sf_dir, "events")
    month, day, hour, minute = (F.date_format("ts", p) for p in ("M", "d", "H", "mm"))
    weekday = F.try_element_at(F.array(*[F.lit(x) for x in "一二三四五六日"]), (F.col("user_id") % 7 + 1).cast("int"))
    k = (F.col("event_id") % 300 + 100).cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    after = (F.hour("ts") + 1).cast("string")
    forms = [say("2026年", month, "月", day, "日 ", hour, ":", minute, "-", after, ":", minute, " 操作系统考试 地点：教学楼 A", k), say(month, "月", day, "日 23:59 截止提交实验报告"), say("下周", weekday, "晚上七点开班会，地点线上会议"),
             say("明天下午3点讲座，地点：图书馆报告厅"), say("今天 ", hour, ":", minute, " 记得带伞"), say("周", weekday, " 8点到10点 活动 教室B", k)]
    text = F.try_element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", F.to_date("ts").alias("as_of"), text.alias("text"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the folder of checkpoints, for frames that several parts of a plan use.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set, as in tests, a local one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/chronofold-frames")
    return df.checkpoint()
