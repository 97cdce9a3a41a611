"""Queries on single fields: seat numbers, results of PDF extraction. Both sides run the rules on texts that the tables' keys fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import extract as X
from chronofold.sources import uploads as U
from chronofold.sources.tables import table

# expressions that Spark and SQL share
_PLACE = "case when o_orderkey % 5 > 0 then concat('教学楼A', o_custkey % 900 + 100) end"
_SEATED = """case o_orderkey % 8 when 0 then concat('高数 教学楼A', o_custkey % 900 + 100, ' ', o_orderkey % 120, ' 闭卷') when 1 then concat('教学楼A', o_custkey % 900 + 100, ' 座位号： ', o_orderkey % 20000)
  when 2 then concat('教学楼A', o_custkey % 900 + 100, o_orderkey % 50, '分散') when 3 then concat(o_orderkey % 3000, '开卷 ', '教学楼B') when 4 then concat('教学楼A', o_custkey % 900 + 100, '   ', o_orderkey % 30000)
  when 5 then concat('座号', o_orderkey % 70, ' 教学楼A', o_custkey % 900 + 100, ' 9') when 6 then concat('第', o_orderkey % 70, '场 教学楼A', o_custkey % 900 + 100, ' 考试') else concat(o_orderkey % 40, ' ') end"""
_PAYLOAD = {"text": "case c_custkey % 4 when 0 then concat('  ', c_name, ' ') when 1 then c_name when 2 then '   ' end", "mode": "case when c_custkey % 3 = 0 then 'table' else 'text' end", "success": "c_custkey % 5 > 0"}


def seat_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled seat, else the number right behind the place."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PLACE).alias("place"), F.expr(_SEATED).alias("text"))
    return t.select("o_orderkey", X.seat(F.col("text"), F.col("place")).alias("seat"))


def extraction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).alias(c) for c, e in _PAYLOAD.items()])
    return U.extraction_result(payloads).select("c_custkey", "text", "mode", "confidence", "source", "warnings")


QUERIES = {f.__name__: f for f in (seat_numbers, extraction_results)}
ORACLES = {
    "seat_numbers": rf"""with t as (select o_orderkey, {_PLACE} as place, {_SEATED} as text from orders),
      u as (select *, case when place is not null and contains(text, place) then substr(text, instr(text, place) + length(place)) else text end as tail from t)
      select o_orderkey, coalesce(nullif(regexp_extract(text, '(?:座位号?|座号|座位)\s*[:：]?\s*([0-9]{{1,4}})', 1), ''), nullif(regexp_extract(tail, '\A\s*([0-9]{{1,4}})\s*(?:分散|集中|闭卷|开卷|\z)', 1), '')) as seat from u""",
    "extraction_results": f"""with p as (select c_custkey, {", ".join(f"{e} as {c}" for c, e in _PAYLOAD.items())} from customer)
      select c_custkey, trim(text) as text, mode, case mode when 'table' then 0.95::double else 0.78::double end as confidence, 'PDF' as source, case mode when 'table' then []::varchar[] else ['PDF 未识别到表格结构，已使用文本抽取结果。'] end as warnings from p where success and trim(text) <> ''""",
}
