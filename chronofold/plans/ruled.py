"""Queries over tables drawn with rules. Each customer has a page: a grid of eight columns, whose inner rules do not cross all of them, and the words of its orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import events as E
from chronofold.operators import pages as P
from chronofold.operators import ruled as R
from chronofold.sources.tables import table

# query and SQL draw the same rules: upright ones up to 2 beside their place, level ones in a piece for each column, some in two pieces, some absent
_UPRIGHT = ("60 * c + (c_custkey + c) % 3", "10", "330")
_LEVEL = ("60 * c + p * 30 - p * 2", "60 * c + 30 + p * 30", "20 + 40 * r + (c_custkey + c + r) % 2")
_DRAWN = "r in (0, 1, 7) or (c_custkey + 2 * c + r) % 3 > 0"
_WORDS = {"x": "60 * (o_orderkey % 8) + 8 + o_orderkey % 40", "y": "24 + 40 * (o_custkey % 3 + o_orderkey % 5) + o_orderkey % 30", "text": "'w' || o_orderkey % 997"}


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = E.spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")  # a page has over a hundred rules
    number = lambda e: F.expr(e).cast("double")
    x, y0, y1 = _UPRIGHT
    up = pages.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("c")).select(F.col("c_custkey").alias("page"), number(x).alias("x0"), number(y0).alias("y0"), number(x).alias("x1"), number(y1).alias("y1"))
    level = pages.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r")).where(_DRAWN).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("p"))
    x0, x1, y = _LEVEL
    return up.unionByName(level.select(F.col("c_custkey").alias("page"), number(x0).alias("x0"), number(y).alias("y0"), number(x1).alias("x1"), number(y).alias("y1")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("seq"), F.expr(_WORDS["x"]).cast("double").alias("x"), F.expr(_WORDS["y"]).cast("double").alias("y"), F.expr(_WORDS["text"]).alias("text"))


def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ruled_cells(_rules(spark, sf_dir), _words(spark, sf_dir), ["page"])


def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the same pages as a timetable: a head above, an entry for each order, through the cells to course lines."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("o_orderkey % 7 + 1").alias("c"))
    heads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(F.array(*[F.lit(h) for h in P.HEADERS[:7]])).alias("d", "text")).select("page", (-1 - F.col("d")).cast("long").alias("seq"), (F.col("d") * 60 + 90).cast("double").alias("x"), F.lit(40.0).alias("y"), "text")
    row = F.expr("(o_orderkey div 7) % 6")
    entry = lambda text, step: orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("seq"), (F.col("c") * 60 + 30).cast("double").alias("x"), (F.lit(70.0) + 40 * row + step).alias("y"), text.alias("text"))
    title, details = F.concat(F.lit("操作系统"), F.expr("o_orderkey % 97").cast("string"), F.lit("▲")), F.concat(F.lit("(1-2节)1-16周/场地:B"), F.expr("o_orderkey % 900").cast("string"), F.lit("/教师:甲"))
    # only orders that are alone in their column keep a line of their own
    alone = orders.groupBy("o_custkey", "c").agg(F.count("*").alias("n")).where("n = 1").select(F.col("o_custkey").alias("page"), (F.col("c") * 60 + 30).cast("double").alias("x"))
    words = heads.unionByName(entry(title, F.lit(0)).join(alone, ["page", "x"]).select("page", "seq", "x", "y", "text")).unionByName(entry(details, F.lit(8)).join(alone, ["page", "x"]).select("page", "seq", "x", "y", "text"))
    return P.table_lines(R.ruled_cells(_rules(spark, sf_dir), words, ["page"]), "page").select("page", "column_index", "line")


_GRID_SQL = f"""up as (select distinct c_custkey as page, ({_UPRIGHT[0]})::double as pt from customer, range(0, 9) t(c)),
  ups as (select page, pt, sum(new) over (partition by page order by pt) as s from (select *, case when pt - lag(pt) over (partition by page order by pt) > 3 then 1 else 0 end as new from up)),
  ex as (select page, avg(pt) as e from ups group by page, s), col as (select page, row_number() over w - 1 as j, e as l, lead(e) over w as r from ex window w as (partition by page order by e)),
  lev as (select c_custkey as page, ({_LEVEL[0]})::double as x0, ({_LEVEL[1]})::double as x1, ({_LEVEL[2]})::double as y from customer, range(0, 8) t(c), range(0, 8) u(r), range(0, 2) v(p) where {_DRAWN}),
  ys as (select page, y, sum(new) over (partition by page order by y) as s from (select *, case when y - lag(y) over (partition by page order by y) > 3 then 1 else 0 end as new from (select distinct page, y from lev))),
  ey as (select page, s, avg(y) as e from ys group by all),
  seg as (select page, s, x0, x1, sum(new) over (partition by page, s order by x0, x1) as g from (select *, case when x0 - max(x1) over (partition by page, s order by x0, x1 rows between unbounded preceding and 1 preceding) > 3 then 1 else 0 end as new from (select distinct page, s, x0, x1 from lev join ys using (page, y)))),
  rule as (select page, s, min(x0) as x0, max(x1) as x1 from seg group by page, s, g),
  part as (select distinct page, j, s, e from rule join ey using (page, s) join col using (page) where r is not null and x0 <= l + 3 and x1 >= r - 3),
  box as (select page, j, s as row_index, e as top, lead(e) over (partition by page, j order by e) as bottom from part)"""
_CELLS_SQL = f"""with {_GRID_SQL}, w as (select o_custkey as page, o_orderkey as seq, ({_WORDS["x"]})::double as x, ({_WORDS["y"]})::double as y, {_WORDS["text"]} as text from orders),
  inside as (select w.*, b.j, b.row_index from w join col c on c.page = w.page and w.x >= c.l and w.x < c.r join box b on b.page = w.page and b.j = c.j and w.y >= b.top and w.y < b.bottom),
  n as (select *, sum(new) over (partition by page, row_index, j order by y, x, seq) as line from (select *, case when y - lag(y) over (partition by page, row_index, j order by y, x, seq) > 3 then 1 else 0 end as new from inside)),
  l as (select page, row_index, j, line, string_agg(text, ' ' order by x, seq) as text from n group by all)
  select page, cast(row_index as int) as row_index, cast(j as int) as column_index, string_agg(text, chr(10) order by line) as text from l group by all"""
_LINES_SQL = """with o as (select o_custkey as page, o_orderkey as k, o_orderkey % 7 + 1 as c from orders), alone as (select page, c from o group by all having count(*) = 1)
  select page, cast(c as int) as column_index, '周' || '一二三四五六日'[c] || ' 1-2节 操作系统' || (k % 97) || ' 甲老师 B' || (k % 900) || ' 1-16周' as line from o join alone using (page, c) where page in (select c_custkey from customer)"""

QUERIES = {f.__name__: f for f in (ruled_cells, ruled_lines)}
ORACLES = {"ruled_cells": _CELLS_SQL, "ruled_lines": _LINES_SQL}
