"""Queries on positioned text, recognised cells, the event store and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import calendar as C
from chronofold.operators import cells as K
from chronofold.operators import geometry as G
from chronofold.operators import ocr as O
from chronofold.operators import store as S
from chronofold.sources import uploads as U
from chronofold.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with one row per order and line number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text from ``lineitem``: whole numbers only, so that distances are exact."""
    l = _lines(spark, sf_dir)  # noqa: E741
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") * 40 + F.col("l_quantity") % 7).alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("text"), (F.col("l_partkey") % 3 == 0).alias("is_title"))


def nearest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.posexplode(F.sequence(F.lit(0), F.lit(6))).alias("seq", "k"), F.col("o_custkey")).select("page", "seq", F.concat(F.lit("周"), F.col("k").cast("string")).alias("label"), (F.col("k") * 50 + F.col("o_custkey") % 30).cast("double").alias("hx"))
    return G.nearest_header(_items(spark, sf_dir), h, "page", 20.0).select("page", "seq", "header")


def attach_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).withColumn("page", F.col("page") % 500).withColumn("x", F.col("x") % 20)
    i = i.withColumn("text", F.concat("text", F.lit("/"), F.col("seq").cast("string")))
    titles = i.where("is_title").groupBy("page", "x", "y").agg(F.min("text").alias("title_id"))
    details = i.where("not is_title").groupBy("page", "x", "y", "text").agg(F.min("seq").alias("seq"))
    return G.attach_details(titles, details, "page")


def bucket_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).withColumn("title_id", F.when(F.col("is_title"), F.col("seq")))
    return G.fill_by_bucket(i.withColumn("x", F.col("x") % 24), "page").select("page", "seq", "bucket", "owner")


def join_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.join_line(_items(spark, sf_dir).withColumn("x", F.col("x") % 60), ["page"])


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visual_lines(_items(spark, sf_dir), "page").select("page", "seq", "line_no")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("image_id"), (F.col("l_partkey") % 200).alias("idx")).agg(F.sum((F.col("l_quantity") > 25).cast("int")).alias("n"))


def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.islands(_counts(spark, sf_dir), "image_id", 2, 2)


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.longest_run(_counts(spark, sf_dir), "image_id", 2)


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)  # noqa: E741
    cells = l.select((F.col("l_orderkey") % 100).alias("grid"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell"), (F.col("l_partkey") % 300).cast("double").alias("y0"), (F.col("l_partkey") % 300 + F.col("l_quantity")).alias("y1"))
    bands = spark.range(100).select(F.col("id").alias("grid"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("band")).select("grid", "band", ((F.col("band") - 1) * 30).cast("double").alias("b0"), (F.col("band") * 30).cast("double").alias("b1"))
    return G.overlapped(cells, bands, "grid")


def top_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    img = l.select((F.col("l_orderkey") % 1000).alias("doc_id"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 900 + 100).alias("width"), (F.col("l_quantity").cast("int") * 20).alias("height"))
    return G.largest_images(img).select("doc_id", "page", "seq", "rank")


def entry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.session_entries(_items(spark, sf_dir).withColumnRenamed("page", "cell"), "cell")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)  # noqa: E741
    kind = F.try_element_at(F.array(*[F.lit(k) for k in ("cell", "examRow", "full", "courseDetailRow", "other")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return l.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 3).cast("int").alias("row_index"), (F.col("l_partkey") % 7 + 1).cast("int").alias("column_index"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("text"),
                    (F.col("l_suppkey") % 7 + 1).cast("int").alias("day_of_week"), (F.col("l_partkey") % 6 * 2 + 1).cast("int").alias("period_start"), kind.alias("kind"), (F.col("l_quantity") / 64).alias("confidence"))


def exam_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exam_cells(_cells(spark, sf_dir))


def header_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return O.day_of_cell(c, c.where("row_index = 0")).select("image_id", "seq", "header_day")


def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details meet main cells whose name differs by a colon or space; a third of the details have a place of their own."""
    name = F.concat(F.lit("n"), F.when(F.col("l_linenumber") % 2 == 0, " ").when(F.col("l_linenumber") % 3 == 0, "：").otherwise(""), (F.col("l_partkey") % 40).cast("string"))
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("image_id"), name.alias("name"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string"))).otherwise("").alias("teacher"),  # noqa: E741
                                                F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string"))).alias("place"), "l_linenumber", "l_orderkey")
    own = F.when(F.col("l_orderkey") % 3 == 0, "own").when(F.col("l_orderkey") % 3 == 1, "")
    return K.corroborated(l.where("l_linenumber = 1").select("l_orderkey", "image_id", "name", F.lit("?").alias("teacher"), own.alias("place")), l.where("l_linenumber > 1"))


def catalogue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), (F.col("p_partkey") % 7 + 1).cast("int").alias("day_of_week"), (F.col("p_partkey") % 6 * 2 + 1).cast("int").alias("period_start"), (F.col("p_partkey") % 6 * 2 + 2).cast("int").alias("period_end"), F.concat(F.lit("c.*"), (F.col("p_partkey") % 10).cast("string"), F.lit("$")).alias("alias"))
    cells = _cells(spark, sf_dir).withColumn("period_end", F.col("period_start") + 1)
    return O.catalogue_matches(cells, cat).select("image_id", "seq", "course_id")


def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue whose aliases hold a literal of their own; a cell names one of its slot's courses, or half of one."""
    slot = lambda k: [(k % 7 + 1).cast("int").alias("day_of_week"), (k % 6 * 2 + 1).cast("int").alias("period_start"), (k % 6 * 2 + 2).cast("int").alias("period_end")]
    k, part = F.col("p_partkey"), F.col("l_partkey")
    cat = table(spark, sf_dir, "part").select(k.alias("course_id"), *slot(k), F.concat(F.lit("[课科]程"), k.cast("string"), F.lit("号.*"), (k % 3).cast("string")).alias("alias"))
    said = F.concat(F.lit("第"), F.when(part % 5 > 0, "课").otherwise("科"), F.lit("程"), part.cast("string"), F.when(part % 7 > 0, "号").otherwise(""), F.lit("甲"), (F.col("l_suppkey") % 3).cast("string"))
    cells = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *slot(part), said.alias("text"))
    return O.catalogue_matches(cells, cat).select("l_orderkey", "l_linenumber", "course_id")


def chosen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of an image of four kinds in two passes, of texts with more and fewer signs of a timetable; some are equal but for their place."""
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    text = F.concat(F.when(k % 3 > 0, F.lit("2026年6月2日 13:00")).otherwise(""), F.when(k % 4 > 0, F.concat(F.lit("  经世楼B10"), (k % 9).cast("string"))).otherwise(""), F.when(n % 3 == 0, "大学物理 周一 1 - 2 节").otherwise("某课"), F.when(n % 5 == 0, "注意事项").otherwise(""), F.repeat(F.lit("字"), (k % 11 * 12).cast("int")))
    kind = F.try_element_at(F.array(*[F.lit(x) for x in ("table", "cell", "detail", "full")]), (k % 4 + 1).cast("int"))
    readings = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"), (n % 2 == 0).alias("sparse"), F.when(k % 13 > 0, text).alias("text"), (F.col("l_quantity") * 3 - 10).alias("confidence"))
    return O.chosen_readings(readings)


def compose_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of five forms: exam cells, exam rows, detail rows, a full text, cells without a slot of a course."""
    k = F.col("image_id")
    detail = F.concat(F.lit("10000001 课"), (k % 7).cast("string"), F.lit("甲 大纲 1-16周 星期二 3-4节 江安综合楼B 202"))
    kind = F.when(k % 5 == 0, F.when(F.col("seq") % 2 == 0, "examCell").otherwise("full")).when(k % 5 == 1, "examRow").when(k % 5 == 2, "courseDetailRow").when(k % 5 == 3, F.when(F.col("seq") == 1, "full").otherwise("courseDetailRow")).otherwise("cell")
    text = F.when(F.col("kind") == "examCell", F.concat(F.lit("数据"), F.col("seq").cast("string"))).when(F.col("kind") == "examRow", F.concat(F.lit("考 试 "), F.col("text"))).when(F.col("kind") == "courseDetailRow", detail).when(F.col("kind") == "full", F.concat(F.lit("全 文："), F.col("text"))).otherwise(F.lit("星期"))
    c = _cells(spark, sf_dir).withColumn("kind", kind).withColumn("text", text).withColumn("column_index", F.when(F.col("kind") == "examCell", 3).otherwise(F.col("column_index"))).withColumn("period_end", F.col("period_start"))
    return K.image_texts(c)


def target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = O.target_text(_cells(spark, sf_dir))
    return t.withColumn("final", O.recognised_confidence(F.size(F.split("text", "\n")), F.col("confidence")))


def split_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("head "), (k + 1000000).cast("string"), F.lit(" 课  一 5-6周 "), (k + 2000000).cast("string"), F.lit(" 课二\n第7周 12345 "), F.when(k % 2 == 0, (k + 3000000).cast("string")).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(O.split_details(text)).alias("n", "line"))


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("image_id"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_quantity") > 25).cast("int").alias("dark"))
    return O.column_sums(px)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("location"), (F.col("c_custkey") % 4 == 0).alias("user_edited"))


def store_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    present = F.when(k % 3 == 0, F.array(F.lit("title"))).when(k % 3 == 1, F.array(F.lit("location"))).otherwise(F.array(F.lit("title"), F.lit("location")))
    p = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(k.alias("id"), F.lit("new").alias("title"), F.when(k % 2 == 0, "there").alias("location"), present.alias("present"))
    return S.patch(_store(spark, sf_dir), p, ["title", "location"])


def _ids(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(rule).select(F.col("c_custkey").alias("id"))


def store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remove(_store(spark, sf_dir), _ids(spark, sf_dir, "c_custkey % 5 = 0"))


def store_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.toggle(_ids(spark, sf_dir, "c_custkey % 2 = 0"), _ids(spark, sf_dir, "c_custkey % 3 = 0"))


def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return S.append(S.select_all(s, False), s.where("id % 10 = 0"))


def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one action for each event, by forty stores of nine ids; a few sets and resets lie early in it."""
    k = F.col("event_id")
    action = F.when((k % 97 == 0) & (k < 500), F.when(k % 2 == 0, "set").otherwise("reset")).when(k % 89 == 0, F.when(k % 2 == 0, "select_all").otherwise("clear"))
    for n, name in enumerate(("append", "append", "update", "update", "toggle", "toggle")):
        action = action.when(k % 7 == n, name)
    title = F.when(k % 5 > 0, F.concat(F.lit("t"), k.cast("string")))
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("store_id"), k.alias("seq"), F.lit(0).alias("pos"), action.otherwise("remove").alias("action"), F.floor(F.col("value")).cast("long").alias("v"), title.alias("title"), F.col("event_type").alias("place"),
                                                F.when(k % 3 == 0, F.array(F.lit("title"))).when(k % 3 == 1, F.array(F.lit("place"))).otherwise(F.array(F.lit("title"), F.lit("place"))).alias("present"))
    return S.replayed(log.withColumn("id", F.col("v") % 9).drop("v"), ["title", "place"])


def export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.export_selected(_store(spark, sf_dir), _ids(spark, sf_dir, "c_custkey % 7 = 0"))


def no_class_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("d"))
    more = C.normalized_dates(days.unionByName(spark.sql("select ' 2030-01-01 ' as d union all select '2030-1-2'")), "d")
    return more.join(table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderdate").cast("date").cast("string").alias("d")), "d", "left_anti")


def draft_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    num = F.when(k % 6 == 0, "").when(k % 6 == 1, "abc").when(k % 6 == 2, " 3.5 ").when(k % 6 == 3, "99999").when(k % 6 == 4, "-4").otherwise((k % 10).cast("string"))
    d = table(spark, sf_dir, "customer").select(k.alias("id"), num.alias("day"), num.alias("period"), num.alias("week"), num.alias("reminder"), F.when(k % 2 == 0, "EXAM").otherwise("COURSE").alias("type"), F.when(k % 4 == 0, " 7 ").otherwise(" ").alias("seat"), F.when(k % 3 == 0, " ").otherwise(" here ").alias("place"), F.lit("room").alias("room"))
    return S.draft_patch(d)


def upload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = ["pdf", "JPG", "heic", "csv", "txt", "xlsx", "exe", ""]
    types = ["", "application/pdf", "image/heif", "text/csv", "application/x-dosexec"]
    mime = F.try_element_at(F.array(*[F.lit(t) for t in types]), (F.floor(F.col("page_id") / 8) % 5 + 1).cast("int"))
    f = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".x."), F.try_element_at(F.array(*[F.lit(e) for e in exts]), (F.col("page_id") % 8 + 1).cast("int"))).alias("name"), mime.alias("mime"), (F.length("html").cast("long") * F.when(F.col("page_id") % 10 == 0, 100000).otherwise(1)).alias("bytes"))
    return U.classify(f)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("input_hash"))


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 3, "no json").otherwise(F.concat(F.lit('{"courses":[{"name":"'), F.col("c_name"), F.lit('","dayOfWeek":'), (k % 9).cast("string"), F.lit(',"periodStart":1},{"name":"b","dayOfWeek":2,"periodStart":'), (k % 2).cast("string"), F.lit("}]}")))
    return U.model_courses(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey").select("c_custkey", "name", "day_of_week", "period_start", "rejected")


_LI = "li as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from lineitem group by all)"
_I = _LI + ", i as (select l_orderkey as page, l_linenumber as seq, l_linenumber * 40 + l_quantity % 7 as x, (l_partkey % 50)::double as y, 't' || l_suppkey as text, l_partkey % 3 = 0 as is_title from li)"
_CELLS = _LI + ", c as (select l_orderkey as image_id, l_linenumber as seq, (l_suppkey % 3)::int as row_index, (l_partkey % 7 + 1)::int as column_index, 'c' || l_partkey as text, (l_suppkey % 7 + 1)::int as day_of_week, (l_partkey % 6 * 2 + 1)::int as period_start, (['cell','examRow','full','courseDetailRow','other'])[l_partkey % 5 + 1] as kind, l_quantity / 64 as confidence from li)"
_COUNT = "k as (select l_suppkey % 10 as image_id, l_partkey % 200 as idx, sum((l_quantity > 25)::int) as n from lineitem group by 1, 2)"
_RUNS = f"{_COUNT}, a as (select *, idx - row_number() over (partition by image_id order by idx) as g from k where n >= 2), r as (select image_id, min(idx) as first, max(idx) as last, count(*) as length from a group by image_id, g)"
_ST = "s as (select c_custkey as id, c_name as title, c_mktsegment as location, c_custkey % 4 = 0 as user_edited from customer)"

QUERIES = {f.__name__: f for f in (nearest_header, attach_details, bucket_fill, join_line, visual_lines, line_islands, longest_run, interval_overlap, top_images, entry_sessions, exam_pivot, header_days, corroborate, catalogue_join, alias_index, chosen_readings, compose_priority, target_text,
                                   split_details, column_counts, store_patch, store_remove, store_toggle, store_append, store_replay, export_selected, no_class_edit, draft_patch, upload_kinds, content_hash, model_output)}
ORACLES = {
    "nearest_header": f"""with {_I}, h as (select o_orderkey as page, k as seq, '周' || k as label, (k * 50 + o_custkey % 30)::double as hx from orders, range(7) t(k))
      select page, seq, header from (select i.page, i.seq, h.label as header, row_number() over (partition by i.page, i.seq order by abs(h.hx - i.x), h.seq) as r from i left join h on h.page = i.page and abs(h.hx - i.x) <= 20) where r = 1""",
    "attach_details": f"""with {_I}, j as (select page % 500 as page, seq, x % 20 as x, y, text || '/' || seq as text, is_title from i), t as (select page, x, y, min(text) as title_id from j where is_title group by all), d as (select page, x, y, text, min(seq) as seq from j where not is_title group by all),
      b as (select d.page, d.seq, d.text, d.y, arg_min(t.title_id, struct_pack(y := t.y, i := t.title_id)) as title_id from d join t on t.page = d.page and abs(t.x - d.x) < 2 and t.y > d.y group by all)
      select page, title_id, string_agg(text, ' ' order by -y, seq, text) as details from b group by all""",
    "bucket_fill": f"with {_I}, j as (select page, seq, x % 24 as x, y, case when is_title then seq end as t from i), k as (select *, cast(floor(x / 8 + 0.5) as bigint) as bucket from j) select page, seq, bucket, last_value(t ignore nulls) over (partition by page, bucket order by x, y, seq rows unbounded preceding) as owner from k",
    "join_line": f"with {_I}, j as (select page, seq, x % 60 as x, text from i), p as (select *, case when x - lag(x) over (partition by page order by x, seq) > 18 then ' ' else '' end || text as piece from j) select page, string_agg(piece, '' order by x, seq) as line from p group by page",
    "visual_lines": f"""with recursive {_I}, o as (select page, seq, y, row_number() over (partition by page order by y desc, seq) as r from i),
      w as (select page, seq, y as anchor, r, 1 as line_no from o where r = 1 union all select o.page, o.seq, case when w.anchor - o.y > 4 then o.y else w.anchor end, o.r, case when w.anchor - o.y > 4 then w.line_no + 1 else w.line_no end from w join o on o.page = w.page and o.r = w.r + 1)
      select page, seq, line_no from w""",
    "line_islands": f"with {_RUNS} select image_id, first, last, length, cast(floor((first + last) / 2.0 + 0.5) as bigint) as centre from r where length >= 2",
    "longest_run": f"with {_RUNS} select image_id, first, last, length from (select *, row_number() over (partition by image_id order by length desc, first) as q from r) where q = 1",
    "interval_overlap": f"""with {_LI}, c as (select l_orderkey % 100 as grid, l_orderkey || '-' || l_linenumber as cell, (l_partkey % 300)::double as y0, l_partkey % 300 + l_quantity as y1 from li), b as (select cast(k as int) as band, (k - 1) * 30.0 as b0, k * 30.0 as b1 from range(1, 13) t(k))
      select grid, cell, min(band) as first_band, max(band) as last_band from c join b on greatest(y0, b0) < least(y1, b1) - 3 group by all""",
    "top_images": """with m as (select l_orderkey % 1000 as doc_id, (l_suppkey % 5 + 1)::int as page, l_orderkey * 10 + l_linenumber as seq, (l_partkey % 900 + 100) * (l_quantity::int * 20) as area from lineitem)
      select doc_id, page, seq, cast(r as int) as rank from (select *, row_number() over (partition by doc_id, page order by area desc, seq) as r from m where page <= 3 and area >= 250000) where r <= 2""",
    "entry_sessions": f"with {_I}, e as (select page as cell, seq, text, cast(sum(is_title::int) over (partition by page order by seq rows unbounded preceding) as bigint) as entry from i) select cell, entry, string_agg(text, ' ' order by seq) as text from e where entry > 0 group by all",
    "exam_pivot": f"with {_CELLS} select image_id, row_index, " + ", ".join(f"arg_max(text, seq) filter (column_index = {k}) as {v}" for k, v in ((2, "time"), (3, "title"), (4, "place"), (5, "seat"), (6, "remark"))) + " from c where column_index between 2 and 6 group by all",
    "header_days": f"with {_CELLS}, h as (select image_id, column_index, arg_max(day_of_week, seq) as header_day from c where row_index = 0 group by all) select c.image_id, c.seq, h.header_day from c left join h using (image_id, column_index)",
    "corroborate": r"""with l as (select l_orderkey % 300 as image_id, 'n' || case when l_linenumber % 2 = 0 then ' ' when l_linenumber % 3 = 0 then '：' else '' end || (l_partkey % 40) as name, case when l_suppkey % 4 > 0 then 't' || (l_suppkey % 3) else '' end as teacher, case when l_suppkey % 5 > 0 then 'p' || (l_suppkey % 2) end as place, l_linenumber, l_orderkey from lineitem),
      k as (select *, regexp_replace(name, '[：:\s]', '', 'g') as key from l),
      m as (select image_id, key, case when count(distinct nullif(teacher, '')) = 1 then min(nullif(teacher, '')) end as t, case when count(distinct place) = 1 then min(place) end as p from k where l_linenumber > 1 group by all)
      select l_orderkey, k.image_id, k.name, coalesce(t, '?') as teacher, coalesce(case when l_orderkey % 3 = 0 then 'own' end, p) as place from k left join m on m.image_id = k.image_id and m.key = k.key where l_linenumber = 1""",
    "catalogue_join": f"""with {_CELLS}, k as (select p_partkey as course_id, p_partkey % 7 + 1 as d, p_partkey % 6 * 2 + 1 as s, 'c.*' || (p_partkey % 10) || '$' as alias from part)
      select image_id, seq, course_id from c join k on d = day_of_week and s = period_start and regexp_matches(text, alias)""",
    "alias_index": f"""with {_LI} select l_orderkey, l_linenumber, p_partkey as course_id from li join part on l_partkey % 42 = p_partkey % 42
      where ('第' || case when l_partkey % 5 > 0 then '课' else '科' end || '程' || l_partkey || case when l_partkey % 7 > 0 then '号' else '' end || '甲' || (l_suppkey % 3)) like '%程' || p_partkey || '号%' || (p_partkey % 3) || '%'""",
    "chosen_readings": rf"""with {_LI}, r as (select l_orderkey as i, l_linenumber as q, (['table','cell','detail','full'])[l_partkey % 4 + 1] as kind, l_suppkey % 2 = 0 as sparse, greatest(0, least(1, (l_quantity * 3 - 10) / 100)) as sure,
        case when l_partkey % 13 > 0 then case when l_partkey % 3 > 0 then '2026年6月2日 13:00' else '' end || case when l_partkey % 4 > 0 then '  经世楼B10' || (l_partkey % 9) else '' end || case when l_suppkey % 3 = 0 then '大学物理 周一 1 - 2 节' else '某课' end || case when l_suppkey % 5 = 0 then '注意事项' else '' end || repeat('字', l_partkey % 11 * 12) else '' end as text from li),
      t as (select *, regexp_replace(text, '\s+', ' ', 'g') as c from r where not (kind = 'cell' and not sparse) and not (kind = 'detail' and sparse)),
      s as (select *, len(regexp_extract_all(c, '(?:20[0-9]{{2}}\s*年)?\s*[0-9]{{1,2}}\s*月\s*[0-9]{{1,2}}\s*日?')) * 8.0::double + len(regexp_extract_all(c, '[0-9]{{1,2}}\s*:\s*[0-9]{{2}}')) * 5 + len(regexp_extract_all(c, '经世楼\s*[A-Za-z]?\s*[0-9]{{0,4}}')) * 7 + len(regexp_extract_all(c, '大学物理')) * 6
        + len(regexp_extract_all(c, '周[一二三四五六日天]|[0-9]{{1,2}}\s*[-~至到]\s*[0-9]{{1,2}}\s*节')) * 4 + least(length(c), 1000) / 120.0::double - case when c like '%注意事项%' then 12 else 0 end + sure + case when sparse then 8 else 0 end + case kind when 'table' then 24 when 'cell' then 18 else 0 end as score from t),
      b as (select *, row_number() over (partition by i order by round(score, 9) desc, q) as n, row_number() over (partition by i, kind, text <> '' order by round(score, 9) desc, q) as d from s)
      select i as image_id, max(text) filter (n = 1) as text, max(sure) filter (n = 1) as confidence, max(text) filter (kind = 'detail' and text <> '' and d = 1) as detail, coalesce(list(text order by q) filter (kind = 'cell' and text <> ''), []) as cells from b group by i""",
    "compose_priority": f"""with {_CELLS}, g as (select image_id, seq, row_index, text, image_id % 5 as m, '周二 3-4节 课' || (image_id % 7) || '甲大纲 1-16周 地点:江安综合楼B202' as line, max(case when seq % 2 = 0 then seq end) over (partition by image_id, row_index) as best from c)
      select image_id, case when m = 0 and bool_or(seq % 2 = 0) then string_agg('数据' || seq, chr(10) order by row_index) filter (seq = best) when m = 0 then string_agg('全文:' || text, chr(10) order by seq) when m = 1 then string_agg('考试 ' || text, chr(10) order by seq)
          when m = 2 then string_agg(line, chr(10) order by seq) when m = 3 and count(*) filter (seq <> 1) >= 3 then string_agg(line, chr(10) order by seq) filter (seq <> 1)
          when m = 3 then coalesce(max('全文:' || text) filter (seq = 1), string_agg(line, chr(10) order by seq) filter (seq <> 1)) else '' end as text from g group by image_id, m""",
    "target_text": f"with {_CELLS} select image_id, string_agg(text, chr(10) order by seq) as text, avg(confidence) as confidence, case when count(*) >= 3 then greatest(0.82::double, avg(confidence)) else avg(confidence) end as final from c where kind = 'cell' group by image_id",
    "split_details": """select o_orderkey, 0 as n, (o_orderkey + 1000000) || ' 课 一 5-6周' as line from orders union all select o_orderkey, 1, (o_orderkey + 2000000) || ' 课二 第7周 12345' from orders union all select o_orderkey, 2, (o_orderkey + 3000000)::varchar from orders where o_orderkey % 2 = 0""",
    "column_counts": f"with {_COUNT} select image_id, idx, cast(n as bigint) as n from k",
    "store_patch": f"""with {_ST} select id, case when id % 5 = 0 and id % 3 in (0, 2) then 'new' else title end as title, case when id % 5 = 0 and id % 3 in (1, 2) then case when id % 2 = 0 then 'there' end else location end as location, user_edited or id % 5 = 0 as user_edited from s""",
    "store_remove": f"with {_ST} select * from s where id % 5 <> 0",
    "store_toggle": "select c_custkey as id from customer where (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)",
    "store_append": f"with {_ST} select *, false as selected from s union all select *, true from s where id % 10 = 0",
    "store_replay": """with l as (select user_id % 40 as s, event_id as q, cast(floor(value) as bigint) % 9 as id, case when event_id % 5 > 0 then 't' || event_id end as title, event_type as place,
        case when event_id % 97 = 0 and event_id < 500 then case when event_id % 2 = 0 then 'set' else 'reset' end when event_id % 89 = 0 then case when event_id % 2 = 0 then 'select_all' else 'clear' end else (['append','append','update','update','toggle','toggle','remove'])[event_id % 7 + 1] end as a from events),
      b as (select s, q, a from l where a in ('set', 'reset', 'select_all', 'clear')),
      i as (select * from l where a in ('set', 'append') and not exists (select 1 from b where b.s = l.s and b.q > l.q and b.a in ('set', 'reset')) and not exists (select 1 from l r where r.s = l.s and r.id = l.id and r.a = 'remove' and r.q > l.q)),
      z as (select i.s, i.q, greatest(max(x.q), coalesce((select max(q) from b where b.s = i.s and b.a in ('select_all', 'clear')), -1)) as since from i join l x on x.s = i.s and x.id = i.id and x.a in ('set', 'append', 'remove') group by i.s, i.q),
      u as (select i.s, i.q, count(*) > 0 as edited, max(x.q) filter (x.q % 3 <> 1) as tq, max(x.q) filter (x.q % 3 <> 0) as pq from i join l x on x.s = i.s and x.id = i.id and x.a = 'update' and x.q > i.q group by i.s, i.q),
      f as (select i.s, i.q, count(x.q) as flips, any_value(coalesce((select a from l y where y.s = z.s and y.q = z.since) = 'clear', false)) as cleared from i join z on z.s = i.s and z.q = i.q left join l x on x.s = i.s and x.id = i.id and x.a = 'toggle' and x.q > z.since group by i.s, i.q)
      select i.s as store_id, i.id, case when tq is not null then case when tq % 5 > 0 then 't' || tq end else title end as title, case when pq is not null then (select place from l y where y.s = i.s and y.q = pq) else place end as place, coalesce(edited, false) as user_edited,
        (not cleared) <> (flips % 2 = 1) as selected, i.q as seq, 0 as pos from i join f on f.s = i.s and f.q = i.q left join u on u.s = i.s and u.q = i.q""",
    "export_selected": f"with {_ST} select * from s where id % 7 = 0",
    "no_class_edit": "select d from (select cast(cast(o_orderdate as date) as varchar) as d from orders union select '2030-01-01') where d not in (select cast(cast(o_orderdate as date) as varchar) from orders where o_orderkey % 50 = 0)",
    "draft_patch": """with d as (select c_custkey as id, case c_custkey % 6 when 0 then 0 when 2 then 4 when 3 then 99999 when 4 then -4 when 5 then c_custkey % 10 end as n from customer)
      select id, cast(least(7, greatest(1, coalesce(n, 1))) as int) as day_of_week, cast(least(14, greatest(1, coalesce(n, 1))) as int) as period_start, cast(least(30, greatest(1, coalesce(n, 1))) as int) as week_start, cast(least(1440, greatest(0, coalesce(n, 30))) as int) as reminder_minutes,
        case when id % 4 = 0 then '7' end as seat_number, case when id % 3 = 0 then 'room' else 'here' end as location from d""",
    "upload_kinds": """with g as (select page_id, page_id || '.x.' || (['pdf','JPG','heic','csv','txt','xlsx','exe',''])[page_id % 8 + 1] as name, (['pdf','jpg','heic','csv','txt','xlsx','exe',''])[page_id % 8 + 1] as ext, (['','application/pdf','image/heif','text/csv','application/x-dosexec'])[page_id // 8 % 5 + 1] as m, length(html)::bigint * case when page_id % 10 = 0 then 100000 else 1 end as bytes from pages),
      f as (select page_id, name, bytes, ext, case when m <> '' then m else case ext when 'pdf' then 'application/pdf' when 'jpg' then 'image/jpeg' when 'csv' then 'text/csv' when 'txt' then 'text/plain' when 'xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' else '' end end as mime from g)
      select *, case when ext = 'heic' or mime = 'image/heif' then 'UNSUPPORTED_HEIC' when ext in ('exe', '', 'heic') and mime not in ('application/pdf', 'text/csv') then 'INVALID_FILE' when bytes > 26214400 then 'FILE_TOO_LARGE' end as rejected,
        case when mime = 'application/pdf' or ext = 'pdf' then 'PDF' when starts_with(mime, 'image/') or ext = 'heic' then 'IMAGE' when ext in ('csv', 'xlsx') then 'EXCEL' when ext = 'txt' then 'TEXT' when mime = 'text/csv' then 'EXCEL' else 'TEXT' end as source from f""",
    "content_hash": "select doc_id, sha256(text) as input_hash from documents",
    "model_output": """select c_custkey, c_name as name, cast(c_custkey % 9 as int) as day_of_week, 1 as period_start, case when c_custkey % 9 not between 1 and 7 then c_name || ': 缺少星期信息' end as rejected from customer where c_custkey % 4 <> 3
      union all select c_custkey, 'b', 2, cast(c_custkey % 2 as int), case when c_custkey % 2 = 0 then 'b: 缺少节次信息' end from customer where c_custkey % 4 <> 3""",
}
