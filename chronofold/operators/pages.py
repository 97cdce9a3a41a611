"""Timetables on pages: from positioned text or table cells to course lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.text import WS, let
from chronofold.operators.adapters import entry_line
from chronofold.operators.calendar import semester_start_of
from chronofold.operators.geometry import attach_details, join_line, nearest_header, visual_lines

# fixed values: headers of the columns, labels that are no details, words without which a page holds no timetable
HEADERS = [f"星期{d}" for d in "一二三四五六日天"]
IGNORED = ["上午", "下午", "晚上", "时间段", "节次"]
GUARD = ["课表", "学期"]


def _by_document(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by document. Both sides grow with the documents and texts are longer than what they are estimated from, so neither is broadcast."""
    return df.join(other.hint("merge"), on, how)


def _first_wins(lines: DataFrame, key: str) -> DataFrame:
    """(key, text, n): distinct lines in the order of their first place."""
    once = lines.where("line is not null").groupBy(key, "line").agg(F.min("at").alias("at"))
    return once.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n"))


def page_schedules(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, n, semester_start) of documents whose positioned text holds a timetable.

    items: key, seq, text, x, y. Titles carry ▲; what stands below a title at its x and is neither a number nor a label is its detail; the nearest header
    names the weekday. Documents without the guard's words or without any line give no row.
    """
    guarded = items.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("whole"))
    for word in GUARD:
        guarded = guarded.where(F.col("whole").contains(word))
    own = _by_document(items, guarded.select(key), key, "left_semi")
    headers = own.where(F.col("text").isin(HEADERS)).select(key, "seq", F.col("text").alias("label"), F.col("x").alias("hx"))
    titles = nearest_header(own.where(F.col("text").contains("▲")), headers, key).where("header is not null")
    details = own.where(~F.col("text").contains("▲") & ~F.col("text").isin(HEADERS + IGNORED) & ~F.col("text").rlike(r"\A[0-9]+\z"))
    # every title takes its details, also those without a header
    owners = own.where(F.col("text").contains("▲")).select(key, F.col("seq").alias("title_id"), "x", "y")
    held = attach_details(owners, details.select(key, "seq", "text", "x", "y"), key, order="seq").withColumnRenamed("title_id", "seq")
    rows = _by_document(titles, held, [key, "seq"], "left").select(key, F.col("seq").alias("at"), entry_line(F.col("text"), F.coalesce("details", F.lit("")), F.col("header")).alias("line"))
    out = _by_document(_first_wins(rows, key), guarded, key)
    return out.select(key, F.concat(F.lit("课程表\n"), F.col("text")).alias("text"), "n", semester_start_of(F.col("whole")).alias("semester_start"))


def page_texts(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, n): the visual lines of a document from the top down, joined by line ends; documents without text give no row."""
    clean = items.withColumn("text", F.replace(F.regexp_replace("text", rf"{WS}+", ""), F.lit("▲"), F.lit(""))).where("text <> ''")
    lines = join_line(visual_lines(clean, key), [key, "line_no"])
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n"))


def _entries(text: Column) -> Column:
    """Structs of entry (from 1), title and details of a cell's text; lines before the first title are left out."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")), lambda x: x != "")

    def cut(ls: Column, at: Column) -> Column:
        after = lambda k: F.coalesce(F.try_element_at(at, (k + 2).cast("int")), F.size(ls) + 1)
        return F.transform(at, lambda p, k: F.struct((k + 1).alias("entry"), F.try_element_at(ls, p).alias("title"), F.array_join(F.slice(ls, p + 1, after(k) - p - 1), "").alias("details")))

    return let(lines, lambda ls: let(F.filter(F.sequence(F.lit(1), F.size(ls) + 1), lambda i: F.try_element_at(ls, i).contains("▲")), lambda at: cut(ls, at)))


def table_lines(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row_index, column_index, entry, line) of tables extracted from pages. cells: key, row_index, column_index, text.

    The first row with a weekday is the head. A cell below it holds entries: a line with ▲ opens one, the lines up to the next are its details. Each row of ``cells`` is a
    cell of its own and is cut where it stands, so its lines are neither sorted nor grouped again.
    """
    heads = cells.withColumn("clean", F.regexp_replace("text", rf"{WS}+", "")).where(F.col("clean").isin(HEADERS[:7]) & F.col("column_index").isNotNull())
    heads = heads.groupBy(key, "row_index", "column_index").agg(F.min("clean").alias("header")).groupBy(key).agg(F.min("row_index").alias("head"), F.collect_list(F.struct("row_index", "column_index", "header")).alias("all"))
    headers = F.map_from_entries(F.transform(F.filter("all", lambda h: h["row_index"] == F.col("head")), lambda h: F.struct(h["column_index"], h["header"])))
    # a cell without ▲ has no entries; both sides meet by document alone, so cells dealt by document are not shuffled
    body = _by_document(cells.select(key, "row_index", "column_index", "text").where(F.col("text").contains("▲")), heads.select(key, "head", headers.alias("headers")), key).where("row_index > head")
    body = body.withColumn("header", F.try_element_at("headers", F.col("column_index"))).where("header is not null")
    entries = body.select(key, "row_index", "column_index", "header", F.explode(_entries(F.col("text"))).alias("e")).select(key, "row_index", "column_index", "header", "e.*")
    line = entry_line(F.col("title"), F.col("details"), F.col("header"))
    return entries.select(key, "row_index", "column_index", F.col("entry").cast("int").alias("entry"), line.alias("line")).where("line is not null")


def document_texts(items: DataFrame, tables: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text, mode, n, confidence) of documents by the first way that gives something: a timetable of positioned text, lines of extracted tables, visual lines.

    Each way is a grouping by document; a later one is computed only for documents that the earlier ones left.
    """
    shape = lambda df, mode, confidence: df.select(key, "text", F.lit(mode).alias("mode"), "n", F.lit(confidence).alias("confidence"))
    out = shape(page_schedules(items, key), "table", 0.95)
    if tables is not None:
        lines = table_lines(_by_document(tables, out.select(key), key, "left_anti"), key).withColumn("at", F.struct("row_index", "column_index", "entry"))
        joined = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n"))
        out = out.unionByName(shape(joined, "table", 0.95))
    return out.unionByName(shape(page_texts(_by_document(items, out.select(key), key, "left_anti"), key), "text", 0.78))
