"""From the recognised cells of an image to its text.

Cells have ``image_id, seq, kind, row_index, column_index, day_of_week, period_start, period_end, text``; ``seq`` is their order.
Kinds: full, cell, examRow, examCell, weekdayHeader, courseDetailRow. All steps are projections of cells or group by image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import cells as X
from chronofold.functions.names import split_names_column
from chronofold.functions.text import compact_cell, compact_exam_row, found, let, trim
from chronofold.operators.events import once, spread
from chronofold.operators.geometry import islands, longest_run
from chronofold.operators.ocr import pattern_matches
from chronofold.operators.raster import at_places, few, region_sums, widest_rows
from chronofold.sources.tables import kept

FIELDS = ["name", "teacher", "place", "day_of_week", "period_start", "period_end", "weeks"]


def with_days(cells: DataFrame, image: str = "image_id") -> DataFrame:
    """Cells with ``day``: their own weekday, else that of their column's header; of several headers of a column the last counts."""
    headers = cells.where("kind = 'weekdayHeader' and column_index is not null").select(image, "column_index", "seq", X.day_in_header(F.coalesce("text", F.lit(""))).alias("d")).where("d is not null")
    headers = headers.groupBy(image, "column_index").agg(F.max_by("d", "seq").alias("header_day"))
    return cells.join(headers, [image, "column_index"], "left").withColumn("day", F.coalesce("day_of_week", "header_day")).drop("header_day")


def main_courses(cells: DataFrame, image: str = "image_id") -> DataFrame:
    """The courses of timetable cells: image, seq and FIELDS."""
    rows = once(spread(with_days(cells.where("kind in ('cell', 'weekdayHeader')"), image).where("kind = 'cell'").select(image, "seq", "day", "text"), image, "seq"), c=X.timetable_cell(F.col("text"), F.col("day"))).where("c is not null")
    rows = rows.select(image, "seq", "c.*").withColumn("teacher", X.filled(split_names_column(F.col("teacher_text"))))
    return rows.select(image, "seq", *FIELDS)


def detail_courses(cells: DataFrame, image: str = "image_id") -> DataFrame:
    rows = once(cells.where("kind = 'courseDetailRow'").select(image, "seq", "text"), c=X.detail_row(F.col("text"))).where("c is not null")
    return rows.select(image, "seq", "c.*").select(image, "seq", *FIELDS)


def corroborated(details: DataFrame, main: DataFrame, image: str = "image_id") -> DataFrame:
    """Details with what the main cells of the same name agree on: their one teacher, and their one place where the detail has none.

    Names are compared without colons and spaces; empty values do not count.
    """
    key = F.regexp_replace(F.col("name"), f"[：:]|{X.WS}", "").alias("__key")
    only = lambda c: F.when(F.count_distinct(X.filled(F.col(c))) == 1, F.min(X.filled(F.col(c))))
    known = main.select(image, key, "teacher", "place").groupBy(image, "__key").agg(only("teacher").alias("__teacher"), only("place").alias("__place"))
    out = details.select("*", key).join(known, [image, "__key"], "left")
    return out.withColumn("teacher", F.coalesce("__teacher", "teacher")).withColumn("place", F.coalesce(X.filled(F.col("place")), "__place")).drop("__key", "__teacher", "__place")


def _joined(kind: Column, order: Column, text: Column) -> Column:
    """The texts of a kind in order, without empty ones, a line each."""
    rows = F.array_sort(F.collect_list(F.when(kind & (text != ""), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "\n")


def course_lines(cells: DataFrame, rules: list[tuple[str, str]] = X.NO_RULES, image: str = "image_id") -> DataFrame:
    """(image, part, seq, line): lines of the main cells (part 0), of detail rows (1), and for images without either of other cells with a slot (2)."""
    main = kept(main_courses(cells, image))
    lines = main.withColumn("part", F.lit(0)).unionByName(corroborated(detail_courses(cells, image), main, image).withColumn("part", F.lit(1)))
    lines = lines.select(image, "part", "seq", X.structured_line(*[F.col(c) for c in ("day_of_week", "period_start", "period_end", "name", "teacher", "place", "weeks")]).alias("line"))
    slot = [F.col(c) for c in ("day_of_week", "period_start", "period_end")]
    other = once(cells.where("kind = 'cell' and day_of_week is not null"), clean=X.clean_cell(F.col("text"), rules)).where(X.keeps_cell(F.col("clean"), F.col("kind"), *slot))
    other = other.select(image, F.lit(2).alias("part"), "seq", F.concat_ws(" ", X.slot_text(*slot), F.col("clean")).alias("line"))
    every = lines.unionByName(other)
    return every.withColumn("least", F.min("part").over(Window.partitionBy(image))).where("part < 2 or least = 2").drop("least")


def exam_lines(cells: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, row_index, line): exams pivoted from their cells, columns 2 to 6: time, title, place, seat, remark; the last of repeated cells counts.

    The row's whole text is the exam row of the same index, else the one of the same rank.
    """
    text = F.col("text")
    some = cells.where(text.isNotNull() & (trim(text) != ""))
    names = {2: "time", 3: "title", 4: "place", 5: "seat", 6: "remark"}
    picked = [F.max_by(F.when(F.col("column_index") == k, text), F.when(F.col("column_index") == k, F.col("seq"))).alias(v) for k, v in names.items()]
    rows = some.where("kind = 'examCell' and row_index is not null").groupBy(image, "row_index").agg(*picked)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy("row_index")))
    whole = some.where("kind = 'examRow'").select(image, "seq", F.col("row_index").alias("row"), compact_exam_row(text).alias("whole"))
    by_index = whole.where("row is not null").groupBy(image, "row").agg(F.max_by("whole", "seq").alias("of_index"))
    by_rank = whole.select(image, F.row_number().over(Window.partitionBy(image).orderBy("seq")).alias("rank"), F.col("whole").alias("of_rank"))
    full = once(some.where("kind = 'full'").select(image, "seq", "text"), t=compact_cell(text)).groupBy(image).agg(_joined(F.lit(True), F.col("seq"), F.col("t")).alias("full_text"))
    rows = rows.join(by_index.withColumnRenamed("row", "row_index"), [image, "row_index"], "left").join(by_rank, [image, "rank"], "left").join(full, image, "left")
    line = X.exam_line(*[F.col(c) for c in names.values()], F.coalesce("of_index", "of_rank"), F.col("full_text"))
    return once(spread(rows, image), line=line).select(image, "row_index", "line")


def image_texts(cells: DataFrame, rules: list[tuple[str, str]] = X.NO_RULES, image: str = "image_id") -> DataFrame:
    """(image, text): exam cells, else exam rows, else three course lines or more, else the full text, else any course lines; empty without any."""
    text = F.coalesce("text", F.lit(""))
    made = once(cells.select(image, "seq", "kind", "text"), t=F.when(F.col("kind") == "examRow", compact_exam_row(text)).when(F.col("kind") == "full", compact_cell(text)))
    own = made.groupBy(image).agg(*[_joined(F.col("kind") == kind, F.col("seq"), F.col("t")).alias(name) for kind, name in (("examRow", "rows"), ("full", "full_text"))])
    exams = exam_lines(cells, image).groupBy(image).agg(_joined(F.lit(True), F.col("row_index"), F.col("line")).alias("exams"))
    lines = course_lines(cells, rules, image).groupBy(image).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    every = own.join(exams, image, "left").join(lines, image, "left")
    return every.select(image, F.coalesce(X.filled(F.col("exams")), X.filled(F.col("rows")), F.when(F.col("n") >= 3, F.col("lines")), X.filled(F.col("full_text")), F.col("lines"), F.lit("")).alias("text"))


def browser_lines(cells: DataFrame, catalogue: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """(image, seq, line) of cells with a slot and a useful text: a line for every catalogue course of the slot whose alias occurs in the text, else the text itself.

    catalogue: course_no (their order), day_of_week, period_start, period_end, aliases (patterns), title, teacher, place, weeks.
    """
    slot = ["day_of_week", "period_start", "period_end"]
    c = once(cells.where(" and ".join(f"{s} <> 0" for s in slot)), clean=X.browser_text(F.coalesce("text", F.lit("")))).where(X.useful_cell(F.col("clean")))
    head = X.slot_text(*[F.col(s) for s in slot])
    own = F.concat_ws(" ", head, X.fallback_cell(F.col("clean")))
    if catalogue is None:
        return c.select(image, "seq", F.lit(0).alias("course_no"), own.alias("line"))
    known = F.concat_ws(" ", X.filled(F.col("title")), F.concat(X.filled(F.col("teacher")), F.lit("老师")), X.filled(F.col("place")), X.filled(F.col("weeks")))
    alias = catalogue.select(*slot, "course_no", F.explode("aliases").alias("alias"), known.alias("known"))
    c = c.withColumn("compact", X.bare(F.col("clean")))
    met = pattern_matches(c, alias, slot, "compact", "alias").join(alias, [*slot, "alias"]).groupBy(image, "seq", "course_no").agg(F.min("known").alias("known"))
    return c.join(met, [image, "seq"], "left").select(image, "seq", F.coalesce("course_no", F.lit(0)).alias("course_no"), F.when(F.col("known").isNotNull(), F.concat_ws(" ", head, F.col("known"))).otherwise(own).alias("line"))


def detail_lines(text: Column) -> Column:
    """The lines of repeated detail rows in one recognised text; rows without weeks, weekday and periods, or without a name, are left out."""
    schedule = rf"((?:第)?{X.WS}*[0-9]{{1,2}}(?:{X.WS}*[-~至到]{X.WS}*[0-9]{{1,2}})?{X.WS}*周(?:{X.WS}*[单双]周)?)>>星期({X.DAY})>>([0-9]{{1,2}}){X.WS}*[-~至到]{X.WS}*([0-9]{{1,2}})节"
    flat = F.regexp_replace(X.browser_text(F.coalesce(text, F.lit(""))), rf"{X.WS}*>>{X.WS}*", ">>")
    pieces = F.split(F.regexp_replace(flat, rf"(?<![0-9])([0-9]{{6,12}}{X.WS})", "\u0001$1"), "\u0001")

    def line(row: Column) -> Column:
        # the schedule is searched once; what was found is taken apart
        return let(found(row, schedule, 0), lambda m: F.when(m.isNotNull(), let(F.struct(*[F.regexp_extract(m, schedule, g).alias(f"g{g}") for g in (1, 2, 3, 4)], name_of(row).alias("name")), lambda x: written(row, x))))

    def name_of(row: Column) -> Column:
        prefix = F.regexp_replace(row, rf"\A[0-9]{{6,12}}{X.WS}*", "")
        return trim(F.regexp_replace(F.split(prefix, "(?:日历|大纲)", 2)[0], rf"\A(?:[:：|]|{X.WS})+|(?:[:：|]|{X.WS})+\z", ""))

    def written(row: Column, x: Column) -> Column:
        after = F.try_element_at(F.split(row, schedule, 2), F.lit(2))
        place = found(after, rf"{X.WS}+([^\n]+?)(?={X.WS}+[0-9]{{6,12}}(?![0-9A-Za-z_])|\z)")
        place = F.regexp_replace(X.bare(F.regexp_replace(F.split(place, "(?:课程号|课序号|课程名|实习安排)", 2)[0], ">>", "")), r"[+|]+\z", "")
        return F.when((x["name"] != "") & ~x["name"].rlike(r"\A(?:课程号|课序号|课程名)\z"), F.concat_ws(" ", F.concat(F.lit("周"), x["g2"]), F.concat(x["g3"], F.lit("-"), x["g4"], F.lit("节")), x["name"], X.filled(place), X.bare(x["g1"])))

    return let(pieces, lambda p: F.filter(F.transform(F.slice(p, F.lit(2), F.size(p)), line), lambda x: x.isNotNull()))


# fixed values: the least shares and counts by which a timetable's grid is found, and the weekdays of its columns
COLUMN_SHARE, RUN_SHARE, ROW_SHARE, LINE_SHARE = 0.25, 0.15, 0.65, 0.72
LINES, PERIODS, LEAST_HEIGHT, LEAST_CELL, LEAST_CONTENT, LEAST_CELLS = 10, 12, 144, 18, 80, 3
COLUMN_DAYS = [7, 1, 2, 3, 4, 5, 6]


def detected_grids(pixels: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, x_lines, top, header_bottom, bottom) of images with a timetable.

    The first ten long vertical lines bound two columns of period names and seven of weekdays; the longest run of rows that cross at least eight
    of them is the table; its first two long horizontal lines bound the head. pixels: image, x, y, dark (1 or 0); sizes: image, height.
    """
    dark = pixels.where("dark > 0").select(image, "x", "y").distinct()
    columns = dark.groupBy(image, F.col("x").alias("idx")).agg(F.count("*").alias("n"))
    lines = islands(few(columns, sizes.select(image, "height"), image), image, F.col("height") * COLUMN_SHARE).groupBy(image).agg(F.array_sort(F.collect_list("centre")).alias("all")).where(F.size("all") >= LINES)
    lines = kept(lines.select(image, F.slice("all", 1, LINES).alias("x_lines")))
    near = lines.select(image, F.posexplode("x_lines").alias("n", "at")).select(image, "n", F.explode(F.expr("sequence(at - 1, at + 1)")).alias("x"))
    crossed = at_places(dark, near, "x", ["n"], image).groupBy(image, F.col("y").alias("idx")).agg(F.count_distinct("n").alias("n"))
    run = few(longest_run(crossed, image, max(7, LINES - 2)), sizes.select(image, "height"), image).where(F.col("last") - F.col("first") >= F.col("height") * RUN_SHARE)
    table = kept(few(run, lines, image).select(image, "x_lines", "first", "last", F.element_at("x_lines", 1).alias("x0"), F.element_at("x_lines", LINES).alias("x1")))
    rows = few(dark, table, image).where("x between x0 and x1 and y between first and last").groupBy(image, F.col("y").alias("idx"), "x0", "x1").agg(F.count("*").alias("n"))
    ruled = islands(rows, image, (F.col("x1") - F.col("x0")) * ROW_SHARE).groupBy(image).agg(F.array_sort(F.collect_list("centre")).alias("ys")).where("size(ys) >= 2")
    out = few(table, ruled, image).select(image, "x_lines", F.element_at("ys", 1).alias("top"), F.element_at("ys", 2).alias("header_bottom"), F.col("last").alias("bottom"))
    return out.where(F.col("bottom") - F.col("header_bottom") >= LEAST_HEIGHT)


def timetable_slots(pixels: DataFrame, grids: DataFrame, tolerance: float = 3.0, image: str = "image_id") -> DataFrame:
    """(image, day_of_week, y0, y1, period_start, period_end): the cells of a grid that hold something.

    Below the head lie twelve equal periods. A border between two of them cuts a weekday's column where a line crosses most of it; the cells between cuts
    take the periods that they overlap by more than ``tolerance``. An image with fewer than three cells has none.
    """
    bound = lambda i: F.floor(F.col("header_bottom") + (F.col("bottom") - F.col("header_bottom")) * i / PERIODS + 0.5)
    grid = grids.withColumn("bounds", F.array(*[bound(i) for i in range(PERIODS + 1)]))
    days = F.array(*[F.struct(F.lit(d).alias("day_of_week"), (F.element_at("x_lines", k + 3) + 2).alias("x0"), (F.element_at("x_lines", k + 4) - 2).alias("x1")) for k, d in enumerate(COLUMN_DAYS)])
    columns = grid.select(image, "bounds", F.explode(days).alias("d")).select(image, "bounds", "d.*").where("x1 > x0")
    borders = columns.select(image, "day_of_week", "x0", "x1", F.posexplode("bounds").alias("n", "at"))
    crossed = widest_rows(pixels, borders.select(image, "day_of_week", "n", "x0", "x1", (F.col("at") - 2).alias("y0"), (F.col("at") + 3).alias("y1")), ["day_of_week", "n"], image)
    cuts = few(borders, crossed, [image, "day_of_week", "n"], "left").where((F.coalesce("widest", F.lit(0)) >= (F.col("x1") - F.col("x0")) * LINE_SHARE) | F.col("n").isin(0, PERIODS))
    cuts = cuts.select(image, "day_of_week", "x0", "x1", "at").distinct()
    cells = cuts.withColumn("y1", F.lead("at").over(Window.partitionBy(image, "day_of_week").orderBy("at"))).withColumnRenamed("at", "y0").where(F.col("y1") - F.col("y0") >= LEAST_CELL)
    cells = kept(cells)
    held = region_sums(pixels, cells.select(image, "day_of_week", F.col("y0").alias("top"), (F.col("x0") + 3).alias("x0"), (F.col("x1") - 3).alias("x1"), (F.col("y0") + 3).alias("y0"), (F.col("y1") - 3).alias("y1")), ["day_of_week", "top"], image)
    cells = few(few(cells, held.withColumnRenamed("top", "y0"), [image, "day_of_week", "y0"]).where(F.col("dark") >= LEAST_CONTENT), grid.select(image, "bounds"), image)
    over = F.filter(F.transform("bounds", lambda b, i: F.when(F.greatest(F.col("y0"), b) < F.least(F.col("y1"), F.try_element_at("bounds", (i + 2).cast("int"))) - tolerance, i + 1)), lambda x: x.isNotNull())
    cells = cells.withColumn("over", over).where("size(over) > 0").withColumn("n", F.count("*").over(Window.partitionBy(image))).where(F.col("n") >= LEAST_CELLS)
    return cells.select(image, "day_of_week", "y0", "y1", F.array_min("over").cast("int").alias("period_start"), F.array_max("over").cast("int").alias("period_end"))
