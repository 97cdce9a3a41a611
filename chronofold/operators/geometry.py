"""Relational work over positioned text, table headers, pixels and intervals.

Nearest-neighbour and as-of steps are written so that no join emits all pairs of a page: headers are few per page and
are compared as one array per page; as-of steps are windows or sorted arrays keyed by page and axis. Joins by page are never left to a broadcast: both sides grow with the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nearest_header(items: DataFrame, headers: DataFrame, page: str, limit: float = 80.0) -> DataFrame:
    """Each item's header with the least |dx| up to ``limit``; ties go to the lower ``seq``; null without one. headers: page, seq, label, hx."""
    per_page = headers.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("seq", "label", "hx"))).alias("hs"))
    near = F.array_min(F.transform(F.filter("hs", lambda h: F.abs(h["hx"] - F.col("x")) <= limit), lambda h: F.struct(F.abs(h["hx"] - F.col("x")).alias("dx"), h["seq"].alias("seq"), h["label"].alias("label"))))
    return items.join(per_page.hint("merge"), page, "left").withColumn("header", near["label"]).drop("hs")


def attach_details(titles: DataFrame, details: DataFrame, page: str, tolerance: float = 2.0, order: str = "y") -> DataFrame:
    """(page, title_id, details): each detail goes to the lowest title above it with |dx| < tolerance; texts from top to bottom (order ``y``) or by ``seq``.

    Titles of one x are a column. A place of details asks each column within the tolerance (found by cells of its width) once, and an as-of window from the top
    down gives the column's lowest title above it, however many titles the column has. Details then take the title of their place, so they are not multiplied.
    """
    cell = lambda x: F.floor(x / F.lit(tolerance))
    t = titles.select(page, F.col("x").alias("tx"), "y", "title_id").groupBy(page, "tx", "y").agg(F.min("title_id").alias("title_id"))
    xs = t.select(page, "tx").distinct().withColumn("cell", F.explode(F.array(cell(F.col("tx")) - 1, cell(F.col("tx")), cell(F.col("tx")) + 1)))
    # a place asks each near column of titles (its distinct x) once, and gets that column's lowest title above it
    asked = details.select(page, "x", "y").distinct().withColumn("cell", cell(F.col("x"))).join(xs.hint("merge"), [page, "cell"]).where(F.abs(F.col("tx") - F.col("x")) < tolerance)
    one = t.select(page, "tx", "y", F.lit(1).alias("kind"), F.lit(None).cast(details.schema["x"].dataType).alias("x"), F.struct(F.col("y").alias("ty"), "title_id").alias("t"))
    two = asked.select(page, "tx", "y", F.lit(0).alias("kind"), "x", F.lit(None).cast(one.schema["t"].dataType).alias("t"))
    w = Window.partitionBy(page, "tx").orderBy(F.desc("y"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = one.unionByName(two).withColumn("t", F.last("t", ignorenulls=True).over(w)).where("kind = 0 and t is not null")
    near = met.groupBy(page, "x", "y").agg(F.min("t").alias("t"))
    held = details.select(page, F.col("seq").cast("long").alias("seq"), "text", "x", "y").join(near.hint("merge"), [page, "x", "y"])
    best = held.groupBy(page, "seq", "text", "y").agg(F.min("t").alias("t")).select(page, "seq", "text", "y", "t.title_id")
    return best.groupBy(page, "title_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y") if order == "y" else F.lit(0.0)).alias("ny"), "seq", "text"))), lambda s: s["text"]), " ").alias("details"))


def fill_by_bucket(items: DataFrame, page: str, width: float = 8.0) -> DataFrame:
    """Items with the last title before them in their bucket of the x axis: titles have a ``title_id``, details a null one."""
    bucket = F.floor(F.col("x") / width + 0.5)
    w = Window.partitionBy(page, "bucket").orderBy("x", "y", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("bucket", bucket).withColumn("owner", F.last("title_id", ignorenulls=True).over(w))


def visual_lines(items: DataFrame, page: str, gap: float = 4.0) -> DataFrame:
    """Items with ``line_no``: from the top down, an item joins a line while its y is within ``gap`` of the line's first item. An item without a y has line 0.

    The anchor is the first item's y, which no window expresses. Pages are brought together and sorted, and one pass over a partition's rows carries page, anchor and number of
    the line, so a page of any length takes time in proportion and no memory.
    """
    rows, names = items.repartition(page).sortWithinPartitions(page, F.desc_nulls_last("y")), [*items.columns, "line_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchor, line = object(), 0.0, 0
        for batch in batches:
            out = []
            for key, y in zip(batch.column(page).to_pylist(), batch.column("y").to_pylist()):
                if key != at:
                    at, line = key, 0
                if y is not None and (line == 0 or anchor - y > gap):
                    anchor, line = y, line + 1
                out.append(0 if y is None else line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=names)

    return rows.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("line_no", T.IntegerType())]))


def join_line(items: DataFrame, keys: list[str], space: float = 18.0) -> DataFrame:
    """Texts of a line from left to right, with a space where the step in x is over ``space``."""
    w = Window.partitionBy(*keys).orderBy("x", "seq")
    piece = F.concat(F.when(F.col("x") - F.lag("x").over(w) > space, " ").otherwise(""), F.col("text"))
    return items.withColumn("piece", piece).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "piece"))), lambda s: s["piece"]), "").alias("line"))


def islands(counts: DataFrame, key: str | list[str], threshold: int | Column, least: int = 1, half_up: bool = True) -> DataFrame:
    """Runs of consecutive ``idx`` with ``n`` of at least ``threshold`` (a number or a column): (key, first, last, length, centre)."""
    keys = [key] if isinstance(key, str) else key
    above = counts.where(F.col("n") >= threshold).withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx")))
    runs = above.groupBy(*keys, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least)
    middle = (F.col("first") + F.col("last")) / 2
    return runs.select(*keys, "first", "last", "length", F.floor(middle + (0.5 if half_up else 0)).alias("centre"))


def longest_run(counts: DataFrame, key: str, threshold: int) -> DataFrame:
    """The longest island of each key; the first of equal ones."""
    return islands(counts, key, threshold).groupBy(key).agg(F.max_by(F.struct("first", "last", "length"), F.struct("length", -F.col("first"))).alias("r")).select(key, "r.*")


def overlapped(cells: DataFrame, bands: DataFrame, key: str, tolerance: float = 3.0) -> DataFrame:
    """(key, cell, first_band, last_band): bands whose overlap with a cell's [y0, y1] exceeds the tolerance. Bands are few per key."""
    b = bands.groupBy(key).agg(F.collect_list(F.struct("band", "b0", "b1")).alias("bs"))
    hit = F.transform(F.filter("bs", lambda s: F.greatest(F.col("y0"), s["b0"]) < F.least(F.col("y1"), s["b1"]) - tolerance), lambda s: s["band"])
    return cells.join(b, key).withColumn("hit", hit).where("size(hit) > 0").select(key, "cell", F.array_min("hit").alias("first_band"), F.array_max("hit").alias("last_band"))


def largest_images(images: DataFrame, page_limit: int = 3, per_page: int = 2, least_area: int = 250_000) -> DataFrame:
    """Of the first pages the largest images of each, those with enough area; ties go to the lower ``seq``."""
    area = F.col("width") * F.col("height")
    w = Window.partitionBy("doc_id", "page").orderBy(area.desc(), "seq")
    return images.where((F.col("page") <= page_limit) & (area >= least_area)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_page)


def session_entries(rows: DataFrame, key: str) -> DataFrame:
    """Entries of a cell: a title opens an entry, what follows up to the next title belongs to it. rows: key, seq, is_title, text."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("entry", F.sum(F.col("is_title").cast("int")).over(w)).where("entry > 0")
    return numbered.groupBy(key, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("text"))
