"""Tables drawn with rules: from lines and words on a page to cells.

A page has one grid, from the top down (y grows downwards). Rules are lines or thin boxes (page, x0, y0, x1, y1); words have a place (page, seq, text, x, y), the
middle of the word. Rules are worked on by windows of their page; words meet two arrays of their page, so no word is compared with a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: rules nearer than this are one, pieces of a rule with smaller gaps are one, words with smaller steps in y are one line
SNAP, JOIN, LINE = 3.0, 3.0, 3.0


def snapped(places: DataFrame, keys: list[str], gap: float = SNAP) -> DataFrame:
    """``places`` with ``session``, their edge counted from 0, and ``own``, the place ``at`` on the first of its rows; a step of more than ``gap`` to the next place ends a session."""
    by = Window.partitionBy(*keys).orderBy("at")
    stepped = places.where("at is not null").withColumn("step", F.col("at") - F.lag("at").over(by))
    numbered = stepped.withColumn("session", F.sum(F.when(F.col("step") > gap, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("own", F.when(F.col("step").isNull() | (F.col("step") > 0), F.col("at"))).drop("step")


def joined_pieces(pieces: DataFrame, keys: list[str], gap: float = JOIN) -> DataFrame:
    """(keys, x0, x1, places, n): pieces [x0, x1] that overlap or lie within ``gap`` of each other are one; sum and number of their ``own`` places."""
    by = Window.partitionBy(*keys).orderBy("x0", "x1")
    before = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("new", F.coalesce((F.col("x0") - before > gap).cast("int"), F.lit(0)))
    numbered = opened.withColumn("piece", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "piece").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("own").alias("places"), F.count("own").alias("n")).drop("piece")


def column_bounds(rules: DataFrame, keys: list[str], snap: float = SNAP) -> tuple[DataFrame, DataFrame]:
    """The grid of each page: (keys, xs), the edges of its columns, and (keys, column_index, bounds), what parts a column: structs of y and row.

    A rule that does not cross a column does not part it, so a cell that spans rows is one cell, in the first of its rows. Rows are counted over all
    edges of the page, from 0. All steps are windows and groupings of a page, so rules are shuffled once, by page, or not at all where they are dealt so.
    """
    box = rules.select(*keys, F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"))
    upright, level = box.where(f"x1 - x0 < {snap} and y1 - y0 >= {snap}"), box.where(f"y1 - y0 < {snap} and x1 - x0 >= {snap}")
    edges = snapped(upright.select(*keys, ((F.col("x0") + F.col("x1")) / 2).alias("at")), keys, snap).groupBy(*keys, "session").agg(F.avg("own").alias("edge"))
    columns = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("edge")).alias("xs")).where("size(xs) > 1")
    whole = joined_pieces(snapped(level.select(*keys, "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("at")), keys, snap), [*keys, "session"])
    rule = Window.partitionBy(*keys, "session")
    whole = whole.select(*keys, "x0", "x1", F.struct((F.sum("places").over(rule) / F.sum("n").over(rule)).alias("y"), F.col("session").cast("int").alias("row")).alias("bound"))
    crossed = F.expr(f"filter(sequence(0, size(xs) - 2), j -> x0 <= get(xs, j) + {snap} and x1 >= get(xs, j + 1) - {snap})")
    parted = whole.join(columns.hint("merge"), keys).select(*keys, "bound", F.explode(crossed).alias("column_index"))
    return columns, parted.groupBy(*keys, "column_index").agg(F.array_sort(F.collect_set("bound")).alias("bounds"))


def ruled_cells(rules: DataFrame, words: DataFrame, keys: list[str], snap: float = SNAP, line: float = LINE) -> DataFrame:
    """(keys, row_index, column_index, text) of the cells that hold words, as ``pages.table_lines`` takes them.

    A word lies in the column whose edges enclose its x and, there, between the nearest rules above and below; words outside the grid are left out. Words of
    a cell are in lines, parted where the step in y exceeds ``line``, from left to right. Pages with fewer than two upright rules have no cells.
    """
    columns, bounds = column_bounds(rules, keys, snap)
    held = words.where("text is not null and x is not null and y is not null").join(columns.hint("merge"), keys).withColumn("column_index", F.expr("size(filter(xs, e -> e <= x)) - 1")).where("column_index between 0 and size(xs) - 2").drop("xs")
    held = held.join(bounds.hint("merge"), [*keys, "column_index"]).withColumn("above", F.expr("size(filter(bounds, b -> b.y <= y)) - 1")).where("above between 0 and size(bounds) - 2").withColumn("row_index", F.expr("get(bounds, above).row"))
    cell = [*keys, "row_index", "column_index"]
    by = Window.partitionBy(*cell).orderBy("y", "x", "seq")
    lined = held.select(*cell, "seq", "text", "x", "y").withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(by) > line).cast("int"), F.lit(0))).withColumn("line", F.sum("new").over(by))
    lines = lined.groupBy(*cell, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda w: w["text"]), " ").alias("text"))
    return lines.groupBy(*cell).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
