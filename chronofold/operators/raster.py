"""Images as tables of points: masks from colours, sums over regions, the geometry of timetables and exam tables.

A point is a row (image, x, y, ...); points that are not dark may be left out. Points meet regions by equality only: through an image's cuts
(``region_sums``), its columns or its rows. Whatever is counted is summed by image, row and column before it is shuffled; of points that are partitioned by
image nothing is shuffled. Points are very many more than the rows they are made from, so no join leaves it to estimated sizes which side is broadcast (``few``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.geometry import islands
from chronofold.sources.tables import kept

# fixed values: weights of the colours in a grey value, and the values below which a pixel of a mask, of a line and of a letter is dark
RED, GREEN, BLUE = 0.299, 0.587, 0.114
MASK_GREY, LINE_GREY, INK_GREY = 253, 225, 190
# fixed values: margin of a table's box; shares of width or height that make a line; bounds of a period's height
MARGIN, FULL_SHARE, SOME_SHARE, EXAM_SHARE, EXAM_COLUMN_SHARE, CELL_SHARE, SPLIT_SHARE = 20, 0.9, 0.45, 0.55, 0.45, 0.85, 0.82
LOW, HIGH, PERIODS, DAYS, LINES = 100, 190, 12, 7, 10
# fixed values: least heights, widths and numbers of dark points of cells and rows
CELL_HEIGHT, CELL_INK, PART_WIDTH, PART_INK, PART_EDGE, EXAM_SIZE, EXAM_ROW_INK, EXAM_CELL_INK = 18, 80, 45, 60, 12, 20, 80, 8


def grey(red: Column, green: Column, blue: Column) -> Column:
    return red * RED + green * GREEN + blue * BLUE


def dark_mask(pixels: DataFrame, image: str = "image_id", limit: float = MASK_GREY) -> DataFrame:
    """(image, x, y, dark) from colours: 1 where the grey value lies below ``limit``. A pixel without a colour is not dark."""
    value = grey(F.col("red"), F.col("green"), F.col("blue"))
    return pixels.select(image, "x", "y", F.coalesce((value < limit).cast("int"), F.lit(0)).alias("dark"))


def few(many: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with a side that has few rows for an image: each task holds its part of the side and streams ``many``. Neither is broadcast."""
    return many.join(side.hint("shuffle_hash"), on, how)


def at_places(many: DataFrame, side: DataFrame, place: str, values: list[str], image: str = "image_id") -> DataFrame:
    """``many`` with ``values`` of each row of a side of its image and ``place``, a whole number, found in an array over the places of the image's side.

    Only the image is a key of the join, so that of points partitioned by image nothing is shuffled.
    """
    held = side.groupBy(image, F.col(place).cast("int").alias("__at")).agg(F.collect_list(F.struct(*values)).alias("__v")).groupBy(image).agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__s"))
    dense = F.expr("flatten(transform(__s, (e, i) -> concat(array_repeat(slice(e.__v, 1, 0), if(i = 0, 0, e.__at - get(__s, i - 1).__at - 1)), array(e.__v))))")
    at = few(many, held.select(image, F.expr("get(__s, 0).__at").alias("__low"), dense.alias("__v")), image)
    return at.select(*many.columns, F.explode(F.expr(f"get(__v, cast({place} - __low as int))")).alias("__v")).select(*many.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


# ---------------------------------------------------------------- sums over regions

def _strips(cuts: str) -> Column:
    """For each place from the first cut up to the last the number, from 1, of the strip between two cuts that it lies in."""
    return F.expr(f"flatten(transform(sequence(1, size({cuts}) - 1), i -> array_repeat(cast(i as int), cast(get({cuts}, i) - get({cuts}, i - 1) as int))))")


def _cuts(regions: DataFrame, image: str) -> DataFrame:
    """The sorted edges of each image's regions, ``xs`` and ``ys``, and the strips between them."""
    edges = lambda a, b: F.array_sort(F.array_union(F.collect_set(F.col(a).cast("long")), F.collect_set(F.col(b).cast("long"))))
    return regions.groupBy(image).agg(edges("x0", "x1").alias("xs"), edges("y0", "y1").alias("ys")).select("*", _strips("xs").alias("ix"), _strips("ys").alias("iy"))


def _filled(regions: DataFrame) -> DataFrame:
    return regions.where("x0 < x1 and y0 < y1")


def region_sums(points: DataFrame, regions: DataFrame, keys: list[str], image: str = "image_id") -> DataFrame:
    """(image, keys, dark): dark points of each region, by a summed-area table; regions without any are left out.

    The edges of an image's regions cut it into strips. A point finds its two strips in two arrays of its image, points are summed by pair of strips, and two
    running sums make the table: its value at an edge of columns and one of rows is the number of dark points before both. A region is four look-ups, however
    many regions there are. points: image, x, y, dark; regions: image, keys, x0, x1, y0, y1, ends exclusive, up to some hundreds for an image.
    """
    cuts = _cuts(_filled(regions), image)
    near = few(points.where("dark > 0"), cuts, image).where("x >= get(xs, 0) and x < element_at(xs, -1) and y >= get(ys, 0) and y < element_at(ys, -1)")
    sums = near.select(image, "dark", F.expr("get(ix, cast(x - get(xs, 0) as int))").alias("i"), F.expr("get(iy, cast(y - get(ys, 0) as int))").alias("j")).groupBy(image, "i", "j").agg(F.sum("dark").alias("n"))
    # pairs of strips without points are added within their image
    held = few(cuts, sums.groupBy(image).agg(F.collect_list(F.struct("i", "j", "n")).alias("sums")), image, "left")
    empty = F.expr("flatten(transform(sequence(1, size(ys) - 1), j -> transform(sequence(1, size(xs) - 1), i -> named_struct('i', i, 'j', j, 'n', null))))")
    whole = held.select(image, F.explode(F.concat(F.coalesce("sums", F.slice(empty, 1, 0)), empty)).alias("c")).groupBy(image, "c.i", "c.j").agg(F.coalesce(F.sum("c.n"), F.lit(0)).alias("n"))
    across, down = Window.partitionBy(image, "j").orderBy("i"), Window.partitionBy(image, "i").orderBy("j")
    running = whole.withColumn("s", F.sum("n").over(across)).withColumn("s", F.sum("s").over(down))
    areas = running.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("j", "i", "s"))).alias("t")).select(image, F.col("t.s").alias("area"))
    place = lambda cuts, edge: F.array_position(cuts, F.col(edge).cast("long")) - 1
    at = few(few(_filled(regions), cuts.select(image, "xs", "ys"), image), areas, image).withColumn("nx", F.size("xs") - 1)
    at = at.select("*", place("xs", "x0").alias("i0"), place("xs", "x1").alias("i1"), place("ys", "y0").alias("j0"), place("ys", "y1").alias("j1"))
    look = lambda i, j: F.when((F.col(i) > 0) & (F.col(j) > 0), F.try_element_at("area", ((F.col(j) - 1) * F.col("nx") + F.col(i)).cast("int"))).otherwise(0)
    return at.select(image, *keys, (look("i1", "j1") - look("i0", "j1") - look("i1", "j0") + look("i0", "j0")).alias("dark")).where("dark > 0")


def widest_rows(points: DataFrame, regions: DataFrame, keys: list[str], image: str = "image_id") -> DataFrame:
    """(image, keys, widest): dark points of each region's darkest row; regions without any are left out. Regions are bands of few rows.

    Points are summed by row and strip of columns, and a region asks each of its rows once.
    """
    cuts = _cuts(_filled(regions), image)
    near = few(points.where("dark > 0"), cuts.select(image, "xs", "ix"), image).where("x >= get(xs, 0) and x < element_at(xs, -1)")
    rows = near.select(image, "y", "dark", F.expr("get(ix, cast(x - get(xs, 0) as int))").alias("i")).groupBy(image, "y", "i").agg(F.sum("dark").alias("n"))
    rows = rows.groupBy(image, "y").agg(F.collect_list(F.struct("i", "n")).alias("cells"))
    asked = few(_filled(regions), cuts.select(image, "xs"), image).select(image, *keys, F.expr("array_position(xs, cast(x0 as bigint)) - 1").alias("i0"), F.expr("array_position(xs, cast(x1 as bigint)) - 1").alias("i1"), F.explode(F.expr("sequence(y0, y1 - 1)")).alias("y"))
    held = F.expr("aggregate(filter(cells, c -> c.i > i0 and c.i <= i1), 0L, (a, c) -> a + c.n)")
    return at_places(rows, asked, "y", [*keys, "i0", "i1"], image).groupBy(image, *keys).agg(F.max(held).alias("widest")).where("widest > 0")


# ---------------------------------------------------------------- geometry of scans; points: image, x, y, grey

def table_boxes(points: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, left, top, right, bottom), ends exclusive: the box of all points of lines and letters with a margin; the whole image where there are none. sizes: image, width, height."""
    inked = points.where(F.col("grey") < LINE_GREY).groupBy(image).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    low, high = (lambda c: F.coalesce(F.greatest(F.lit(0), F.col(c) - MARGIN), F.lit(0))), (lambda c, size: F.least(F.col(size), F.coalesce(F.col(c) + MARGIN, F.col(size))))
    return few(sizes, inked, image, "left").select(image, low("x0").alias("left"), low("y0").alias("top"), high("x1", "width").alias("right"), high("y1", "height").alias("bottom"))


def cropped(points: DataFrame, boxes: DataFrame, image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """Points and sizes in the coordinates of the boxes."""
    inside = few(points, boxes, image).where("x >= left and x < right and y >= top and y < bottom")
    return inside.select(image, (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "grey"), boxes.select(image, (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))


def _counted(points: DataFrame, keys: list[str], axis: str, bounds: DataFrame | list[str]) -> DataFrame:
    """(keys, idx, n, ...): the points of each row or column with what thresholds need: a frame by image, where that is the only key, or columns of the points that are the same for the same keys."""
    given = isinstance(bounds, list)
    counts = points.groupBy(*keys, *(bounds if given else []), F.col(axis).alias("idx")).agg(F.count("*").alias("n"))
    return counts if given else few(counts, bounds, keys)


def _centres(counts: DataFrame, keys: list[str], threshold: Column, name: str) -> DataFrame:
    """(keys, ``name``): the sorted centres of runs of rows or columns that hold at least so many points."""
    return islands(counts, keys, threshold, half_up=False).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("centre").cast("int"))).alias(name))


def _lines(points: DataFrame, keys: list[str], axis: str, bounds: DataFrame | list[str], threshold: Column, name: str) -> DataFrame:
    return _centres(_counted(points, keys, axis, bounds), keys, threshold, name)


def main_grids(points: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, header_top, header_bottom, main_bottom, day_lines, bounds) of images with a grid of seven days and twelve periods.

    The head lies between the first two lines across the whole width. The height of a period is the median of the first gaps between lines
    across much of the width below it; twelve of them reach the table's end, which is put on the nearest whole line if that is less than half a period away. The last eight
    of at least ten vertical lines of the table bound the days, so that what divides a cell is no day.
    """
    dark = points.where(F.col("grey") < LINE_GREY).select(image, "x", "y")
    rows = kept(_counted(dark, [image], "y", sizes).where(F.col("n") >= F.col("width") * SOME_SHARE).select(image, "idx", "n", "width"))  # few, and those across the whole width are among them
    full = _centres(rows, [image], F.col("width") * FULL_SHARE, "whole").where("size(whole) >= 2")
    some = _centres(rows, [image], F.col("width") * SOME_SHARE, "some")
    gaps = few(some, full, image).select(image, "whole", F.expr("slice(filter(some, l -> l > get(whole, 1)), 1, 7)").alias("c")).where("size(c) > 1")
    gaps = gaps.select(image, "whole", F.expr(f"array_sort(filter(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> b - a), g -> g between {LOW} and {HIGH}))").alias("g")).where("size(g) > 0")
    tall = gaps.select(image, "whole", F.expr("cast(bround((get(g, cast((size(g) - 1) div 2 as int)) + get(g, cast(size(g) div 2 as int))) / 2, 0) as int)").alias("tall"))
    ends = tall.select(image, "tall", F.expr("get(whole, 0)").alias("header_top"), F.expr("get(whole, 1)").alias("header_bottom"), F.expr(f"array_min(transform(whole, l -> struct(abs(l - get(whole, 1) - {PERIODS} * tall) as off, l as at)))").alias("end"))
    ends = kept(ends.where("end.off <= tall div 2").select(image, "tall", "header_top", "header_bottom", F.col("end.at").alias("main_bottom")))  # few, and used three times
    main = few(dark, ends, image).where("y between header_top and main_bottom").select(image, "x", "y")
    lines = _lines(main, [image], "x", ends, (F.col("main_bottom") - F.col("header_top") + 1) * FULL_SHARE, "all").where(F.size("all") >= LINES)
    bounds = F.expr(f"concat(transform(sequence(0, {PERIODS} - 1), i -> header_bottom + tall * i), array(main_bottom))")
    return few(ends, lines, image).select(image, "header_top", "header_bottom", "main_bottom", F.slice("all", -DAYS - 1, DAYS + 1).alias("day_lines"), bounds.alias("bounds"))


TARGET = ["kind", "row_index", "column_index", "part", "period_start", "period_end", "x0", "y0", "x1", "y1"]


def _targets(df: DataFrame, image: str, kind: str, **given: Column) -> DataFrame:
    return df.select(image, F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast("int").alias(c) for c in TARGET[1:]])


def _padded(x: int, y: int) -> dict[str, Column]:
    """The box of a target with a margin, within the image."""
    zero = F.lit(0)
    return {"x0": F.greatest(zero, F.col("x0") - x), "x1": F.least(F.col("width"), F.col("x1") + x), "y0": F.greatest(zero, F.col("y0") - y), "y1": F.least(F.col("height"), F.col("y1") + y)}


def _ink(points: DataFrame, regions: DataFrame, keys: list[str], least: int, image: str, margin_x: int = 3) -> DataFrame:
    """The regions, which are used several times (hand in ``kept`` ones), whose inner part, 3 points off its edges, holds at least so many dark points."""
    inner = regions.select(image, *keys, (F.col("x0") + margin_x).alias("x0"), (F.col("x1") - margin_x).alias("x1"), (F.col("y0") + 3).alias("y0"), (F.col("y1") - 3).alias("y1"))
    dark = points.where(F.col("grey") < INK_GREY).select(image, "x", "y", F.lit(1).alias("dark"))
    return few(regions, region_sums(dark, inner, keys, image).where(F.col("dark") >= least).select(image, *keys), [image, *keys])


def _in_cells(of_day: DataFrame, cells: DataFrame, image: str) -> DataFrame:
    """Points of days with ``row`` and ``tall`` of the cells of their day that they lie in; one on the edge of two cells is in both. Cells of a day share edges at most.

    Edges cut a day's height into strips. A point finds its strip in an array of its image and day, and a strip has the cell that begins with it and the one that ends there.
    """
    edges = cells.groupBy(image, "day").agg(F.array_sort(F.array_union(F.collect_set("y0"), F.collect_set("y1"))).alias("ys"), F.collect_list(F.struct("y0", "y1")).alias("spans"))
    # of each edge the cell that begins and the height of the cell that ends there
    edges = edges.select(image, "day", "ys", _strips("ys").alias("iy"), F.expr("transform(ys, e -> get(filter(spans, s -> s.y0 = e), 0))").alias("begin"), F.expr("transform(ys, e -> get(filter(spans, s -> s.y1 = e), 0))").alias("end"))
    days = edges.groupBy(image).agg(F.collect_list(F.struct("day", "ys", "iy", "begin", "end")).alias("held"))
    days = days.select(image, F.expr(f"transform(sequence(1, {DAYS}), d -> get(filter(held, h -> h.day = d), 0))").alias("held"))
    met = few(of_day, days, image).withColumn("h", F.expr("get(held, day - 1)"))
    strip = F.expr("if(y = element_at(h.ys, -1), size(h.ys), get(h.iy, cast(y - get(h.ys, 0) as int)))")
    met = met.withColumn("strip", strip).where("strip is not null")
    both = F.expr("array(get(h.begin, strip - 1), if(y = get(h.ys, strip - 1), get(h.end, strip - 1), null))")
    return met.select(*of_day.columns, F.explode(both).alias("cell")).where("cell is not null").select(*of_day.columns, F.col("cell.y0").alias("row"), (F.col("cell.y1") - F.col("cell.y0") + 1).alias("tall"))


def main_targets(points: DataFrame, sizes: DataFrame, grids: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, kind, row_index, column_index, part, period_start, period_end, x0, y0, x1, y1): what is to be recognised of images with a grid.

    ``weekdayHeader`` for each day; ``cell`` for each part of a cell with enough ink: lines across most of a day's column cut it into cells, which take the periods that they
    overlap by more than 3 points, and vertical lines through most of a cell cut it into parts; ``courseDetailRow`` for the five rows of the table below, where there are seven lines.
    """
    days = grids.select(image, "header_top", "header_bottom", "main_bottom", "bounds", F.explode(F.expr(f"transform(sequence(1, {DAYS}), d -> struct(d as day, get(day_lines, d - 1) as a, get(day_lines, d) as b))")).alias("d")).select(image, "header_top", "header_bottom", "main_bottom", "bounds", "d.*")
    heads = _targets(days, image, "weekdayHeader", column_index=F.col("day"), x0=F.col("a") + 3, x1=F.col("b") - 3, y0=F.col("header_top") + 3, y1=F.col("header_bottom") - 3)
    columns = days.select(image, "day", "bounds", (F.col("a") + 2).alias("x0"), (F.col("b") - 2).alias("x1")).where("x1 > x0")

    # lines of a day's column: a point finds its day in an array over the places from the first line of days to the last
    dark = points.where(F.col("grey") < LINE_GREY).select(image, "x", "y")
    day_at = F.expr(f"flatten(transform(sequence(1, {DAYS}), d -> if(get(day_lines, d) - get(day_lines, d - 1) > 4, concat(array_repeat(0, 2), array_repeat(d, cast(get(day_lines, d) - get(day_lines, d - 1) - 3 as int)), array(0)), array_repeat(0, cast(get(day_lines, d) - get(day_lines, d - 1) as int)))))")
    own = grids.select(image, "header_bottom", "main_bottom", "day_lines", day_at.alias("day_at"))
    of_day = few(dark, own, image).where("y between header_bottom and main_bottom").withColumn("day", F.expr("get(day_at, cast(x - get(day_lines, 0) as int))")).where("day > 0")
    of_day = of_day.select(image, "x", "y", "day", F.expr("get(day_lines, day - 1) + 2").alias("x0"), F.expr("get(day_lines, day) - 2").alias("x1"))
    ruled = _lines(of_day.where("x < x1").withColumn("w", F.col("x1") - F.col("x0")), [image, "day"], "y", ["w"], F.col("w") * CELL_SHARE, "ys")
    cuts = few(columns, ruled, [image, "day"], "left").withColumn("ys", F.array_sort(F.array_distinct(F.concat(F.coalesce("ys", F.array().cast("array<int>")), F.array(F.element_at("bounds", 1), F.element_at("bounds", -1))))))
    cells = cuts.select(image, "day", "bounds", "x0", "x1", F.explode(F.expr("zip_with(slice(ys, 1, size(ys) - 1), slice(ys, 2, size(ys) - 1), (a, b) -> struct(a as y0, b as y1))")).alias("c")).select(image, "day", "bounds", "x0", "x1", "c.*").where(F.col("y1") - F.col("y0") >= CELL_HEIGHT)
    cells = kept(cells.withColumn("row", F.col("y0")))
    over = F.expr(f"filter(sequence(1, {PERIODS}), p -> greatest(y0, get(bounds, p - 1)) < least(y1, get(bounds, p)) - 3)")
    cells = kept(_ink(points, cells, ["day", "row"], CELL_INK, image).withColumn("over", over).where("size(over) > 0"))  # few, and used five times below

    # vertical lines within a cell
    within = _in_cells(of_day, cells, image).select(image, "day", "row", (F.col("x") - F.col("x0")).alias("x"), "tall")
    split = _lines(within, [image, "day", "row"], "x", ["tall"], F.col("tall") * SPLIT_SHARE, "xs")
    wide = F.col("x1") - F.col("x0")
    parts = few(cells, split, [image, "day", "row"], "left").withColumn("w", wide).withColumn("xs", F.concat(F.array(F.lit(0)), F.coalesce(F.filter("xs", lambda x: (x > PART_EDGE) & (x < F.col("w") - PART_EDGE)), F.array().cast("array<int>")), F.array("w")))
    parts = parts.select(image, "day", "row", "over", "x0", "y0", "y1", F.posexplode(F.expr("zip_with(slice(xs, 1, size(xs) - 1), slice(xs, 2, size(xs) - 1), (a, b) -> struct(a, b))")).alias("at", "p")).select(image, "day", "row", "over", "y0", "y1", (F.col("at") + 1).alias("part"), (F.col("x0") + F.col("p.b")).alias("x1"), (F.col("x0") + F.col("p.a")).alias("x0")).where(F.col("x1") - F.col("x0") >= PART_WIDTH)
    parts = _ink(points, kept(parts), ["day", "row", "part"], PART_INK, image)
    found = _targets(few(parts, sizes, image), image, "cell", column_index=F.col("day"), part=F.col("part"), period_start=F.array_min("over"), period_end=F.array_max("over"), **_padded(4, 4))

    lower = _lines(dark, [image], "y", sizes, F.col("width") * FULL_SHARE, "whole")
    lower = few(few(lower, grids, image).select(image, F.expr("filter(whole, l -> l > main_bottom)").alias("low")).where("size(low) >= 7"), sizes, image)
    lower = lower.select(image, "width", F.posexplode(F.expr("filter(zip_with(slice(low, 3, 5), slice(low, 4, 5), (a, b) -> struct(a, b)), p -> p.b is not null)")).alias("at", "p"))
    details = _targets(lower, image, "courseDetailRow", row_index=F.col("at") + 1, x0=F.lit(0), x1=F.col("width"), y0=F.col("p.a") + 2, y1=F.col("p.b") - 2)
    return heads.unionByName(found).unionByName(details)


def exam_targets(points: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """The same columns as ``main_targets``: ``examRow`` and ``examCell`` of tables with at least four lines across and five down.

    Rows lie between lines across over half of the width, from the second on; columns between lines that cross nearly half of the table. Rows and cells of some size and with some ink
    are taken; a cell's row and column count all those between lines. Give the points of images without a grid.
    """
    ruled = _lines(points.where(F.col("grey") < LINE_GREY), [image], "y", sizes, F.col("width") * EXAM_SHARE, "ys").where("size(ys) >= 4")
    table = few(ruled, sizes, image).select(image, "ys", "width", "height", F.greatest(F.lit(0), F.get("ys", F.lit(0)) - 3).alias("top"), F.least(F.col("height"), F.element_at("ys", -1) + 3).alias("bottom"))
    table = kept(table)
    body = few(points.where(F.col("grey") < INK_GREY), table, image).where("y >= top and y < bottom").select(image, "x", "y")
    across = _lines(body, [image], "x", table, (F.col("bottom") - F.col("top")) * EXAM_COLUMN_SHARE, "xs").where("size(xs) >= 5")
    rows = few(table, across, image).select(image, "width", "height", "xs", F.greatest(F.lit(0), F.get("xs", F.lit(0)) - 4).alias("x0"), F.least(F.col("width"), F.element_at("xs", -1) + 4).alias("x1"), F.posexplode(F.expr("zip_with(slice(ys, 2, size(ys) - 2), slice(ys, 3, size(ys) - 2), (a, b) -> struct(a, b))")).alias("at", "p"))
    rows = rows.select(image, "width", "height", "xs", "x0", "x1", (F.col("at") + 1).alias("row"), F.col("p.a").alias("y0"), F.col("p.b").alias("y1")).where(F.col("y1") - F.col("y0") >= EXAM_SIZE)
    rows = kept(_ink(points, kept(rows), ["row"], EXAM_ROW_INK, image, margin_x=0))
    cells = rows.select(image, "width", "height", "row", "y0", "y1", F.posexplode(F.expr("zip_with(slice(xs, 1, size(xs) - 1), slice(xs, 2, size(xs) - 1), (a, b) -> struct(a, b))")).alias("at", "p"))
    cells = cells.select(image, "width", "height", "row", "y0", "y1", (F.col("at") + 1).alias("column"), F.col("p.a").alias("x0"), F.col("p.b").alias("x1")).where(F.col("x1") - F.col("x0") >= EXAM_SIZE)
    cells = _ink(points, cells, ["row", "column"], EXAM_CELL_INK, image)
    return _targets(rows, image, "examRow", row_index=F.col("row"), **(_padded(0, 4))).unionByName(_targets(cells, image, "examCell", row_index=F.col("row"), column_index=F.col("column"), **_padded(2, 3)))
