"""Sums over regions, masks and pattern look-ups against brute force."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import chronofold.plans.raster
from chronofold import plans
from chronofold.operators import cells, geometry, ocr, raster


def test_region_sums_equal_counting(spark):
    rng = random.Random(2)
    points = [(i, rng.randrange(-5, 40), rng.randrange(30), rng.randrange(3)) for i in range(3) for _ in range(400)]
    regions = [(i, n, *sorted((rng.randrange(-8, 45), rng.randrange(-8, 45))), *sorted((rng.randrange(-3, 33), rng.randrange(-3, 33)))) for i in range(4) for n in range(30)]
    p = spark.createDataFrame(points, "image_id int, x int, y int, dark int")
    r = spark.createDataFrame(regions, "image_id int, n int, x0 int, x1 int, y0 int, y1 int")
    dark, wide = {}, {}
    for i, n, x0, x1, y0, y1 in regions:
        rows = [sum(d for j, x, y, d in points if j == i and x0 <= x < x1 and y == at) for at in range(y0, y1)]
        if sum(rows):
            dark[i, n], wide[i, n] = sum(rows), max(rows)
    assert {(t.image_id, t.n): t.dark for t in raster.region_sums(p, r, ["n"]).collect()} == dark
    assert {(t.image_id, t.n): t.widest for t in raster.widest_rows(p, r, ["n"]).collect()} == wide
    assert raster.region_sums(p, r.limit(0), ["n"]).count() == raster.region_sums(p.limit(0), r, ["n"]).count() == 0


def test_points_do_not_meet_regions(spark):
    """The number of joined rows grows with points and regions, not with their product."""
    p = spark.range(20_000).select(F.lit(1).alias("image_id"), (F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y"), F.lit(1).alias("dark"))
    r = spark.range(200).select(F.lit(1).alias("image_id"), F.col("id").alias("n"), F.lit(0).alias("x0"), (F.col("id") % 7 * 20 + 60).alias("x1"), F.lit(0).alias("y0"), (F.col("id") % 5 * 10 + 50).alias("y1"))
    plan = raster.region_sums(p, r, ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "x0" not in "".join(line for line in plan.splitlines() if "Join" in line)
    assert {t.n: t.dark for t in raster.region_sums(p, r, ["n"]).collect()} == {n: (n % 7 * 20 + 60) * (n % 5 * 10 + 50) for n in range(200)}


def test_mask(spark):
    px = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (1, 1, 0, 252, 252, 252), (1, 2, 0, 253, 253, 253), (1, 3, 0, None, 0, 0), (1, 4, 0, 255, 255, 230)], "image_id int, x int, y int, red int, green int, blue int")
    assert [r.dark for r in raster.dark_mask(px).orderBy("x").collect()] == [0, 1, 0, 0, 1]


def test_required_pieces(spark):
    want = {"数字.*济": "数字", "c.*7$": "", "ab?cd": "cd", "[课科]程12号.*3": "程12号", "ab|cd": "", "x{2}abc": "ab", "q*?ab": "ab", "[ab]*?xyzw": "xyzw", "(?i)abcd": "", r"\d+abcd": "", "abcdef": "abcd", "": "", "ab+cd": "cd"}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", ocr.required_piece(F.col("p")).alias("x")).collect()}
    assert got == want


def test_pattern_matches_equal_matching_all(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    patterns = [(rng.randrange(3), rng.choice([word(rng.randrange(1, 6)), f"{word(3)}.*{word(1)}", f"{word(2)}?{word(2)}", f"[ab]{word(2)}+", f"{word(1)}|{word(3)}", f"{word(2)}{{2}}{word(1)}$", f"^{word(3)}*?{word(2)}"])) for _ in range(120)] + [(0, None)]
    texts = [(i, rng.randrange(3), word(rng.randrange(14))) for i in range(150)] + [(900, 0, None)]
    t, p = spark.createDataFrame(texts, "id int, slot int, text string"), spark.createDataFrame(patterns, "slot int, alias string")
    got = sorted((r.id, r.alias) for r in ocr.pattern_matches(t, p, ["slot"], "text", "alias").collect())
    assert got == sorted({(i, a) for i, s, x in texts for q, a in patterns if s == q and x is not None and a is not None and re.search(a, x)})


def test_a_page_of_very_many_lines(spark):
    """Lines by their first item, on a page of 100,000 heights among small ones."""
    n = 100_000
    items = spark.range(n).select(F.lit("long").alias("page"), F.col("id").alias("seq"), ((F.col("id") * 7919) % n * 1.5).alias("y"))
    items = items.union(spark.createDataFrame([("short", 1, 10.0), ("short", 2, 6.0), ("short", 3, 5.9), ("short", 4, 1.8), ("short", 5, None), (None, 6, 3.0)], "page string, seq long, y double"))
    got = geometry.visual_lines(items, "page")
    assert {r.seq: r.line_no for r in got.where("page = 'short' or page is null").collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 0, 6: 1}
    # heights are 1.5 apart, so a line holds three of them
    assert got.where("page = 'long'").groupBy("line_no").count().where("count <> 3").count() == 1
    assert got.where("page = 'long'").agg(F.max("line_no")).first()[0] == -(-n // 3)


def test_points_are_never_broadcast(spark):
    """Points are many more than the rows they are made from, whatever their estimated size."""
    points = spark.range(2).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("y"), F.lit(0).alias("grey"), F.lit(1).alias("dark"))
    sizes = spark.range(2).select(F.col("id").alias("image_id"), F.lit(31).alias("width"), F.lit(31).alias("height"))
    boxes = raster.table_boxes(points, sizes)
    for df in (boxes, raster.cropped(points, boxes)[0], raster.main_grids(points, sizes), raster.exam_targets(points, sizes), cells.detected_grids(points, sizes)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_drawn_points_of_an_image_stay_in_one_partition(spark, sf_dir):
    """Counting the points of images by row or by column shuffles none of them."""
    points = plans.raster._drawn(spark, sf_dir, plans.raster.SMALL)
    plan = points.groupBy("image_id", "y").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate")[0] and points.groupBy("image_id", "x", "y").count().where("count > 1").isEmpty()
