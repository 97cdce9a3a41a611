"""Faults that a review found on larger tables, in small."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronofold import plans
from chronofold.operators import raster
from chronofold.plans import raster as image_plans


def _shuffled(spark) -> int:
    """Bytes that the session has written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", ["exam_targets", "main_targets", "grid_slots", "main_grids"])
def test_points_of_images_are_not_shuffled(spark, sf_dir, name):
    """F3 to F6: an image has some thousand or ten thousand points and is shuffled as its rectangles and what is counted by its lines."""
    before = _shuffled(spark)
    assert image_plans.QUERIES[name](spark, sf_dir).count()
    assert _shuffled(spark) - before < 60_000 * plans.raster.table(spark, sf_dir, "supplier").count()


def test_parted_rectangles_hold_each_place_once(spark):
    rng = random.Random(5)
    images = [[(*sorted((rng.randrange(20), rng.randrange(20))), *sorted((rng.randrange(15), rng.randrange(15))), rng.choice((0, 90, 200, 254))) for _ in range(n)] for n in (0, 1, 2, 9, 30)] + [[(3, 3, 0, 9, 7), (0, 9, 4, 4, 7)]]
    rows = spark.createDataFrame([(i, [v for r in rs for v in r]) for i, rs in enumerate(images)], "i int, r array<int>")
    for i, r in rows.select("i", image_plans._parted(F.col("r")).alias("r")).collect():
        want, got = {}, []
        for x0, x1, y0, y1, grey in images[i]:
            for at in ((x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)):
                want[at] = min(grey, want.get(at, 255))
        for x0, x1, y0, y1, grey in zip(*[iter(r)] * 5):
            got += [((x, y), grey) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
        assert sorted(got) == sorted(want.items())


def test_places_are_met_by_image_alone(spark):
    rng = random.Random(6)
    many = [(i % 3, rng.randrange(-6, 40), n) for n in range(300) for i in range(4)]
    side = [(i, rng.randrange(30), k) for k in range(12) for i in range(1, 5)] + [(1, 5, 90), (1, 5, 91), (2, -4, 92)]
    m = spark.createDataFrame(many, "image_id int, x int, n int").repartition(8, "image_id")
    out = raster.at_places(m, spark.createDataFrame(side, "image_id int, at long, k int").withColumnRenamed("at", "x"), "x", ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_id" in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and " x#" in line.split("hashpartitioning")[1] and "n#" in line]
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, x, n, k) for i, x, n in many for j, at, k in side if (i, x) == (j, at))


def test_a_point_on_the_edge_of_two_cells_is_in_both(spark):
    cells = [(1, 1, 10, 30), (1, 1, 30, 50), (1, 1, 60, 80), (1, 3, 0, 5), (2, 7, 40, 60)]
    points = [(i, d, 4, y) for i in (1, 2, 3) for d in (1, 2, 3, 7) for y in range(0, 90)]
    of_day = spark.createDataFrame(points, "image_id int, day int, x int, y int")
    out = raster._in_cells(of_day, spark.createDataFrame(cells, "image_id int, day int, y0 int, y1 int"), "image_id")
    want = [(i, d, x, y, y0, y1 - y0 + 1) for i, d, x, y in points for j, e, y0, y1 in cells if (i, d) == (j, e) and y0 <= y <= y1]
    assert sorted((r.image_id, r.day, r.x, r.y, r.row, r.tall) for r in out.collect()) == sorted(want)
