"""Tables drawn with rules: snapping, spans, pieces and words outside the grid."""

from __future__ import annotations

import random

from chronofold.operators import pages, ruled


def test_cells_of_a_timetable(spark):
    # two columns; the rule at 60 crosses the first one only, in two pieces, one of them drawn from right to left
    rules = [(1, x, 0.0, x + d, 100.0) for x, d in ((0.0, 0.0), (50.0, 1.0), (52.0, 0.0), (100.0, 0.0))] + [(1, 0.0, y, 100.0, y) for y in (0.0, 20.0, 21.0, 100.0)] + [(1, 25.0, 60.0, 0.0, 60.0), (1, 27.0, 60.0, 51.0, 60.0)]
    words = [(1, 1, "星期一", 10.0, 10.0), (1, 2, "星期二", 70.0, 10.0), (1, 3, "离散▲", 10.0, 30.0), (1, 4, "(1-2节)1-16周", 10.0, 40.0), (1, 5, "/场地:A1", 20.0, 41.0), (1, 6, "物理▲", 10.0, 65.0), (1, 7, "(3-4节)2-4周/", 10.0, 75.0),
             (1, 8, "网络▲", 60.0, 50.0), (1, 9, "(5-6节)9周/", 60.0, 62.0), (1, 10, "outside", 120.0, 50.0), (1, 11, "below", 60.0, 130.0), (1, 12, None, 60.0, 50.0), (2, 1, "no rules", 1.0, 1.0)]
    r = spark.createDataFrame(rules, "doc_id long, x0 double, y0 double, x1 double, y1 double")
    w = spark.createDataFrame(words, "doc_id long, seq long, text string, x double, y double")
    cells = ruled.ruled_cells(r, w, ["doc_id"])
    got = {(c.row_index, c.column_index): c.text for c in cells.collect()}
    assert got == {(0, 0): "星期一", (0, 1): "星期二", (1, 0): "离散▲\n(1-2节)1-16周 /场地:A1", (2, 0): "物理▲\n(3-4节)2-4周/", (1, 1): "网络▲\n(5-6节)9周/"}
    assert sorted(x.line.split()[1] + x.line.split()[2] for x in pages.table_lines(cells).collect()) == ["1-2节离散", "3-4节物理", "5-6节网络"]
    assert ruled.ruled_cells(r.limit(0), w, ["doc_id"]).count() == ruled.ruled_cells(r, w.limit(0), ["doc_id"]).count() == 0


def test_random_grids_equal_brute_force(spark):
    rng = random.Random(5)
    rules, words, want = [], [], {}
    for page in range(20):
        xs, ys = sorted(rng.sample(range(0, 400, 10), rng.randrange(2, 7))), sorted(rng.sample(range(0, 400, 10), rng.randrange(2, 8)))
        rules += [(page, float(x), 0.0, float(x), 400.0) for x in xs]
        drawn = {(i, j) for i in range(len(ys)) for j in range(len(xs) - 1) if i in (0, len(ys) - 1) or rng.random() < 0.6}
        rules += [(page, float(xs[j]), float(ys[i]), float(xs[j + 1]), float(ys[i])) for i, j in drawn]
        rows = sorted({i for i, _ in drawn})
        for n in range(60):
            x, y = rng.uniform(-10, 410), rng.uniform(-10, 410)
            words.append((page, n, f"w{n}", x, y))
            j = sum(e <= x for e in xs) - 1
            if 0 <= j < len(xs) - 1 and ys[0] <= y < ys[-1]:
                top = max(i for i in range(len(ys)) if (i, j) in drawn and ys[i] <= y)
                want.setdefault((page, rows.index(top), j), []).append(f"w{n}")
    got = ruled.ruled_cells(spark.createDataFrame(rules, "page long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(words, "page long, seq long, text string, x double, y double"), ["page"])
    assert {(c.page, c.row_index, c.column_index): sorted(c.text.split()) for c in got.collect()} == {k: sorted(v) for k, v in want.items()}
