"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from chronofold import registry
from tests.compare import of_frame, of_sql

QUERIES, ORACLES = registry.collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    got = of_frame(QUERIES[name](spark, sf_dir))
    assert got[1], "no rows"
    if name in ORACLES:
        want = of_sql(ORACLES[name], sf_dir)
        assert got[0] == want[0]
        assert got[1] == want[1]


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_holidays_are_excluded(spark, sf_dir):
    from pyspark.sql import functions as F

    from chronofold.operators import calendar as C
    from chronofold.sources.tables import arrangements

    start = F.lit("2026-09-07").cast("date")
    without = C.course_occurrences(arrangements(spark, sf_dir), start, C.periods_frame(spark)).count()
    assert QUERIES["course_occurrences"](spark, sf_dir).count() < without


def test_flagship_plan_has_no_shuffle(spark, sf_dir):
    plan = QUERIES["course_occurrences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_catalogue_join_takes_the_whole_catalogue(spark, tmp_path):
    parts = list(range(0, 900, 3))
    lines = [(k // 4, 37 * k % 900, 11 * k % 50, k % 4, 5.0) for k in range(120)]
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(o, n, p) for o, k, s, n, _ in lines for p in parts if p % 7 == s % 7 and p % 6 == k % 6 and p % 10 == k % 10}
    got = [tuple(r) for r in QUERIES["catalogue_join"](spark, str(tmp_path)).collect()]
    assert any(p > 200 for _, _, p in want)
    assert len(got) == len(want) and set(got) == want
