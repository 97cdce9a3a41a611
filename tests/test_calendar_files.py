"""Calendar files: one for each calendar, all or none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronofold.sources.icsfiles import CalendarWriter, ExportError, export_calendars


def test_a_file_for_each_calendar(spark, tmp_path):
    rows = [(f"name {i}/é", f"BEGIN:VCALENDAR\r\n{i}") for i in range(20)] + [("empty", None)]
    export_calendars(spark.createDataFrame(rows, "calendar string, ics string").repartition(4), f"{tmp_path}/out")
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == 21 and files[0] == "empty.ics" and "name%207%2F%C3%A9.ics" in files
    assert (tmp_path / "out/name%207%2F%C3%A9.ics").read_bytes() == b"BEGIN:VCALENDAR\r\n7"


def test_failures_leave_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "calendar string, ics string")
    bad = rows.repartition(2, "calendar").withColumn("ics", F.when(F.col("calendar") == "b", F.raise_error(F.lit("no calendar"))).otherwise(F.col("ics")))
    cases = [(rows.limit(0), "NO_EVENTS"), (rows.union(rows), "ICS_FAILED"), (rows.union(spark.createDataFrame([(None, "z")], rows.schema)), "ICS_FAILED"), (bad, "ICS_FAILED")]
    for df, code in cases:
        with pytest.raises(ExportError) as e:
            export_calendars(df, f"{tmp_path}/out")
        assert e.value.code == code and not list(tmp_path.iterdir())
    export_calendars(rows, f"{tmp_path}/out")
    with pytest.raises(ExportError):
        export_calendars(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.ics", "b.ics"]


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path):
    writer = CalendarWriter(f"{tmp_path}/out")
    writer.write(iter([("a", "x")]))
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([("b", "y")]))
    assert not list(tmp_path.iterdir())
