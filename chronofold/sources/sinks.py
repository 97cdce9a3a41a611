"""Sinks: calendar files and JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NoEvents(ValueError):
    """There is nothing to export."""


def write_calendars(calendars: DataFrame, path: str) -> None:
    """One text record per calendar (column ``ics``); raises NoEvents for an empty frame."""
    if calendars.isEmpty():
        raise NoEvents("no events to export")
    calendars.select(F.col("ics").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def answers(events: DataFrame, key: str) -> DataFrame:
    """A JSON answer per document: its events in order and their mean confidence (0 without any)."""
    fields = [c for c in events.columns if c not in (key, "line_no")]
    g = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("events"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    return g.select(key, F.to_json(F.struct(F.lit(True).alias("success"), "confidence", "events")).alias("answer"))
