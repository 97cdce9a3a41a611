"""Merge semantics of an event store: every change is a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_all(events: DataFrame) -> DataFrame:
    return events.withColumn("selected", F.lit(True))


def append(store: DataFrame, events: DataFrame) -> DataFrame:
    """All rows of both (a bag); new rows are selected."""
    return store.unionByName(replace_all(events))


def patch(store: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Fields of matching rows replaced and the row marked as edited. ``patches`` has the key, the fields and ``present``, the names of the fields it sets: a present null clears a field."""
    p = patches.select(F.col(key).alias("__key"), F.col("present").alias("__present"), *[F.col(f).alias(f"__{f}") for f in fields])
    j = store.join(p, F.col(key) == F.col("__key"), "left")
    sets = lambda f: F.coalesce(F.array_contains("__present", f), F.lit(False))
    new = {f: F.when(sets(f), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    new["user_edited"] = F.col("user_edited") | F.col("__key").isNotNull()
    return j.withColumns(new).select(*store.columns)


def remove(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids, key, "left_anti")


def toggle(selected: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The symmetric difference of two sets of ids."""
    tagged = selected.select(key).distinct().unionAll(ids.select(key).distinct())
    return tagged.groupBy(key).count().where("count = 1").select(key)


def select_all(store: DataFrame, value: bool) -> DataFrame:
    return store.withColumn("selected", F.lit(value))


def export_selected(store: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    return store.join(selected, key, "left_semi")


def safe_number(c: Column, fallback: int, low: int, high: int) -> Column:
    """A text as a whole number within bounds: blank counts as 0, anything that is no number as the fallback."""
    n = F.when(F.trim(c) == "", 0.0).otherwise(F.trim(c).try_cast("double"))
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.when(bad, float(fallback)).otherwise(F.least(F.lit(1e9), F.greatest(F.lit(-1e9), n))) + 0.5))).cast("int")


def draft_patch(d: DataFrame) -> DataFrame:
    """Numbers of an edited draft within their bounds; the seat of exams only; the place falls back to the room."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return d.select("id", safe_number(F.col("day"), 1, 1, 7).alias("day_of_week"), safe_number(F.col("period"), 1, 1, 14).alias("period_start"), safe_number(F.col("week"), 1, 1, 30).alias("week_start"),
                    safe_number(F.col("reminder"), 30, 0, 1440).alias("reminder_minutes"), F.when(F.col("type") == "EXAM", text("seat")).alias("seat_number"), F.coalesce(text("place"), text("room")).alias("location"))


def replayed(log: DataFrame, fields: list[str], store: str = "store_id", key: str = "id") -> DataFrame:
    """(store, key, fields, user_edited, selected, seq, pos): the events that a log of actions leaves, each at its place (seq, pos) of insertion.

    log: store, seq, pos, action, key, the fields, and ``present``, the names of the fields that an ``update`` sets. A row is an action or one event of an action of several:
    ``set`` (replaces all events and selects the new ones; with a null key it leaves none), ``append`` (selects the new), ``update``, ``remove``, ``toggle``, ``select_all``, ``clear`` and ``reset``.

    Nothing is applied step by step. What precedes a store's last ``set`` or ``reset`` does not count. A row lives if no ``remove`` of its id follows it; each field has the last value that a
    later ``update`` sets, else its own. An id's selection follows from the last action that fixes it - an insertion, a removal, or the store's last ``select_all`` or ``clear`` - and from the parity of
    the toggles since. That is one window of an id's rows, after one row for each store has been joined. Ids may repeat; a null key of any other action is ignored.
    """
    inserts, fixes = F.col("action").isin("set", "append"), F.col("action").isin("set", "append", "remove")
    marks = log.groupBy(store).agg(F.max(F.when(F.col("action").isin("set", "reset"), F.col("seq"))).alias("__since"), F.max(F.when(F.col("action").isin("select_all", "clear"), F.struct("seq", "action"))).alias("__all"))
    rows = log.join(marks, store).where(F.col(key).isNotNull() & (F.col("__since").isNull() | (F.col("seq") >= F.col("__since"))))
    own = Window.partitionBy(store, key)
    # what follows a row, from the log's end on: such a frame grows row by row, while one that ends with its partition is summed anew for each row
    later = own.orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    is_update = F.col("action") == "update"
    new = {f: F.first(F.when(is_update & F.array_contains("present", f), F.struct(F.col(f).alias("v"))), ignorenulls=True).over(later) for f in fields}
    rows = rows.select("*", *[c.alias(f"__{f}") for f, c in new.items()], F.max(F.when(F.col("action") == "remove", F.col("seq"))).over(own).alias("__gone"), F.max(F.when(fixes, F.struct("seq", inserts.alias("there")))).over(own).alias("__fixed"),
                       F.coalesce(F.max(is_update).over(later), F.lit(False)).alias("__edited"))
    all_last = F.coalesce(F.col("__all.seq") > F.col("__fixed.seq"), F.lit(False))
    since = F.greatest("__all.seq", "__fixed.seq")
    rows = rows.withColumn("__flips", F.sum(F.when((F.col("action") == "toggle") & (F.col("seq") > since), 1).otherwise(0)).over(own)).where(inserts & (F.col("__gone").isNull() | (F.col("__gone") < F.col("seq"))))
    base = F.when(all_last, (F.col("__all.action") == "select_all") & F.col("__fixed.there")).otherwise(F.col("__fixed.there"))
    values = [F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.v")).otherwise(F.col(f)).alias(f) for f in fields]
    return rows.select(store, key, *values, F.col("__edited").alias("user_edited"), (base != (F.col("__flips") % 2 == 1)).alias("selected"), "seq", "pos")
