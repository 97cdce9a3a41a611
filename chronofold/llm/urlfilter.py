"""URL filtering by a temporal list join, in DataFrame operations only.

A list is a log of dated entries (key, action, time): from that time on the key, a host or any parent domain, has that
action. Entries become validity intervals; a capture is judged by the entries that were in force when it was fetched.
Of the keys that cover its host the longest with an entry in force decides.

The as-of join is one sort: captures and intervals of a key stand in one sequence ordered by time, and each capture takes the
last interval before it. So a key with many entries costs each capture no more than one with few. The captures of a key
with very many of them are dealt to several parts, each of which sees all intervals of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, materialize

#: keys of the list that may be broadcast to leave out captures without any
BROADCAST_KEYS = 400_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; null for null and for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def covering_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a host of one label is its own key; null stays null."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame, key: str = "key", action: str = "action", time: str = "time") -> DataFrame:
    """(key, action, valid_from, valid_to): each entry holds until the key's next one; the last has no end (null).

    Entries without key, action or time are left out; repeated ones count once; of several entries of a key at one time the
    action that comes last in the alphabet holds. Keys are lower-cased.
    """
    e = entries.select(F.lower(F.col(key)).alias("key"), F.col(action).alias("action"), F.col(time).alias("valid_from")).where("key is not null and action is not null and valid_from is not null")
    e = e.groupBy("key", "valid_from").agg(F.max("action").alias("action"))
    return e.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))


def temporal_list_join(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched_at", key: str = "key", action: str = "action", entry_time: str = "time", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``captures`` with host, matched_key, action and valid_from beside their columns.

    The three last are null where no entry is in force: no list entry for the host or its parents, an entry that begins later, a null or
    relative URL, or a null time. Repeated captures each keep their row; an empty list leaves all unmatched. Columns of the list never
    reach the result, so names may clash; a capture's own columns of the four names are replaced. Captures are written once with a
    row number, as the numbers must not change if a task is run again.
    """
    own = [c for c in captures.columns if c not in ("host", "matched_key", "action", "valid_from")]
    row = "__row"
    while any(c.startswith(row) for c in own):
        row += "_"
    best_of = f"{row}b"
    rows = materialize(captures.select(*own, host_of(F.col(url)).alias("host")).withColumn(row, F.monotonically_increasing_id()), "captures")
    intervals = validity_intervals(entries, key, action, entry_time)
    asked = rows.select(F.col(row).alias("r"), F.col(time).alias("at"), F.explode(covering_keys(F.col("host"))).alias("key")).where(F.col("at").isNotNull())
    keys = intervals.select("key").distinct()
    asked = asked.join(F.broadcast(keys) if keys.count() <= broadcast_keys else keys, "key", "left_semi")
    asked, intervals = dealt(asked, intervals, "key", "r")
    entry = F.struct("action", "valid_from", "valid_to")
    one = intervals.select("key", "__salt", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("r"), entry.alias("entry"))
    two = asked.select("key", "__salt", "at", F.lit(1).alias("kind"), "r", F.lit(None).cast(one.schema["entry"].dataType).alias("entry"))
    order = Window.partitionBy("key", "__salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = one.unionByName(two).withColumn("entry", F.last("entry", ignorenulls=True).over(order)).where(F.col("r").isNotNull() & F.col("entry").isNotNull())
    met = met.where(F.col("entry.valid_to").isNull() | (F.col("at") < F.col("entry.valid_to")))
    best = met.groupBy("r").agg(F.max_by(F.struct("key", "entry"), F.length("key")).alias(best_of)).withColumnRenamed("r", row)
    out = rows.join(best, row, "left")
    return out.select(*own, "host", F.col(f"{best_of}.key").alias("matched_key"), F.col(f"{best_of}.entry.action").alias("action"), F.col(f"{best_of}.entry.valid_from").alias("valid_from"))
