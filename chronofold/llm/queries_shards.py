"""Query op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .shards import ShardedTable

ARRIVALS = 4


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in four arrivals, compacted after every second one: each row's checksum and the shard that holds it at the newest version."""
    docs = table(spark, sf_dir, "documents")
    store = ShardedTable(spark, new_path(spark, "shards"))
    arrival = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), F.lit(0))
    for first in range(0, ARRIVALS, 2):  # two arrivals, then a compaction
        store.append_all(docs.withColumn("__arrival", arrival).where(F.col("__arrival").between(first, first + 1)), "__arrival")
        store.compact()
    facts = store.manifest().select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "level")
    rows = store.read().select("doc_id", "lang", "source", "n_chars", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("__shard").alias("shard"))
    return rows.join(facts, "shard", "left")


QUERIES = {"op1_shards": op1_shards}
ORACLES: dict[str, str] = {}
