"""Query op3 and the near-duplicate stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unused
from .near_dup import BROADCAST_IDS, near_duplicates


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, collections=14)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more), the one with the least id; with all columns. Null ids and texts without words stay."""
    name = unused(docs, "gone")
    gone = materialize(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")


QUERIES = {"op3_near_dup": op3_near_dup}
ORACLES: dict[str, str] = {}
