"""Query op2 and the decontamination stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unused
from .decontam import benchmark_leaks


#: ids that may be broadcast (16 MB of longs)
BROADCAST_IDS = 2_000_000


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that holds a benchmark item, and the item."""
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their columns. Null ids stay."""
    name = unused(docs, "leak")
    leaks = materialize(benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    few = leaks.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(leaks) if few else leaks, F.col("doc_id") == F.col(name), "left_anti")


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
