"""Query op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .search import top_k


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, its whole text being the query."""
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"))


QUERIES = {"op10_search": op10_search}
ORACLES: dict[str, str] = {}
