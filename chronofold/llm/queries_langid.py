"""Query op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, table
from .langid import fit, identify_language, training_sets


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(training_sets(docs, crc_mod("doc_id", 3) != 1, "doc_id", "text", "lang"))
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
