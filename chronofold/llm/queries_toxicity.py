"""Query op9 and the toxicity stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, unused
from .toxicity import char_model, fit, score_toxicity


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = char_model(docs)
    scorer = fit(docs, table(spark, sf_dir, "labels"), model, crc_mod("doc_id", 5) != 0)
    out = score_toxicity(docs.select("doc_id", "text"), model, scorer)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, with their columns; learned from all labelled rows.

    Null and empty texts show no evidence and stay, as do null ids; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = char_model(docs)
    scorer = fit(docs, table(spark, sf_dir, "labels"), model, F.lit(True))
    name = unused(docs, "toxicity")
    return score_toxicity(docs, model, scorer, out_col=name).where(F.col(name) < 0.5).drop(name)


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
