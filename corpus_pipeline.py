"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The first three drop documents
(toxic ones, all but one of each group of near duplicates, holders of benchmark items), the fourth replaces personal data in
the texts, the last returns the packed pieces. SQL cannot express them: tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.common import materialize
from chronofold.llm.queries_decontam import decontamination_stage
from chronofold.llm.queries_dedup import near_dup_stage
from chronofold.llm.queries_packing import packing_stage
from chronofold.llm.queries_pii import pii_stage
from chronofold.llm.queries_toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
