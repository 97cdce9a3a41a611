"""Query op6 and the personal-data stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii import KINDS, find_personal_data, redact, spelled


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strict"] == 1)
    of_kind = lambda k: lambda s: (s["strict"] == 1) & (s["kind"] == k)
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: s["strict"] == 0)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), added)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; ``n_chars`` follows the text where there is such a column.

    Null texts stay null (and their ``n_chars`` becomes null); null ids and repeated rows are kept; an empty table gives an empty one.
    """
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
