"""Query op7 and the packing stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def tokenizer_path() -> str:
    """The installed vocabulary; any other place can be given to ``pack``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents.

    Null and empty texts are one piece of the end id; rows that repeat an id, or have none, are documents of their own; an empty table
    gives no pieces; other columns are ignored.
    """
    return pack(docs, tokenizer_path())


QUERIES = {"op7_pack": op7_pack}
ORACLES: dict[str, str] = {}
