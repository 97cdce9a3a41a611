"""An extension beyond batch use: texts that arrive as files become events as a stream.

Parsing is stateless per line, so the batch functions apply unchanged. Repeated uploads are recognised by their content hash
within a watermark; counts by type run over event-time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import extract as X
from chronofold.functions import text as N

ARRIVALS = "doc_id long, text string, arrived_at timestamp"


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_uploads(arrivals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Arrivals without those whose text came before within the watermark."""
    return arrivals.withColumn("input_hash", F.sha2("text", 256)).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["input_hash"])


def sentence_events(arrivals: DataFrame, as_of: str) -> DataFrame:
    """Sentences with type, date and time; sentences without a date are left out."""
    day = F.lit(as_of).cast("date")
    s = arrivals.select("doc_id", "arrived_at", F.explode(N.sentences(F.col("text"))).alias("line")).withColumn("n", N.normalize(F.col("line")))
    s = s.withColumn("date", X.date_of(F.col("n"), day)).where("date is not null").withColumn("t", X.time_of(F.col("n")))
    return s.select("doc_id", "arrived_at", "line", X.event_type(F.col("line")).alias("type"), "date", F.col("t.start").alias("time_start"), F.col("t.end").alias("time_end"))


def type_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type and arrival window; late ones beyond the watermark are left out."""
    w = events.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", window).alias("w"), "type").count()
    return w.select(F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "type", "count")
