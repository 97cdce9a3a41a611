"""Uploaded files: classification, text, and outputs of recognition services as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.events import validate_courses, validate_events

# fixed values: accepted extensions and their media types, refused ones, the size limit
MEDIA_TYPES = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "csv": "text/csv", "txt": "text/plain",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
REFUSED, REFUSED_TYPES = ["heic", "heif"], ["image/heic", "image/heif"]
ACCEPTED_TYPES = sorted({*MEDIA_TYPES.values(), "image/jpg"})
LIMIT_BYTES = 25 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.element_at(F.split(F.lower(name), r"\."), -1)


def media_type(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext), F.lit(""))


def event_source(ext: Column, mime: Column) -> Column:
    return (F.when((mime == "application/pdf") | (ext == "pdf"), "PDF").when(mime.startswith("image/") | ext.isin(*REFUSED), "IMAGE")
            .when(ext.isin("csv", "xls", "xlsx"), "EXCEL").when(ext == "txt", "TEXT").when(mime.isin("text/csv", MEDIA_TYPES["xls"], MEDIA_TYPES["xlsx"]), "EXCEL").otherwise("TEXT"))


def classify(files: DataFrame) -> DataFrame:
    """Files (name, mime, bytes) with extension, media type, source and the reason of a refusal (null if accepted)."""
    f = files.withColumn("ext", extension(F.col("name")))
    f = f.withColumn("mime", F.when(F.coalesce("mime", F.lit("")) == "", media_type(F.col("ext"))).otherwise(F.lower("mime")))
    mobile = F.col("ext").isin(*REFUSED) | F.col("mime").isin(*REFUSED_TYPES)
    known = F.col("ext").isin(*MEDIA_TYPES) | F.col("mime").isin(*ACCEPTED_TYPES)  # either is enough
    reason = F.when(mobile, "UNSUPPORTED_HEIC").when(~known, "INVALID_FILE").when(F.col("bytes") > LIMIT_BYTES, "FILE_TOO_LARGE")
    return f.withColumn("rejected", reason).withColumn("source", event_source(F.col("ext"), F.col("mime")))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path as (name, mime, bytes, content, input_hash)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("input_hash"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,csv}") -> DataFrame:
    """Whole text files with their source; CSV is text here and is not split into columns."""
    t = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.when(F.lower("_metadata.file_name").endswith(".csv"), "EXCEL").otherwise("TEXT").alias("source"), F.lit(1.0).alias("confidence"))


MODEL_SCHEMA = "courses array<struct<name:string,teacher:string,location:string,dayOfWeek:int,periodStart:int,periodEnd:int,weekStart:int,weekEnd:int,weekType:string,specificWeeks:array<int>,confidence:double>>"


def model_courses(raw: DataFrame, key: str, col: str = "raw") -> DataFrame:
    """Courses in a language model's JSON, validated; anything that is not JSON gives no rows."""
    c = raw.select(key, F.explode(F.from_json(col, MODEL_SCHEMA)["courses"]).alias("c"))
    return validate_courses(c.select(key, "c.name", "c.teacher", "c.location", F.col("c.dayOfWeek").alias("day_of_week"), F.col("c.periodStart").alias("period_start"), F.col("c.periodEnd").alias("period_end"), F.col("c.weekStart").alias("week_start"), F.col("c.weekEnd").alias("week_end"), F.col("c.weekType").alias("week_type"), F.col("c.specificWeeks").alias("specific_weeks"), "c.confidence"))


EVENT_SCHEMA = "events array<struct<title:string,type:string,eventType:string,date:string,timeStart:string,timeEnd:string,location:string,seatNumber:string,description:string,confidence:double,uncertainFields:array<string>>>"


def model_events(raw: DataFrame, key: str, col: str = "raw") -> DataFrame:
    """Events of any type in a language model's JSON, validated; anything that is not JSON gives no rows."""
    e = raw.select(key, F.explode(F.from_json(col, EVENT_SCHEMA)["events"]).alias("e"))
    fields = {"date": "date", "timeStart": "time_start", "timeEnd": "time_end", "location": "location", "seatNumber": "seat_number", "description": "description", "confidence": "confidence"}
    return validate_events(e.select(key, "e.title", F.coalesce("e.type", "e.eventType").alias("type"), *[F.col(f"e.{a}").alias(b) for a, b in fields.items()], F.coalesce("e.uncertainFields", F.array().cast("array<string>")).alias("uncertain_fields")))


def extraction_result(payloads: DataFrame) -> DataFrame:
    """Results of PDF extraction (text, mode, success): confidence and warnings by mode; failures and empty texts are dropped."""
    text = F.trim("text")
    return payloads.where(F.col("success") & (text != "")).withColumns({"text": text, "confidence": F.when(F.col("mode") == "table", 0.95).otherwise(0.78), "source": F.lit("PDF"),
                                                                       "warnings": F.when(F.col("mode") == "table", F.array().cast("array<string>")).otherwise(F.array(F.lit("PDF 未识别到表格结构，已使用文本抽取结果。")))})
