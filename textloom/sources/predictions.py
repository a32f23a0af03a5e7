"""The prediction log as JSON lines by day, and its retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp TIMESTAMP, textHash STRING, textLength INT, predictedLabel STRING, confidence DOUBLE, processingTimeMs BIGINT, modelVersion STRING"
NAMES = {"timestamp": "ts", "textHash": "text_hash", "textLength": "text_length", "predictedLabel": "predicted_label", "processingTimeMs": "processing_time_ms", "modelVersion": "model_version"}


def to_line(df: DataFrame) -> Column:
    """One JSON object per row, with the log's field names."""
    given = {v: k for k, v in NAMES.items()} | {"confidence": "confidence"}
    fields = [F.col(c).alias(given[c]) for c in df.columns if c in given]
    return F.to_json(F.struct(*fields))


def from_line(line: Column) -> Column:
    return F.from_json(line, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", dt DATE").json(path).withColumnsRenamed(NAMES)


def write(df: DataFrame, path: str) -> None:
    """Append to one folder per day."""
    given = {v: k for k, v in NAMES.items() if v in df.columns}
    df.withColumn("dt", F.to_date("ts")).withColumnsRenamed(given).write.partitionBy("dt").mode("append").json(path)


def expired(days: DataFrame, today: Column, keep: int = 7) -> DataFrame:
    """The day partitions that are older than ``keep`` days."""
    return days.select("dt").distinct().where(F.col("dt") < F.date_sub(today, keep))
