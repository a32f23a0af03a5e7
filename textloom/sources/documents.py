"""Nested JSON documents: manifests, metadata, exported reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling

PART = "STRUCT<file: STRING, samples: BIGINT, sha256: STRING, positive: BIGINT, negative: BIGINT>"
MANIFEST = f"version STRING, domain STRING, created_at STRING, seed INT, max_samples BIGINT, raw_source STRING, train {PART}, test {PART}"
METADATA = """model_info STRUCT<algorithm: STRING, version: STRING, created_at: STRING>, training_data STRUCT<dataset: STRING, train_samples: BIGINT>,
preprocessing STRUCT<max_features: INT>, hyperparameters MAP<STRING, STRING>,
performance STRUCT<accuracy: DOUBLE, macro_f1: DOUBLE, macro_precision: DOUBLE, macro_recall: DOUBLE, training_time_seconds: DOUBLE, confusion_matrix: ARRAY<ARRAY<INT>>>,
artifacts STRUCT<model_size_bytes: BIGINT>"""


def split_digests(split: DataFrame, columns: list[str]) -> DataFrame:
    """(split, rows, checksum), by sums that need no list of rows."""
    return sampling.multiset(split, columns, [F.col("split")]).select("split", "rows", sampling.digest().alias("checksum"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, bytes, sha256) of the files under a folder by split, hashed
    byte by byte where they are read, one file at a time in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    split = F.regexp_extract("path", r"/split=([^/]+)/", 1)
    return files.select(split.alias("split"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(split: DataFrame, domain: str, seed: int, columns: list[str], label: str = "label", mergeable: bool = False) -> DataFrame:
    """One row that describes a split: counts and checksum of each part; of large
    parts take the ``mergeable`` checksum."""
    sums = split_digests(split, columns) if mergeable else sampling.checksum(split, columns, [F.col("split")])
    counts = split.groupBy("split").agg(F.count_if(F.col(label) == "positive").alias("positive"), F.count_if(F.col(label) == "negative").alias("negative"))
    part = F.struct(F.col("split").alias("file"), F.col("rows").alias("samples"), F.col("checksum").alias("sha256"), "positive", "negative")
    rows = sums.join(counts, "split")
    pick = lambda name: F.max(F.when(F.col("split") == name, part)).alias(name)
    return rows.agg(pick("train"), pick("test")).select(F.lit("1").alias("version"), F.lit(domain).alias("domain"), F.lit(seed).alias("seed"), "train", "test")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All metadata files under a path or glob; corrupt ones have null fields
    and keep their path."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, algorithm, domain, status): what can be loaded and what not."""
    domain = F.regexp_extract("path", r"(?:domain=|/)([^/=]+?)(?:_model\.metadata\.json|/part-[^/]*)$", 1)
    ok = F.col("model_info.algorithm").isNotNull()
    return read_metadata(spark, path).select("path", F.col("model_info.algorithm").alias("algorithm"), domain.alias("domain"), F.when(ok, "loaded").otherwise("failed").alias("status"))


def nested(df: DataFrame, *levels: str) -> DataFrame:
    """Rows as one nested value: maps by the level columns, structs at the end.

    For reports, whose rows are few by construction."""
    values = [c for c in df.columns if c not in levels]
    out = df.select(*levels, F.struct(*values).alias("value"))
    for i in range(len(levels), 0, -1):
        out = out.groupBy(*levels[: i - 1]).agg(F.map_from_entries(F.collect_list(F.struct(levels[i - 1], "value"))).alias("value"))
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
