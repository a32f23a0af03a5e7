"""Readers and writers of labelled samples.

Every reader gives ``text`` and ``raw_label``; ``accepted`` and ``rejected``
split them by the label rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.basic import trim

SEPARATORS = {"csv": ",", "tsv": "\t"}
SCHEMA = "id STRING, text STRING, label STRING, label_num INT, confidence DOUBLE, source STRING, ts TIMESTAMP_NTZ, original_label STRING"


def separator(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in SEPARATORS:
        raise ValueError(f"not a labelled file: {path}")
    return SEPARATORS[ext]


def pick(columns: list[str], wanted: tuple[str, ...], what: str) -> str:
    """The first wanted name that the header has, in any case."""
    known = {c.strip().lower(): c for c in columns}
    for name in wanted:
        if name in known:
            return known[name]
    raise ValueError(f"no {what} column among {columns}")


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header (or a folder of them, with ``sep``)."""
    raw = spark.read.csv(path, header=True, sep=sep or separator(path), quote='"', escape='"', multiLine=True)
    text, label = pick(raw.columns, L.TEXT_COLUMNS, "text"), pick(raw.columns, L.LABEL_COLUMNS, "label")
    return raw.select(trim(F.col(f"`{text}`")).alias("text"), trim(F.col(f"`{label}`")).alias("raw_label"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.json(path)
    text, label = pick(raw.columns, L.TEXT_COLUMNS, "text"), pick(raw.columns, L.LABEL_COLUMNS, "label")
    return raw.select(trim(F.col(f"`{text}`")).alias("text"), F.col(f"`{label}`").cast("string").alias("raw_label"))


def read_prefixed_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``__label__x text``; lines of another form have a null label."""
    line = F.col("value")
    raw = F.nullif(F.regexp_extract(line, r"^__label__(\S+)\s+", 1), F.lit(""))
    return spark.read.text(path).select(trim(F.regexp_replace(line, r"^__label__\S+\s+", "")).alias("text"), raw.alias("raw_label"))


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, place) of the lines of text files: ``place`` is (file, first byte
    of the split, number in the task that reads it) and ascends with the files'
    names and the lines in them, however Spark deals the splits out."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", at.alias("place"))


def star_reviews(reviews: DataFrame, text: str = "text", stars: str = "stars") -> DataFrame:
    label = F.when(F.col(stars) >= 4, "positive").when(F.col(stars) <= 2, "negative").otherwise("neutral")
    return reviews.select(trim(F.col(text)).alias("text"), label.alias("raw_label"))


def accepted(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Good rows in the sample schema; the id is a hash of text and label."""
    good = rows.where(L.reject_reason(F.col("text"), F.col("raw_label")).isNull())
    label = L.normalize(F.col("raw_label"))
    return good.select(
        F.sha1(F.concat_ws("\x1f", "text", "raw_label")).alias("id"), "text", label.alias("label"), L.number(label).alias("label_num"),
        F.lit(0.5).alias("confidence"), F.lit(source).cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("raw_label").alias("original_label"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", L.reject_reason(F.col("text"), F.col("raw_label"))).where("reject_reason is not null")


def load(rows: DataFrame, source: str | None = None) -> DataFrame:
    """``accepted``, or an error where nothing is left."""
    good = accepted(rows, source)
    if good.isEmpty():
        raise ValueError("no valid sample")
    return good


def write_csv(samples: DataFrame, path: str, text: str = "text", label: str = "label") -> None:
    out = samples.select(F.col(text).alias("review"), F.lower(label).alias("sentiment"))
    out.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def schema_report(df: DataFrame, name: str, required: tuple[str, ...], least: int) -> DataFrame:
    """(dataset, rows, enough_rows, missing): one row about a dataset."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("dataset"), "rows", (F.col("rows") >= least).alias("enough_rows"), F.lit(",".join(missing)).alias("missing")
    )
