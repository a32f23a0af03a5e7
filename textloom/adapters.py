"""The library's tables over the driver's tables.

Each table is a DataFrame property here and the same SELECT in ``SQL``, so the
oracle queries start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Appended to a document's text by ``doc_id % 12``, so that every cleaning step
#: meets something to do.
SNIPPETS = (
    "See https://example.com/a/b?x=1#top and http://shop.example.org today.",
    "Write to support@example.com or sales.team@example.co.uk now.",
    "Thanks @username and @other_user, great work!",
    "Follow #MachineLearning and #BigData2024 trends.",
    "So happy :) and sad :( then :D or <3 and </3 again",
    'This is <b>bold</b> and <a href="x">linked</a> text.',
    "I don't like it, she's fine, they won't go and it isn't ours. DON'T stop, thats all, I'm here.",
    "Sooooo goooood!!!! Reeeeally??",
    "A state-of-the-art, well-known, user-like x-y thing for random-stuff.",
    "not good but fine, never one two three four five six without doubt",
    "There are 123 items at 19.99 or 1,250 each, done!! ok?",
    "at best so far as well as expected; no doubt the worst by far",
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = {
    "samples": """SELECT d.doc_id AS id, d.text AS text, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label,
        CASE WHEN l.quality = 1 THEN 1 ELSE -1 END AS label_num, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS confidence,
        d.source AS source, d.lang AS domain FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "decorated": "SELECT doc_id, text || ' ' || CASE doc_id % 12 "
    + " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SNIPPETS))
    + " END AS text FROM documents",
    "predictions": """SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
        WHEN event_type IN ('error', 'view') THEN 'negative' ELSE 'uncertain' END AS predicted_label,
        least(value / 200, 1.0::DOUBLE) AS confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS processing_time_ms,
        'm' || CAST(user_id % 3 AS VARCHAR) AS model_version, user_id FROM events""",
    "scored": """SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS actual,
        CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS y, (d.doc_id * 7919 % 1000) / 999.0::DOUBLE AS prob,
        CASE WHEN (d.doc_id * 7919 % 1000) / 999.0::DOUBLE >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted,
        d.lang AS domain, d.source AS source FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "raw_labels": """SELECT doc_id, CASE doc_id % 17 WHEN 0 THEN ' Positive ' WHEN 1 THEN 'NEG' WHEN 2 THEN '1' WHEN 3 THEN '1.0'
        WHEN 4 THEN '2' WHEN 5 THEN '2.0' WHEN 6 THEN '4.0' WHEN 7 THEN '3.5' WHEN 8 THEN 'liked' WHEN 9 THEN 'bad' WHEN 10 THEN 'mixed'
        WHEN 11 THEN 'invalid_label' WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN '-1' WHEN 15 THEN '5' ELSE 'Disliked' END AS raw_label,
        CASE WHEN doc_id % 23 = 0 THEN '  ' ELSE text END AS text FROM documents""",
}


def spread(df: DataFrame, key: str, body: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Deal the rows of ``body`` of a table in few small files over all cores
    before costly text steps. A table with files or bytes enough for every core is
    read as it lies, so a large one is never shuffled for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    few = size < cores * split and len(df.inputFiles()) < cores
    return body(df).repartition(cores, key) if few else body(df)


#: Rows of a narrow table, of few bytes each, that may be broadcast, so that the
#: texts which meet it stay where they are; more are left to Spark's size check.
NARROW = 2_000_000


class Tables:
    """Tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        positive = F.col("quality") == 1
        labels = self["labels"].select("doc_id", "quality")
        labels = F.broadcast(labels) if labels.count() <= NARROW else labels
        # Documents without a label go before the others are dealt.
        return spread(self["documents"], "doc_id", lambda docs: docs.join(labels, "doc_id")).select(
            F.col("doc_id").alias("id"),
            "text",
            F.when(positive, "positive").otherwise("negative").alias("label"),
            F.when(positive, 1).otherwise(-1).alias("label_num"),
            ((F.col("doc_id") * 37 % 101) / 100.0).alias("confidence"),
            "source",
            F.col("lang").alias("domain"),
        )

    @cached_property
    def decorated(self) -> DataFrame:
        snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 12 + 1).cast("int"))
        return spread(self["documents"], "doc_id").select("doc_id", F.concat("text", F.lit(" "), snippet).alias("text"))

    @cached_property
    def predictions(self) -> DataFrame:
        kind = F.col("event_type")
        return self["events"].select(
            "event_id",
            "ts",
            F.when(kind.isin("purchase", "signup"), "positive").when(kind.isin("error", "view"), "negative").otherwise("uncertain").alias("predicted_label"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"),
            F.from_json("props", "k bigint")["k"].alias("processing_time_ms"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
            "user_id",
        )

    @cached_property
    def scored(self) -> DataFrame:
        positive = F.col("quality") == 1
        prob = (F.col("doc_id") * 7919 % 1000) / 999.0
        return self["documents"].join(self["labels"], "doc_id").select(
            F.col("doc_id").alias("id"),
            F.when(positive, "positive").otherwise("negative").alias("actual"),
            F.when(positive, 1).otherwise(0).alias("y"),
            prob.alias("prob"),
            F.when(prob >= 0.5, "positive").otherwise("negative").alias("predicted"),
            F.col("lang").alias("domain"),
            "source",
        )

    @cached_property
    def raw_labels(self) -> DataFrame:
        spellings = (" Positive ", "NEG", "1", "1.0", "2", "2.0", "4.0", "3.5", "liked", "bad", "mixed", "invalid_label", "", None, "-1", "5", "Disliked")
        raw = F.element_at(F.array(*map(F.lit, spellings)), (F.col("doc_id") % 17 + 1).cast("int"))
        text = F.when(F.col("doc_id") % 23 == 0, "  ").otherwise(F.col("text"))
        return self["documents"].select("doc_id", raw.alias("raw_label"), text.alias("text"))
