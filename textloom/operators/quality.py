"""Data quality of labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import trim

# Words and cut-offs of the label check.
POSITIVE_WORDS = ("great", "excellent", "amazing", "wonderful", "fantastic", "love", "loved", "brilliant", "perfect", "best", "good")
NEGATIVE_WORDS = ("terrible", "awful", "horrible", "worst", "bad", "hate", "hated", "disappointing", "poor", "waste", "broken")
BALANCE_OK, DUPLICATES_OK, LENGTH_OK, BIAS = 0.8, 0.01, (10, 100_000), 0.20


def digest(text: Column) -> Column:
    """Tells texts apart by their SHA-256, so that no whole text is shuffled."""
    return F.unhex(F.sha2(text, 256))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent, balance): balance is the smallest over the largest."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), (F.min("n") / F.max("n")).alias("balance"))
    return counts.join(F.broadcast(all_)).select(label, "n", (100 * F.col("n") / F.col("total")).alias("percent"), "balance")


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.length(text)
    return df.agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"), F.percentile(n, 0.5).alias("median_length"))


def duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    out = df.agg(F.count("*").alias("n"), F.count_distinct(digest(F.lower(trim(F.col(text))))).alias("unique_texts"))
    return out.withColumn("duplicates", F.col("n") - F.col("unique_texts"))


def vocabulary_size(df: DataFrame, text: str = "text") -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where("word <> ''")
    return words.agg(F.count_distinct("word").alias("vocabulary"))


def quality_flags(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row of booleans over the statistics above."""
    balance = df.groupBy(label).agg(F.count("*").alias("n")).agg((F.min("n") / F.max("n")).alias("balance"))
    stats = duplicates(df, text).join(F.broadcast(length_stats(df, text))).join(F.broadcast(balance))
    flags = stats.select(
        (F.col("balance") >= BALANCE_OK).alias("balanced"),
        (F.col("duplicates") < DUPLICATES_OK * F.col("n")).alias("few_duplicates"),
        ((F.col("min_length") > LENGTH_OK[0]) & (F.col("max_length") < LENGTH_OK[1])).alias("lengths_ok"),
    )
    return flags.withColumn("all_ok", F.expr("balanced and few_duplicates and lengths_ok"))


def length_bias(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, mean_length, biased): biased if the means differ by over a fifth."""
    means = df.groupBy(label).agg(F.avg(F.length(text)).alias("mean_length"))
    spread = means.agg(((F.max("mean_length") - F.min("mean_length")) / F.max("mean_length") > BIAS).alias("biased"))
    return means.join(F.broadcast(spread))


def duplicate_rate(df: DataFrame, text: str = "text") -> DataFrame:
    per = df.groupBy(digest(F.col(text)).alias("d")).agg(F.count("*").alias("n"))
    return per.agg((F.count_if(F.col("n") > 1) / F.sum("n")).alias("duplicate_rate"))


def label_inconsistency(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    per = df.groupBy(digest(F.col(text)).alias("d")).agg((F.min(label) < F.max(label)).alias("several"))
    return per.agg((F.count_if("several") / F.count("*")).alias("inconsistency"))


def suspicious(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows whose label speaks against their polar words (as substrings)."""
    low = F.lower(text)
    good, bad = low.rlike("|".join(POSITIVE_WORDS)), low.rlike("|".join(NEGATIVE_WORDS))
    return df.where(((F.col(label) == "positive") & bad & ~good) | ((F.col(label) == "negative") & good & ~bad))


def label_noise(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(sample_size, suspicious, noise_rate) over all rows; null without rows."""
    out = df.agg(F.count("*").alias("sample_size")).join(F.broadcast(suspicious(df, text, label).agg(F.count("*").alias("suspicious"))))
    return out.withColumn("noise_rate", F.try_divide(F.col("suspicious").cast("double"), F.col("sample_size")))


def class_weights(df: DataFrame, threshold: float = 3.0, label: str = "label") -> DataFrame:
    """(label, weight): N / (K n), or 1 where no class outweighs another enough."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.max("n") / F.min("n")).alias("ratio"))
    weight = F.when(F.col("ratio") > threshold, F.col("total") / (F.col("k") * F.col("n"))).otherwise(1.0)
    return counts.join(F.broadcast(all_)).select(label, weight.alias("weight"))


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        (F.max("n") / F.min("n")).alias("ratio"),
        (F.count("*") < 2).alias("one_class"),
        (F.max("n") / F.min("n") > 10).alias("imbalanced"),
        (F.coalesce(F.sum("n"), F.lit(0)) < 10).alias("few_rows"),
    )
