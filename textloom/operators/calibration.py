"""Calibration of predicted probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invalid(df: DataFrame, bins: int, prob: str = "prob", y: str = "y") -> DataFrame:
    """Rows outside the rules, with the reason."""
    if bins < 2:
        raise ValueError("bins must be at least 2")
    reason = F.when(F.col(prob).isNull() | ~F.col(prob).between(0, 1), "probability_out_of_range").when(F.col(y).isNull() | ~F.col(y).isin(0, 1), "label_not_binary")
    return df.withColumn("reason", reason).where("reason is not null")


def brier(df: DataFrame, prob: str = "prob", y: str = "y") -> DataFrame:
    return df.agg(F.avg((F.col(prob) - F.col(y)) ** 2).alias("brier"))


def bins(df: DataFrame, n: int, *groups: str, prob: str = "prob", y: str = "y") -> DataFrame:
    """(groups, bin, lower, upper, n, confidence, accuracy), empty bins too."""
    spark = df.sparkSession
    at = F.least(F.floor(F.col(prob) * n), F.lit(n - 1)).cast("int")
    found = df.groupBy(*groups, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("confidence"), F.avg(y).alias("accuracy"))
    every = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    if groups:
        every = df.select(*groups).distinct().join(F.broadcast(every))
    out = every.join(found, [*groups, "bin"], "left")
    return out.select(*groups, "bin", (F.col("bin") / n).alias("lower"), ((F.col("bin") + 1) / n).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def errors(binned: DataFrame, *groups: str) -> DataFrame:
    """Expected and largest calibration error over ``bins``."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return binned.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(F.when(F.col("n") > 0, gap)).alias("mce")
    )


def reliability(binned: DataFrame) -> DataFrame:
    return binned.select("bin", "lower", "upper", "n", "confidence", "accuracy", (F.col("accuracy") - F.col("confidence")).alias("gap"))


def one_vs_rest(df: DataFrame, probabilities: str, y: str) -> DataFrame:
    """(class, prob, y): each class of a probability array against the rest."""
    rows = df.select(F.posexplode(probabilities).alias("class", "prob"), F.col(y).alias("actual"))
    return rows.select("class", "prob", (F.col("actual") == F.col("class")).cast("int").alias("y"))


def multiclass(df: DataFrame, n: int, probabilities: str = "probabilities", y: str = "y") -> DataFrame:
    """Brier, ECE and MCE averaged over the classes."""
    rows = one_vs_rest(df, probabilities, y)
    own = rows.groupBy("class").agg(F.avg((F.col("prob") - F.col("y")) ** 2).alias("brier"))
    return own.join(errors(bins(rows, n, "class"), "class"), "class").agg(F.avg("brier").alias("brier"), F.avg("ece").alias("ece"), F.avg("mce").alias("mce"))
