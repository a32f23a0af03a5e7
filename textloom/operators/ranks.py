"""Ranks and shuffles that spread over many tasks.

A window over a label would put a third of all rows in one task. Rows are
numbered within (group, bucket of the order key), and the buckets' counts give
each bucket its first number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, identity: Column) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")))


def ranked(df: DataFrame, groups: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Adds ``name``, gapless from 1 within each group in the given order.

    ``bucket`` must ascend with the order: a prefix of a hash, a step of an id."""
    df = df.withColumn("bucket__", bucket)
    keys = [*groups, "bucket__"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n__"))
    before = Window.partitionBy(*groups).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__"))
    df = df.withColumn("own__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [df[k].eqNullSafe(counts[k]) for k in keys]
    out = df.join(counts, on).select(*[df[c] for c in df.columns if c not in ("bucket__", "own__")], (F.col("own__") + F.col("first__")).alias(name))
    return out


def shuffled(df: DataFrame, groups: list[str], seed: int, identity: str, name: str = "rank") -> DataFrame:
    """``ranked`` in a seeded random order."""
    df = df.withColumn("key__", shuffle_key(seed, F.col(identity)))
    return ranked(df, groups, ["key__", identity], F.substring("key__", 1, 3), name).drop("key__")
