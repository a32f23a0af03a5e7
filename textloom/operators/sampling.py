"""Quotas, balancing, splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked, shuffle_key, shuffled

BALANCED = 0.95


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def quotas(df: DataFrame, most: int, label: str = "label") -> DataFrame:
    """(label, n, quota): how many rows of each class ``most`` rows may hold."""
    counts = label_counts(df, label)
    total = counts.agg(F.sum("n").alias("total"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("n") / F.col("total") + 0.5)).cast("long")
    return counts.join(F.broadcast(total)).select(label, "n", quota.alias("quota"))


def quota_sample(df: DataFrame, most: int, order: str, label: str = "label") -> DataFrame:
    """The first rows of each class in ``order`` (a number), up to its quota."""
    rows = ranked(df, [label], [order], F.floor(F.col(order) / 4096), "rank__")
    return rows.join(quotas(df, most, label), label).where("rank__ <= quota").drop("rank__", "n", "quota")


def first_by_place(df: DataFrame, most: int, label: str = "label") -> DataFrame:
    """``quota_sample`` in the order of ``place`` (file, start, line): lines are
    numbered within (class, split of a file), so no task ranks a whole class."""
    rows = ranked(df.withColumn("line__", F.col("place.line")), [label], ["line__"], F.struct("place.file", "place.start"), "rank__")
    return rows.join(quotas(df, most, label), label).where("rank__ <= quota").drop("rank__", "n", "quota", "line__")


def quota_deviation(sample: DataFrame, quota: DataFrame, label: str = "label") -> DataFrame:
    actual = sample.groupBy(label).agg(F.count("*").alias("actual"))
    out = quota.join(actual, label, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("deviation", F.abs(F.col("actual") - F.col("quota")) / F.col("quota"))


def undersample(df: DataFrame, seed: int, identity: str, label: str = "label", classes: int = 2) -> DataFrame:
    """Every class cut to the size of the smallest, in shuffled order; unchanged
    if they are balanced or a class is missing."""
    least = label_counts(df, label).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
    keep_all = (F.col("lo") >= BALANCED * F.col("hi")) | (F.col("k") < classes)
    rows = shuffled(df, [label], seed, identity, "rank__").join(F.broadcast(least))
    return rows.where(keep_all | (F.col("rank__") <= F.col("lo"))).drop("rank__", "lo", "hi", "k")


def stratified_split(df: DataFrame, train: float, validation: float, test: float, seed: int, identity: str, label: str = "label") -> DataFrame:
    """Adds ``split``: of each class, shuffled, the first share is train, the
    next validation and the rest test.

    The order is numbered on label and identity alone; what the other columns
    meet is the last place of each part (two a class), so wide rows stay put."""
    if abs(train + validation + test - 1) > 1e-6 or min(train, validation, test) < 0:
        raise ValueError("ratios must not be negative and must sum to 1")
    counts = label_counts(df, label).where(F.col(label).isNotNull())
    rows = shuffled(df.select(label, identity), [label], seed, identity, "rank__").join(F.broadcast(counts), label)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * validation)
    place = F.struct(shuffle_key(seed, F.col(identity)).alias("key"), F.col(identity).alias("id"))
    last = rows.groupBy(label).agg(*(F.max(F.when(F.col("rank__") == at, place)).alias(name) for name, at in (("train__", a), ("validation__", a + b))))
    split = F.when(place <= F.col("train__"), "train").when(place <= F.col("validation__"), "validation").otherwise("test")
    return df.join(F.broadcast(last), label).withColumn("split", split).drop("train__", "validation__")


def folds(df: DataFrame, k: int, seed: int, identity: str, label: str = "label") -> DataFrame:
    """Adds ``fold`` from 0 to k - 1, dealt in turn over each shuffled class."""
    if k < 2:
        raise ValueError("k must be at least 2")
    rows = shuffled(df, [label], seed, identity, "rank__")
    return rows.withColumn("fold", ((F.col("rank__") - 1) % k).cast("int")).drop("rank__")


def cross_validation(df: DataFrame, k: int) -> DataFrame:
    """Each row of ``folds`` in each of k rounds, as test in its own fold and as
    train in the others."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("round")
    return df.select("*", rounds).withColumn("split", F.when(F.col("fold") == F.col("round"), "test").otherwise("train"))


def stratification(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Shares of the labels in every split and in all rows (``original``)."""
    counts = df.rollup(label, split).agg(F.count("*").alias("n"), F.grouping(split).alias("g"), F.grouping(label).alias("h")).where("h = 0")
    counts = counts.select(F.when(F.col("g") == 1, "original").otherwise(F.col(split)).alias("split"), F.col(label).alias("label"), "n")
    totals = counts.groupBy("split").agg(F.sum("n").alias("total"))
    return counts.join(totals, "split").select("split", "label", "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def leaks(df: DataFrame, identity: str, split: str = "split") -> DataFrame:
    """Ids that stand in more than one split."""
    return df.groupBy(identity).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def seeded_sample(df: DataFrame, n: int, seed: int, identity: str) -> DataFrame:
    return df.orderBy(shuffle_key(seed, F.col(identity)), identity).limit(n)


def checksum(df: DataFrame, columns: list[str], groups: list[Column]) -> DataFrame:
    """An order-free content hash per group: row hashes are sorted and hashed
    within 4096 buckets, then the buckets' hashes."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(*groups, row.alias("row__"))
    names = [c for c in rows.columns if c != "row__"]
    hashed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    buckets = rows.groupBy(*names, F.substring("row__", 1, 3).alias("bucket__")).agg(hashed("row__").alias("own__"), F.count("*").alias("n__"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket__", "own__"))), lambda x: x["own__"]), "")
    return buckets.groupBy(*names).agg(F.sum("n__").alias("rows"), F.sha2(ordered, 256).alias("checksum"))


LANES = 4


def multiset(df: DataFrame, columns: list[str], groups: list[Column]) -> DataFrame:
    """(groups, rows, s0 to s3): an order-free hash of each group's rows, repeats
    included. The hash of a row is four numbers of 60 bits, and a group's is
    their sums, so parts merge by adding up and no list of rows is ever held."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(*groups, row.alias("row__"))
    lane = lambda i: F.conv(F.substring("row__", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    names = [c for c in rows.columns if c != "row__"]
    return rows.groupBy(*names).agg(F.count("*").alias("rows"), *(F.sum(lane(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(LANES)))


def merged(sums: DataFrame, groups: list[str]) -> DataFrame:
    """``multiset`` of larger groups from those of their parts."""
    return sums.groupBy(*groups).agg(F.sum("rows").alias("rows"), *(F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(LANES)))


def digest() -> Column:
    """The checksum of a row of ``multiset``."""
    return F.sha2(F.concat_ws(":", "rows", *[F.col(f"s{i}").cast("string") for i in range(LANES)]), 256)
