"""Service metrics and drift of logged predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles, values_of

# Cut-offs of the monitor.
LOW_CONFIDENCE = 0.6
WARNING, CRITICAL = 0.1, 0.25
FLOOR = 1e-4
RESET = 10_001
LABELS = ("positive", "negative")


def prediction_totals(df: DataFrame) -> DataFrame:
    """Totals per label, low-confidence rate, mean confidence and mean latency."""
    n = F.count("*")
    of = lambda label: F.count_if(F.lower("predicted_label") == label)
    return df.agg(
        n.alias("total"), of("positive").alias("positive"), of("negative").alias("negative"), of("uncertain").alias("uncertain"),
        F.try_divide(100.0 * F.count_if(F.col("confidence") < LOW_CONFIDENCE), n).alias("low_confidence_rate"), F.avg("confidence").alias("mean_confidence"),
        F.avg("processing_time_ms").alias("latency_mean"),
    )


def percentiles(df: DataFrame, value: Column, names: dict[str, float]) -> dict[str, Column]:
    """Exact percentiles as named constants."""
    found = quantiles(values_of(df, value), list(names.values()))
    return {name: F.lit(x).cast("double") for name, x in zip(names, found, strict=True)}


def prediction_metrics(df: DataFrame) -> DataFrame:
    """``prediction_totals`` and exact percentiles of the latency."""
    return prediction_totals(df).withColumns(percentiles(df, F.col("processing_time_ms"), {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}))


def confidence_summary(df: DataFrame) -> DataFrame:
    found = percentiles(df, F.col("confidence") * 100, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return df.sparkSession.range(1).select(*[c.alias(name) for name, c in found.items()])


def reference_window(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each model by arrival. The constant bound lets each
    task keep n rows per model before the exchange."""
    own = Window.partitionBy("model_version").orderBy("ts", "event_id")
    return df.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= n).drop("rn")


def comparison_window(df: DataFrame, n: int, m: int) -> DataFrame:
    """The last m rows of each model after its first n."""
    last = Window.partitionBy("model_version").orderBy(F.desc("ts"), F.desc("event_id"))
    tail = df.withColumn("back", F.row_number().over(last)).where(F.col("back") <= m)
    sizes = df.groupBy("model_version").agg(F.count("*").alias("size"))
    return tail.join(sizes, "model_version").where(F.col("size") - F.col("back") >= n).drop("back", "size")


def label_shares(df: DataFrame, *groups: str) -> DataFrame:
    """(groups, key, share) of the labels, the two main ones always listed."""
    n = df.groupBy(*groups, F.lower("predicted_label").alias("key")).agg(F.count("*").alias("n"))
    every = df.select(*groups).distinct().select(*groups, F.explode(F.array(*map(F.lit, LABELS))).alias("key"))
    n = n.join(every, [*groups, "key"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = n.groupBy(*groups).agg(F.sum("n").alias("total"))
    return n.join(total, list(groups)).select(*groups, "key", safe_share().alias("share"))


def safe_share() -> Column:
    return F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total")), F.lit(0.0))


def confidence_shares(df: DataFrame, buckets: int, *groups: str) -> DataFrame:
    """(groups, key, share): a histogram of equal buckets, the last closed."""
    at = F.least(F.floor(F.col("confidence") * buckets), F.lit(buckets - 1)).cast("int")
    n = df.groupBy(*groups, at.alias("key")).agg(F.count("*").alias("n"))
    every = df.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("key"))
    n = every.join(n, [*groups, "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = n.groupBy(*groups).agg(F.sum("n").alias("total"))
    return n.join(total, list(groups)).select(*groups, "key", safe_share().alias("share"))


def psi(expected: DataFrame, actual: DataFrame, *groups: str) -> DataFrame:
    """(groups, psi): population stability index over the union of the keys."""
    keys = [*groups, "key"]
    both = expected.select(*keys, F.col("share").alias("e")).join(actual.select(*keys, F.col("share").alias("a")), keys, "full")
    e, a = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(FLOOR)) for x in ("e", "a"))
    return both.groupBy(*groups).agg(F.greatest(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def status(prediction: Column, confidence: Column, ready: Column) -> Column:
    worst = F.greatest(prediction, confidence)
    return F.when(~ready, "not_ready").when(worst >= CRITICAL, "critical").when(worst >= WARNING, "warning").otherwise("healthy")


def drift(df: DataFrame, n: int, m: int, buckets: int = 10) -> DataFrame:
    """One row per model: both indices, the sizes and the status."""
    a, b = reference_window(df, n), comparison_window(df, n, m)
    key = "model_version"
    labels = psi(label_shares(a, key), label_shares(b, key), key).withColumnRenamed("psi", "prediction_psi")
    confidence = psi(confidence_shares(a, buckets, key), confidence_shares(b, buckets, key), key).withColumnRenamed("psi", "confidence_psi")
    sizes = a.groupBy(key).agg(F.count("*").alias("reference_size")).join(b.groupBy(key).agg(F.count("*").alias("comparison_size")), key, "left")
    out = sizes.na.fill(0, ["comparison_size"]).join(labels, key).join(confidence, key)
    ready = (F.col("reference_size") >= n) & (F.col("comparison_size") >= m // 2)
    return out.withColumn("status", status(F.col("prediction_psi"), F.col("confidence_psi"), ready))


def rolling_confidence(df: DataFrame, reset: int = RESET) -> DataFrame:
    """Adds the running mean confidence of each model, which starts anew at
    every ``reset``-th observation (and is 0 there)."""
    from .ranks import ranked

    rows = ranked(df, ["model_version"], ["ts", "event_id"], F.to_date("ts"), "rn")
    rows = rows.withColumn("run", F.floor(F.col("rn") / reset)).withColumn("head", F.col("rn") % reset == 0)
    own = Window.partitionBy("model_version", "run").orderBy("rn")
    value = F.when(F.col("head"), 0.0).otherwise(F.col("confidence"))
    one = F.when(F.col("head"), 0).otherwise(1)
    mean = F.coalesce(F.try_divide(F.sum(value).over(own), F.sum(one).over(own)), F.lit(0.0))
    return rows.withColumn("rolling", mean).drop("run", "head")
