"""Classifier metrics from long tables of (actual, predicted, probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, *groups: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*groups, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, *groups: str) -> DataFrame:
    """(groups, class, precision, recall, f1, support) from ``confusion``."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    by_actual = matrix.groupBy(*groups, F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_predicted = matrix.groupBy(*groups, F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    out = by_actual.join(by_predicted, [*groups, "class"], "full").na.fill(0, ["support", "tp", "called"])
    out = out.withColumn("precision", safe(F.col("tp"), F.col("called"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    f1 = safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*groups, "class", "precision", "recall", f1.alias("f1"), "support")


def averages(metrics: DataFrame, matrix: DataFrame, *groups: str) -> DataFrame:
    """Macro and support-weighted precision, recall, F1, and accuracy."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(m).alias(f"macro_{m}") for m in names]
    weighted = [safe(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in names]
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    accuracy = matrix.groupBy(*groups).agg(safe(F.sum(hit), F.sum("n")).alias("accuracy"))
    out = metrics.groupBy(*groups).agg(*macro, *weighted)
    return out.join(accuracy, list(groups)) if groups else out.join(F.broadcast(accuracy))


def kappa(matrix: DataFrame) -> DataFrame:
    """Cohen's kappa with the counts of correct and incorrect rows."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    total = matrix.agg(F.sum("n").alias("total"), F.sum(hit).alias("correct"))
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("a"))
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "class").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    out = total.join(F.broadcast(chance))
    po, pe = F.col("correct") / F.col("total"), F.col("ab") / (F.col("total") * F.col("total"))
    return out.select("correct", (F.col("total") - F.col("correct")).alias("incorrect"), safe(po - pe, 1 - pe).alias("kappa"))


def roc_auc(df: DataFrame, prob: str = "prob", y: str = "y", steps: int = 1024) -> DataFrame:
    """Area under the ROC curve, ties counted half (Mann-Whitney).

    Rows are summed per score first; scores are ordered inside ``steps`` buckets
    of the unit interval, so no task orders all of them."""
    per = df.groupBy(F.col(prob).alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    per = per.withColumn("bucket", F.floor(F.col("p") * steps))
    buckets = per.groupBy("bucket").agg(F.sum("neg").alias("bucket_neg"))
    lower = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("bucket", F.coalesce(F.sum("bucket_neg").over(lower), F.lit(0.0)).alias("below"))
    own = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("inside", F.coalesce(F.sum("neg").over(own), F.lit(0.0))).join(F.broadcast(buckets), "bucket")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2))
    return per.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def pr_auc(df: DataFrame, *groups: str, prob: str = "prob", y: str = "y", steps: int = 1024) -> DataFrame:
    """(groups, pr_auc): area under precision over recall, exact: a point for each
    score, joined by straight lines, starting at the first point's precision.

    Rows are summed per score first; scores are ordered inside ``steps`` buckets
    of the unit interval, so no task orders all of them. A probability of null
    is left out; without positive rows the area is null."""
    per = df.where(F.col(prob).isNotNull()).groupBy(*groups, F.col(prob).alias("p"))
    per = per.agg(F.sum(y).cast("double").alias("pos"), F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("p") * steps))
    higher = Window.partitionBy(*groups).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*groups, "bucket").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    buckets = per.groupBy(*groups, "bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    buckets = buckets.select(*groups, "bucket", before("pos", higher).alias("pos_above"), before("n", higher).alias("n_above"))
    per = per.withColumns({"pos_before": before("pos", own), "n_before": before("n", own)})
    per = per.join(F.broadcast(buckets), [*groups, "bucket"])  # at most ``steps`` and one for each group
    hits, called = F.col("pos_above") + F.col("pos_before"), F.col("n_above") + F.col("n_before")
    here = (hits + F.col("pos")) / (called + F.col("n"))
    area = F.sum(F.col("pos") * (here + F.coalesce(F.try_divide(hits, called), here)) / 2)
    return per.groupBy(*groups).agg(F.try_divide(area, F.sum("pos")).alias("pr_auc"))


def smooth(probabilities: Column, least: float = 0.001) -> Column:
    """Clamp to [least, 1 - least] and divide by the sum."""
    from ..functions.basic import let

    clamped = F.transform(probabilities, lambda p: F.least(F.greatest(p, F.lit(least)), F.lit(1 - least)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return let(clamped, lambda a: F.transform(a, lambda p: p / total(a)))


def cross_domain(df: DataFrame, algorithm: str, train: str, test: str) -> DataFrame:
    """(algorithm, train, test): accuracy, macro metrics, Brier score and rows."""
    keys = [algorithm, train, test]
    matrix = confusion(df, *keys)
    out = averages(class_metrics(matrix, *keys), matrix, *keys)
    brier = df.groupBy(*keys).agg(F.avg((F.col("prob") - F.col("y")) ** 2).alias("brier"), F.count("*").alias("test_samples"))
    out = out.join(brier, keys).withColumn("in_domain", F.col(train) == F.col(test))
    return out.select(*keys, "accuracy", "macro_f1", "macro_precision", "macro_recall", "brier", "test_samples", "in_domain")


def cross_domain_average(matrix: DataFrame, algorithm: str = "algorithm", train: str = "train_domain") -> DataFrame:
    return matrix.groupBy(algorithm, train).agg(F.avg(F.when(~F.col("in_domain"), F.col("accuracy"))).alias("mean_other"))


def best_model(average: DataFrame, algorithm: str = "algorithm", train: str = "train_domain") -> DataFrame:
    """The model of the highest mean; ties go to the first by name."""
    return average.orderBy(F.desc("mean_other"), algorithm, train).limit(1)
