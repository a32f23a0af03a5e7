"""Naive Bayes with a normal distribution per class and term, in closed form.

A row holds few of the terms. The terms that it lacks count as zeros, which is
told by each class's number of rows alone: sums and squares come from the rows
that hold a term, and a row's score starts from that of the row without any term
and adds what its own terms change. No zero is ever written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The smallest deviation, a sixth of the step between the values 0 and 1.
LEAST = 1 / 6


def fit(rows: DataFrame, counts: DataFrame, vocab: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, term, mean, sd, base): ``rows`` has (label, term, x), one per row
    and term; ``counts`` (label, n) over all rows, with those without a term;
    ``vocab`` (term). ``base`` is the log likelihood of a zero, up to a constant."""
    sums = rows.join(vocab.select("term"), "term", "left_semi").groupBy("label", "term").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    grid = vocab.select("term").join(F.broadcast(counts.select("label", "n")))  # a row for each class, few
    out = grid.join(sums, ["label", "term"], "left").na.fill(0.0, ["s", "ss"])
    out = out.withColumn("mean", F.col("s") / F.col("n"))
    out = out.withColumn("sd", F.greatest(F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(least)))
    return out.select("label", "term", "mean", "sd", (-F.log("sd") - F.col("mean") * F.col("mean") / (2 * F.col("sd") * F.col("sd"))).alias("base"))


def score(model: DataFrame, counts: DataFrame, df: DataFrame, rows: DataFrame, identity: str = "id") -> DataFrame:
    """(identity, label, score, prob) for each row of ``df`` and class; ``rows``
    has (identity, term, x) of the same rows."""
    prior = priors(counts)
    zero = model.groupBy("label").agg(F.sum("base").alias("zero"))
    gain = (2 * F.col("x") * F.col("mean") - F.col("x") * F.col("x")) / (2 * F.col("sd") * F.col("sd"))
    own = rows.join(model, "term").groupBy(identity, "label").agg(F.sum(gain).alias("gain"))
    start = zero.join(prior, "label").select("label", (F.col("zero") + F.col("prior")).alias("start"))
    out = df.select(identity).join(F.broadcast(start)).join(own, [identity, "label"], "left")
    out = out.withColumn("score", F.col("start") + F.coalesce("gain", F.lit(0.0))).select(identity, "label", "score")
    row = Window.partitionBy(identity)  # a row for each class, few
    out = out.withColumn("part", F.exp(F.col("score") - F.max("score").over(row)))
    return out.select(identity, "label", "score", (F.col("part") / F.sum("part").over(row)).alias("prob"))


def priors(counts: DataFrame) -> DataFrame:
    """(label, prior): the classes' log shares, one row added to each."""
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total)).select("label", F.log((F.col("n") + 1) / (F.col("rows") + F.col("classes"))).alias("prior"))
