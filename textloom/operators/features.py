"""Vocabularies, mutual information and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import let
from .quantiles import quantiles, values_of


def term_rows(df: DataFrame, identity: str, terms: Column, *keep: str) -> DataFrame:
    """(identity, term, keep...): each term once per row of ``df``."""
    return df.select(identity, *keep, F.explode(F.array_distinct(terms)).alias("term")).where("term <> ''")


def vocab_counts(df: DataFrame, terms: Column) -> DataFrame:
    """(term, tf, df): occurrences and rows with the term.

    One pass: a row's terms are put in order, so each knows whether it is the
    first of its kind there, and one grouped sum gives both counts."""
    first = lambda a: F.transform(a, lambda x, i: F.struct(x.alias("term"), (~x.eqNullSafe(F.get(a, i - 1))).alias("first")))
    rows = df.select(F.explode(let(F.array_sort(terms), first)).alias("t")).select("t.*").where("term <> ''")
    return rows.groupBy("term").agg(F.count("*").alias("tf"), F.count_if("first").alias("df"))


def mutual_information(rows: DataFrame, label_counts: DataFrame, label: str = "label") -> DataFrame:
    """(term, mi) in nats between a term's presence and the class.

    ``rows``: (term, label), one per row and distinct term; ``label_counts``:
    (label, n) over all rows. One aggregation; the four cells are closed form."""
    both = rows.groupBy("term", label).agg(F.count("*").alias("n_tc"))
    per_term = both.groupBy("term").agg(F.sum("n_tc").alias("n_t"))
    total = label_counts.agg(F.sum("n").alias("total"))
    grid = per_term.join(F.broadcast(label_counts.select(label, F.col("n").alias("n_c")))).join(F.broadcast(total))
    cells = grid.join(both, ["term", label], "left").withColumn("n_tc", F.coalesce("n_tc", F.lit(0)))
    n, t, c, tc = (F.col(x).cast("double") for x in ("total", "n_t", "n_c", "n_tc"))
    part = lambda own, p, q: F.when(own > 0, own / n * F.log(own * n / (p * q))).otherwise(0.0)
    cells = cells.withColumn("part", part(tc, t, c) + part(c - tc, n - t, c))
    return cells.groupBy("term").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mi"))


def top_terms(vocab: DataFrame, k: int, by: str = "mi") -> DataFrame:
    return vocab.orderBy(F.desc(by), "term").limit(k)


def top_terms_per_class(rows: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The most frequent terms of each class, ties by term."""
    counts = rows.groupBy(label, "term").agg(F.count("*").alias("n"))
    own = Window.partitionBy(label).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def tf_idf(df: DataFrame, identity: str, terms: Column, vocab: DataFrame) -> DataFrame:
    """(identity, term, weight): ln(1 + tf) * ln((N + 1) / (df + 1)) of the
    vocabulary's terms."""
    counts = df.select(identity, F.explode(terms).alias("term")).join(vocab.select("term"), "term", "left_semi")
    counts = counts.groupBy(identity, "term").agg(F.count("*").alias("tf"))
    found = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    weight = F.log1p("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    return counts.join(found, "term").join(F.broadcast(n)).select(identity, "term", weight.alias("weight"))


def vocab_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared terms, terms of the first, their ratio."""
    both = a.select("term").distinct().join(b.select("term", F.lit(1).alias("hit")).distinct(), "term", "left")
    return both.agg(F.count("hit").alias("shared"), F.count("*").alias("total")).withColumn("ratio", F.try_divide(F.col("shared").cast("double"), F.col("total")))


def linear_scores(df: DataFrame, identity: str, terms: Column, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(identity, score): the summed weights of a row's distinct terms."""
    rows = term_rows(df, identity, terms).join(weights, "term")
    sums = rows.groupBy(identity).agg(F.sum("weight").alias("s"))
    return df.select(identity).join(sums, identity, "left").select(identity, (F.coalesce("s", F.lit(0.0)) + bias).alias("score"))


def weight_stats(weights: DataFrame) -> DataFrame:
    """Mean, population deviation, median and 95th percentile of |weight|."""
    w = values_of(weights, F.abs("weight"))
    median, p95 = quantiles(w, [0.5, 0.95])
    out = w.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))
    return out.select("mean", "std", F.lit(median).cast("double").alias("median"), F.lit(p95).cast("double").alias("p95"), "n")


def weight_floor(weights: DataFrame) -> DataFrame:
    """The same with the element at ⌊0.95 (n - 1)⌋ of the order as percentile; no
    row without weights."""
    w = values_of(weights, F.abs("weight"))
    (p95,) = quantiles(w, [0.95], between=False)
    out = w.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n")).where("n > 0")
    return out.select("mean", "std", F.lit(p95).cast("double").alias("p95"), "n")
