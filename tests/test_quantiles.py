"""Exact order statistics, mergeable checksums and influence by zeroing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import features, quantiles, sampling
from textloom.plans import models, workflow


@pytest.mark.parametrize("small", [50_000, 200, 1])
def test_quantiles_equal_the_sorted_values(spark, monkeypatch, small):
    """Heavy tails, one value in a third of all rows, both signs, infinities."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = random.Random(3)
    xs = [math.exp(rng.gauss(0, 40)) * rng.choice((1, 1, -1)) for _ in range(6000)] + [7.5] * 3000 + [math.inf, -math.inf, 0.0, -0.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "v double").repartition(7)
    fractions = [0.0, 0.003, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]
    values, ordered = quantiles.values_of(df, F.col("v")), sorted(xs)
    assert quantiles.quantiles(values, fractions, between=False) == [ordered[math.floor(f * (len(xs) - 1))] for f in fractions]
    got = quantiles.quantiles(values, fractions[1:-1])
    assert np.allclose(got, [np.quantile(ordered, f) for f in fractions[1:-1]], rtol=1e-12)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "weight double")
    assert quantiles.quantiles(quantiles.values_of(df, F.col("weight")), [0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0]
    assert tuple(features.weight_stats(df.limit(0)).first()) == (None, None, None, None, 0)
    assert features.weight_floor(df.limit(0)).count() == 0
    assert features.weight_floor(df.where("weight = 3")).first().p95 == 3.0


def test_multisets_merge_and_see_repeats(spark):
    rows = [(i, "positive" if i % 3 else "negative", f"s{i % 4}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string, part string")
    whole = lambda d: sampling.multiset(d, ["id", "label"], [F.lit("x").alias("split")]).select("rows", sampling.digest()).first()
    own = whole(df)
    parts = sampling.multiset(df.repartition(9), ["id", "label"], [F.lit("x").alias("split"), "part"])
    assert sampling.merged(parts, ["split"]).select("rows", sampling.digest()).first() == own
    assert whole(df.orderBy(F.desc("id"))) == own
    assert whole(df.union(df.limit(1))) != own and whole(df.withColumn("label", F.lit(None).cast("string"))) != own


def test_a_changed_byte_is_found(spark, tmp_path):
    rows = [(i, f"text {i}", "positive" if i % 2 else "negative") for i in range(300)]
    at = f"file://{tmp_path}/set"
    workflow.prepare(spark.createDataFrame(rows, "id long, text string, label string").repartition(3), at, "all")
    good = {r.split: tuple(r)[2:] for r in workflow.verify(spark, at).collect()}
    assert good == {"train": (True, True), "test": (True, True)}
    file = next((tmp_path / "set/parts/split=test").glob("part-*"))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    data = bytearray(file.read_bytes())
    place = data.index(b"text ")  # inside a value: the file can still be read, its ids and labels are the same
    data[place] ^= 1
    file.write_bytes(data)
    bad = {r.split: tuple(r)[2:] for r in workflow.verify(spark, at).collect()}
    assert bad["train"] == (True, True) and not bad["test"][0]
    file.unlink()
    gone = {r.split: tuple(r)[2:] for r in workflow.verify(spark, at).collect()}
    assert gone["train"] == (True, True) and gone["test"] == (False, False)


@pytest.mark.parametrize("algorithm", ["logistic_regression", "random_forest"])
def test_influence_is_the_models_own(spark, algorithm):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(25)]
    rows = []
    for i in range(160):
        good = i % 2
        words = rng.sample(vocab, 6) + (["good"] if good and rng.random() < 0.8 else ["poor"] if rng.random() < 0.7 else [])
        rows.append((i, words + words[:2] + ["unseen%d" % i] * (i > 120), float(good), "positive" if good else "negative"))
    df = spark.createDataFrame(rows, "id long, terms array<string>, y double, label string")
    model = models.fit(df, algorithm, features=20, trees=8, depth=4)
    got = {r.term: r.influence for r in models.zeroing_influence(model, df, most=40).collect()}
    sample = [r.id for r in sampling.seeded_sample(df, 40, models.SEED, "id").collect()]
    terms, width = models.vocabulary(model), len(models.vocabulary(model))
    assert set(got) == set(terms) and len(sample) == 40
    # brute force on vectors: each entry set to zero, judged by the fitted classifier alone
    last = model.stages[-1]
    vectors = {r.id: r.features for r in model.transform(df).where(F.col("id").isin(sample)).select("id", "features").collect()}
    top = lambda v: max(last.predictProbability(v))
    from pyspark.ml.linalg import Vectors

    want = dict.fromkeys(terms, 0.0)
    for v in vectors.values():
        x = v.toArray()
        for k in np.flatnonzero(x).tolist():
            y = x.copy()
            y[k] = 0.0
            want[terms[k]] += abs(top(Vectors.dense(x)) - top(Vectors.sparse(width, {int(i): float(y[i]) for i in np.flatnonzero(y)}))) / len(vectors)
    assert max(abs(got[w] - want[w]) for w in terms) < 1e-9
    assert got["good"] > np.median(list(got.values()))
