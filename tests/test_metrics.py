"""Evaluation, calibration, monitoring, streams and models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import calibration, evaluation, features, monitoring


def test_classifier_metrics(spark):
    cells = [("N", "N", 80), ("N", "P", 20), ("P", "N", 15), ("P", "P", 85)]
    matrix = spark.createDataFrame(cells, "actual string, predicted string, n long")
    m = {r["class"]: r for r in evaluation.class_metrics(matrix).collect()}
    assert m["P"].precision == pytest.approx(85 / 105) and m["P"].recall == pytest.approx(0.85) and m["N"].support == 100
    a = evaluation.averages(evaluation.class_metrics(matrix), matrix).first()
    assert a.accuracy == pytest.approx(0.825) and a.macro_recall == pytest.approx(0.825)
    k = evaluation.kappa(matrix).first()
    assert (k.correct, k.incorrect, round(k.kappa, 6)) == (165, 35, 0.65)


def test_auc(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.9, 1), (0.95, 0)]
    df = spark.createDataFrame(rows, "prob double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df).first().auc == pytest.approx(want)
    assert evaluation.roc_auc(df, steps=2).first().auc == pytest.approx(want)


def test_pr_auc_against_plain_points(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 0.1, 0.25, 0.5, 0.75, 1.0, rng.random()]), int(rng.random() < 0.4)) for g in "ab" for _ in range(80)]
    df = spark.createDataFrame([*rows, ("a", None, 1), ("none", 0.5, 0)], "g string, prob double, y int")
    for steps in (1, 3, 1024):
        got = {r.g: r.pr_auc for r in evaluation.pr_auc(df, "g", steps=steps).collect()}
        for g in "ab":
            own = [(p, y) for x, p, y in rows if x == g]
            points = []
            for cut in sorted({p for p, _ in own}, reverse=True):
                called = [y for p, y in own if p >= cut]
                points.append((sum(called) / sum(y for _, y in own), sum(called) / len(called)))
            points = [(0.0, points[0][1]), *points]
            assert got[g] == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])))
        assert got["none"] is None


def test_calibration(spark):
    df = lambda *rows: spark.createDataFrame(rows, "prob double, y int")
    assert calibration.brier(df(*[(0.0, 1)] * 3, *[(1.0, 0)] * 3)).first()[0] == 1
    assert calibration.brier(df(*[(0.5, 0)] * 2, *[(0.5, 1)] * 2)).first()[0] == 0.25
    assert {r.n for r in calibration.bins(df(*[(0.05 + i / 10, 1) for i in range(10)]), 10).collect()} == {1}
    ones = calibration.bins(df((1.0, 1)), 10).orderBy("bin").collect()
    assert [r.n for r in ones] == [0] * 9 + [1]
    e = calibration.errors(calibration.bins(df((0.2, 1), (0.2, 0), (0.9, 1)), 10)).first()
    assert e.ece == pytest.approx((2 * 0.3 + 0.1) / 3) and e.mce == pytest.approx(0.3)
    assert [r.reason for r in calibration.invalid(df((1.5, 1), (0.5, 3), (0.5, 1)), 5).collect()] == ["probability_out_of_range", "label_not_binary"]
    with pytest.raises(ValueError):
        calibration.invalid(df((0.5, 1)), 1)
    three = spark.createDataFrame([([0.7, 0.2, 0.1], 0), ([0.1, 0.8, 0.1], 1), ([0.2, 0.2, 0.6], 2)], "probabilities array<double>, y int")
    assert calibration.multiclass(three, 5).first().ece < 0.3
    p = spark.createDataFrame([([0.0, 1.0],)], "p array<double>").select(evaluation.smooth(F.col("p")).alias("p")).first().p
    assert p == pytest.approx([0.001, 0.999])


def test_weight_stats(spark):
    df = spark.createDataFrame([(str(i), float(i * (-1) ** i)) for i in range(1, 101)], "term string, weight double")
    s = features.weight_stats(df).first()
    assert (s.mean, s.median, round(s.p95, 6)) == (50.5, 50.5, 95.05)
    assert features.weight_floor(df).first().p95 == 95.0


def rows_of(spark, labels, model="m", start=0):
    data = [(start + i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", x, 0.9 if x == "positive" else 0.3, i % 5, model) for i, x in enumerate(labels)]
    df = spark.createDataFrame(data, "event_id long, ts string, predicted_label string, confidence double, processing_time_ms long, model_version string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_prediction_metrics(spark):
    m = monitoring.prediction_metrics(rows_of(spark, ["positive", "negative", "uncertain"])).first()
    assert (m.total, m.positive, m.negative, m.uncertain) == (3, 1, 1, 1) and round(m.low_confidence_rate, 2) == 66.67
    assert m.latency_p99 >= m.latency_p95


def test_psi(spark):
    share = lambda *xs: spark.createDataFrame(list(zip("ab", xs)), "key string, share double")
    assert monitoring.psi(share(0.5, 0.5), share(0.5, 0.5)).first().psi == 0
    want = 0.2 * math.log(1.4) - 0.2 * math.log(0.6)
    assert monitoring.psi(share(0.5, 0.5), share(0.7, 0.3)).first().psi == pytest.approx(want)
    only = spark.createDataFrame([("c", 1.0)], "key string, share double")
    assert monitoring.psi(share(0.5, 0.5), only).first().psi > 5


def test_drift_batch_and_stream(spark, tmp_path):
    from textloom.streaming import jobs

    labels = ["positive", "negative"] * 20 + ["positive"] * 20
    df = rows_of(spark, labels).unionByName(rows_of(spark, ["positive"] * 5, "few", 500))
    batch = {r.model_version: r for r in monitoring.drift(df, 40, 20).collect()}
    assert batch["m"].status == "critical" and batch["few"].status == "not_ready"
    src, out = tmp_path / "in", tmp_path / "out"
    df.orderBy("ts").coalesce(1).write.parquet(str(src))
    stream = jobs.drift(spark.readStream.schema(df.schema).parquet(str(src)), 40, 20)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(out))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    for r in spark.read.parquet(str(out)).collect():
        twin = batch[r.model_version]
        assert r.status == twin.status and (r.reference_size, r.comparison_size) == (twin.reference_size, twin.comparison_size)
        if r.model_version == "m":
            assert r.prediction_psi == pytest.approx(twin.prediction_psi) and r.confidence_psi == pytest.approx(twin.confidence_psi)


def test_drift_rows_of_a_batch_are_bounded(spark):
    from textloom.streaming import jobs

    rng = random.Random(8)
    rows = [(i % 3 and f"m{i % 3}" or None, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", i, rng.choice(["positive", "negative"]), rng.random()) for i in range(3000)]
    rows[1501] = (*rows[1501][:3], "__reset__", 0.0)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "model_version string, ts string, event_id long, predicted_label string, confidence double")
    df = df.withColumn("ts", df.ts.cast("timestamp")).repartition(7)
    want = []
    for model in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == model), key=lambda r: r[1:3])
        cut = max((i for i, r in enumerate(own) if r[3] == "__reset__"), default=-1)
        own = own[max(cut, 0) :]
        n = 40 + (cut >= 0)
        want += [r[2] for r in own[:n] + own[n:][-20:]]
    assert sorted(r.event_id for r in jobs.bounded(df, 40, 20).collect()) == sorted(want)



def test_rolling_confidence_resets(spark):
    got = [r.rolling for r in monitoring.rolling_confidence(rows_of(spark, ["positive"] * 7), 4).orderBy("rn").collect()]
    assert got == pytest.approx([0.9, 0.9, 0.9, 0.0, 0.9, 0.9, 0.9])


def test_models_learn(spark):
    from textloom.plans import models

    texts = [("This is a great product!", "positive"), ("This is terrible!", "negative")] * 25
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "id long, text string, label string")
    rows = models.with_terms(df).cache()
    results = models.train_many(rows, rows, ("svm", "naive_bayes", "logistic_regression", "nothing"), features=100)
    assert [r["status"] for r in results] == ["ok"] * 3 + ["failed"]
    for r in results[:3]:
        out = models.scored(r["model"], rows)
        assert out.where("predicted <> label").count() == 0
        assert out.where("prob < 0 or prob > 1").count() == 0


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_works_without_the_optional_package(tmp_path, with_pipeline):
    """With the training-data folders gone the rest imports and registers, the
    pipeline's file being there or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if with_pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_model_terms_come_from_each_class(spark):
    from textloom.plans import models
    from textloom.queries import learning

    rows = [(float(i % 10 == 0), [f"rare{i % 3}"] if i % 10 == 0 else [f"often{k}" for k in range(5)]) for i in range(100)]
    train = spark.createDataFrame(rows, "y double, terms array<string>")
    model = models.fit(train, "naive_bayes", features=3)
    assert model.stages[0].vocabulary == ["often0", "often1", "often2", "rare0", "rare1", "rare2"]
    assert learning.OPTIONS == {"features": 5000, "trees": 100, "depth": 12}
