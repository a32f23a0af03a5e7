"""Sources, sampling, quality and features on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from textloom import adapters
from textloom.operators import features, quality, sampling
from textloom.sources import labeled, predictions


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def load(spark, path):
    return [(r.text, r.label) for r in labeled.load(labeled.read_csv(spark, path)).collect()]


def test_labelled_files(spark, tmp_path):
    one = write(tmp_path / "a.csv", 'text,sentiment\n"Great, with comma",positive\nThis is terrible,negative\n,positive\nodd,invalid_label\n')
    assert sorted(load(spark, one)) == [("Great, with comma", "positive"), ("This is terrible", "negative")]
    two = write(tmp_path / "b.tsv", "review\tRATING\nA\t5.0\nB\t1.0\nC\t3.0\nD\t4.0\nE\t2.0\n")
    assert sorted(load(spark, two)) == [("A", "positive"), ("B", "negative"), ("D", "positive"), ("E", "negative")]
    for text in ("sentiment,other\npositive,x\n", "text\nonly\n"):
        with pytest.raises(ValueError):
            load(spark, write(tmp_path / "c.csv", text))
    with pytest.raises(ValueError):
        load(spark, write(tmp_path / "d.csv", "text,label\nx,what\n"))
    with pytest.raises(ValueError):
        labeled.read_csv(spark, str(tmp_path / "x.xlsx"))
    reasons = [r.reject_reason for r in labeled.rejected(labeled.read_csv(spark, one)).collect()]
    assert sorted(reasons) == ["empty_text", "unknown_label"]


def test_round_trip(spark, tmp_path):
    rows = [('has "quotes", and\nlines', "positive"), ("plain", "negative")]
    labeled.write_csv(spark.createDataFrame(rows, "text string, label string"), str(tmp_path / "out"))
    got = labeled.read_csv(spark, str(tmp_path / "out"), ",")
    assert sorted((r.text, r.raw_label) for r in got.collect()) == sorted(rows)


def test_prediction_log(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-05 10:00:00' AS ts, 'h' AS text_hash, 5 AS text_length, 'positive' AS predicted_label, 0.5D AS confidence, 7L AS processing_time_ms, 'm' AS model_version")
    predictions.write(df, str(tmp_path / "log"))
    assert predictions.read(spark, str(tmp_path / "log")).select(*df.columns).collect() == df.collect()
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-20')) AS dt")
    assert predictions.expired(days, F.lit("2024-01-20").cast("date")).count() == 12


def samples(spark, positive, negative):
    rows = [(i, f"text {i}", "positive") for i in range(positive)] + [(1000 + i, f"other {i}", "negative") for i in range(negative)]
    return spark.createDataFrame(rows, "id long, text string, label string")


@pytest.mark.parametrize(("given", "want"), [((100, 50), (50, 50)), ((50, 50), (50, 50)), ((100, 96), (100, 96)), ((10, 0), (10, 0))])
def test_undersample(spark, given, want):
    got = {r.label: r["count"] for r in sampling.undersample(samples(spark, *given), 42, "id").groupBy("label").count().collect()}
    assert (got.get("positive", 0), got.get("negative", 0)) == want


def test_splits(spark):
    df = samples(spark, 80, 20)
    split = sampling.stratified_split(df, 0.7, 0.15, 0.15, 1, "id").cache()
    assert split.count() == 100 and sampling.leaks(split, "id").count() == 0
    n = {(r.split, r.label): r.n for r in sampling.stratification(split).collect()}
    assert n["train", "positive"] == 56 and n["validation", "negative"] == 3 and n["test", "positive"] == 12 and n["original", "negative"] == 20
    folds = sampling.folds(df, 5, 1, "id")
    assert {r["count"] for r in folds.groupBy("fold", "label").count().collect()} == {16, 4}
    rounds = sampling.cross_validation(folds, 5)
    assert rounds.count() == 500 and rounds.where("split = 'test'").count() == 100
    for bad in ((0.5, 0.1, 0.1), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            sampling.stratified_split(df, *bad, 1, "id")
    with pytest.raises(ValueError):
        sampling.folds(df, 1, 1, "id")
    a = sampling.checksum(split, ["id"], [F.col("split")]).collect()
    b = sampling.checksum(split.orderBy(F.desc("id")), ["id"], [F.col("split")]).collect()
    assert sorted(a) == sorted(b)


def test_quota(spark):
    df = samples(spark, 90, 10)
    got = sampling.quota_sample(df, 20, "id")
    assert {(r.label, r["count"]) for r in got.groupBy("label").count().collect()} == {("positive", 18), ("negative", 2)}
    assert got.where("label = 'positive'").agg(F.max("id")).first()[0] == 17


def test_quality(spark):
    rows = [("same text", "positive"), ("same text", "negative"), ("a great film", "negative"), ("what an awful film", "positive"), ("great but bad", "positive")]
    df = spark.createDataFrame(rows, "text string, label string")
    assert quality.duplicates(df).first().duplicates == 1
    assert quality.duplicate_rate(df).first()[0] == pytest.approx(0.2)
    assert quality.label_inconsistency(df).first()[0] == pytest.approx(0.25)
    noise = quality.label_noise(df).first()
    assert (noise.suspicious, noise.sample_size) == (2, 5)
    assert quality.label_noise(df.limit(0)).first().noise_rate is None
    assert quality.length_stats(df).first().median_length == 12


def test_mutual_information(spark):
    rows = [(1, "a b", "p"), (2, "a c", "p"), (3, "b c", "n"), (4, "c", "n")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    terms = features.term_rows(df, "id", F.split("text", " "), "label")
    got = {r.term: r.mi for r in features.mutual_information(terms, sampling.label_counts(df)).collect()}
    assert got["a"] == pytest.approx(math.log(2)) and got["b"] == pytest.approx(0)
    c = 0.25 * math.log(0.25 / (0.75 * 0.5)) + 0.5 * math.log(0.5 / (0.75 * 0.5)) + 0.25 * math.log(0.25 / (0.25 * 0.5))
    assert got["c"] == pytest.approx(c)
    vocab = {r.term: (r.tf, r.df) for r in features.vocab_counts(df, F.split("text", " ")).collect()}
    odd = spark.createDataFrame([(["b", None, "a", "b", ""],), (None,), ([],), (["b"],)], "terms array<string>")
    assert {r.term: (r.tf, r.df) for r in features.vocab_counts(odd, F.col("terms")).collect()} == {"a": (1, 1), "b": (3, 2)}
    assert vocab == {"a": (2, 2), "b": (2, 2), "c": (3, 3)}


def test_texts_are_not_shuffled_to_meet_their_labels(spark, sf_dir, monkeypatch):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as where labels are beyond Spark's own limit
    try:
        plans, rows = [], []
        for most in (adapters.NARROW, 0):
            monkeypatch.setattr(adapters, "NARROW", most)
            own = adapters.Tables(spark, sf_dir).samples
            plans.append(own._jdf.queryExecution().sparkPlan().toString())
            rows.append(sorted(map(tuple, own.collect())))
    finally:
        spark.conf.set(limit, before)
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert rows[0] == rows[1] and rows[0]
