"""Grid search, parallel fits, one-scan scoring, normal distributions, places."""

import hashlib
import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import sampling
from textloom.plans import bayes, models, workflow
from textloom.sources import labeled


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(9), []
    for i in range(180):
        good = i % 3 > 0
        words = [f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(9)] + ([rng.choice(["good", "fine"])] if good == (rng.random() < 0.85) else ["poor"])
        out.append((i, words, float(good), "positive" if good else "negative", "ab"[i % 2]))
    return spark.createDataFrame(out, "id long, terms array<string>, y double, label string, domain string").cache()


def test_grid_counts_equal_fold_by_fold_fits(spark, rows):
    grid, folds = (0.01, 1.0), 3
    got = {(r.c, r.fold): tuple(r)[2:] for r in models.grid_search(rows, grid, folds, features=15).collect()}
    dealt = sampling.folds(rows, folds, models.SEED, "id")
    want = {}
    for k in range(folds):
        own, test = models.weighted(dealt.where(F.col("fold") != k)), dealt.where(F.col("fold") == k)
        terms = models.class_terms(own, 15)
        n = own.count()
        for c in grid:
            svm = models.estimator("svm", n).setRegParam(1 / (c * n))
            seen = Pipeline(stages=[*models.vectorizer(terms=terms), svm]).fit(own).transform(test).select("y", "prediction").collect()
            want[c, k] = tuple(sum((r.y, r.prediction) == pair for r in seen) for pair in ((1, 1), (0, 1), (1, 0), (0, 0)))
    assert got == want
    scores = models.grid_scores(models.grid_search(rows, grid, folds, features=15)).collect()
    for r in scores:
        tp, fp, fn, tn = (sum(want[r.c, k][i] for k in range(folds)) for i in range(4))
        f1 = [2 * a / (2 * a + fp + fn) if a else 0.0 for a in (tp, tn)]
        assert abs(r.macro_f1 - sum(f1) / 2) < 1e-12 and abs(r.accuracy - (tp + tn) / 180) < 1e-12
    assert max(scores, key=lambda r: (r.macro_f1, -r.c)).rank == 1


def test_wide_rows_are_not_shuffled_for_a_split(spark, rows):
    plan = models.parted(rows.select("id", "terms", "label"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # A line of the plan lies below a window if it comes later and is indented more.
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = [i for i, line in enumerate(plan) if line.lstrip(" :+-").startswith("Window")]
    assert at
    for i in at:
        for line in plan[i + 1 :]:
            if depth(line) <= depth(plan[i]) or "InMemoryRelation" in line:
                break
            assert "terms" not in line, line
    got = {r.id: r.split for r in models.parted(rows).select("id", "split").collect()}
    want = {}
    for good in (True, False):
        own = sorted((hashlib.md5(f"{models.SEED}:{i}".encode()).hexdigest(), i) for i in range(180) if (i % 3 > 0) == good)
        a, b = int(len(own) * 0.6), int(len(own) * 0.2)
        want |= {i: "train" if n < a else "validation" if n < a + b else "test" for n, (_, i) in enumerate(own)}
    assert got == want


def test_a_class_is_not_ranked_in_one_task(spark, rows):
    import contextlib
    import io

    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("y", "term").count()
    want = sorted({t for y in (0.0, 1.0) for _, t in sorted((-r["count"], r.term) for r in counts.where(F.col("y") == y).collect())[:1500]})
    assert models.commonest(counts, 1500) == want and models.class_terms(rows, 1500) == want
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("count"), "term"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        counts.withColumn("r", rank).where("r <= 1500").explain()
    assert "WindowGroupLimit" in out.getvalue()


@pytest.mark.parametrize("features", [1, 7, 40, 10_000])
def test_pairs_are_counted_among_common_words_alone(spark, features):
    """The same terms as from a count of all words and pairs, ties included."""
    rng, data = random.Random(5), []
    for i in range(60):
        words = [f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randint(0, 12))] + ["a", "a"] * (i % 4)
        data.append((i, words, "positive" if i % 3 else "negative", float(i % 3 > 0)))
    rows = models.with_pairs(spark.createDataFrame(data, "id long, words array<string>, label string, y double"))
    assert models.class_terms(rows, features) == models.class_terms(rows.drop("words"), features)
    assert models.overall_terms(rows, features) == models.overall_terms(rows.drop("words"), features)
    counts = {f"n{k}": F.count_if(F.col("id") % 3 != k) for k in range(3)}
    fold = rows.withColumn("fold", (F.col("id") % 3).cast("int"))
    counts = {n: F.count_if(F.col("fold") != k) for k, n in enumerate(counts)}
    got, want = (models.term_counts(x, features, **counts) for x in (fold, fold.drop("words")))
    for n in counts:
        first = lambda df: models.commonest(df.select("y", "term", F.col(n).alias("count")).where("count > 0"), features)  # noqa: B023, E731
        assert first(got) == first(want)
    if features == 7:
        assert got.count() < want.count() / 2


def test_pairs_below_the_bound_get_no_text(spark):
    """Pairs are counted by numbers, and those that can't enter are not returned."""
    rng = random.Random(6)
    data = [(i, [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(30)], "positive" if i % 3 else "negative", float(i % 3 > 0)) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, words array<string>, label string, y double")
    found = models.term_counts(rows, 6, count=F.count("*"))
    got = {(r.y, r.term): r["count"] for r in found.collect()}
    every = {}
    for _, words, _, y in data:
        for t in [*words, *map(" ".join, zip(words, words[1:]))]:  # noqa: B905
            every[y, t] = every.get((y, t), 0) + 1
    for y in (0.0, 1.0):
        bound = sorted((n for (k, t), n in every.items() if k == y and " " not in t), reverse=True)[5]
        assert {t: n for (k, t), n in got.items() if k == y} == {t: n for (k, t), n in every.items() if k == y and n >= bound}
        assert any(" " in t and n < bound for (k, t), n in every.items() if k == y)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "keys=[first_code#" in plan and "keys=[y#" not in plan


def test_rows_are_written_by_part_without_a_sort(spark, rows):
    with_words = rows.select("id", F.col("terms").alias("words"), F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"))
    plans = lambda: str(spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription())
    got = models.stored_by(with_words.repartition(3, "id"), "split", "t")
    assert "Sort" not in plans() and "split" in plans()
    key = lambda df: sorted((r.id, tuple(r.words), r.split) for r in df.collect())
    assert key(got) == key(with_words) and got.columns == with_words.columns
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_zeroed_rows_do_not_travel_once_a_term(spark):
    words = [f"w{i}" for i in range(1200)]
    df = spark.createDataFrame([(i, words[i:] + words[: 3 * i], float(i % 2), "positive" if i % 2 else "negative") for i in range(8)], "id long, terms array<string>, y double, label string")
    model = models.fit(df, "logistic_regression", features=1200)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("zeroed", "")
    try:
        got = {r.term: r.influence for r in models.zeroing_influence(model, df).collect()}
        stages = {s for j in tracker.getJobIdsForGroup("zeroed") for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc._jsc.clearJobGroup()
    store = sc._jsc.sc().statusStore()
    written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert len(got) == 1200 and written < 2_000_000, written


def test_fits_overlap(rows):
    out = models.train_many(rows, rows, ("svm", "nothing", "naive_bayes", "logistic_regression"), features=30)
    assert [(r["algorithm"], r["status"]) for r in out] == [("svm", "ok"), ("nothing", "failed"), ("naive_bayes", "ok"), ("logistic_regression", "ok")]
    spans = [(r["began"], r["began"] + r["seconds"]) for r in out if r["status"] == "ok"]
    assert max(a for a, _ in spans) < min(b for _, b in spans)


@pytest.mark.parametrize("algorithm", ["naive_bayes", "logistic_regression", "svm"])
def test_linear_form_gives_the_models_probability(rows, algorithm):
    model = models.fit(rows, algorithm, rows, features=20)
    line = models.as_linear(model)
    odd = rows.withColumn("terms", F.when(F.col("id") == 5, F.array()).otherwise(F.concat("terms", "terms")))
    got = {r.id: r.prob for r in models.scored_by_all(odd.select("id", "terms"), {("m",): line}, ("name",)).collect()}
    want = {r.id: r.prob for r in models.scored(model, odd).select("id", "prob").collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_cross_scores_read_the_test_rows_once(rows):
    scores, fitted = workflow.cross_scores(rows, rows, ("naive_bayes", "random_forest"), features=20, trees=3, depth=3)
    assert models.as_linear(fitted["random_forest", "a"]) is None
    key = lambda df: sorted((r.algorithm, r.train_domain, r.test_domain, r.actual, round(r.prob, 9)) for r in df.collect())
    want = [(a, d, r.domain, r.label, round(r.prob, 9)) for (a, d), m in fitted.items() for r in models.scored(m, rows).collect()]
    assert key(scores) == sorted(want)


def test_normal_bayes_with_zeros_written_out(spark, rows):
    data = {r.id: (r.label, {t: float(len(t) + r.terms.count(t)) for t in set(r.terms)}) for r in rows.collect()}
    flat = spark.createDataFrame([(i, label, t, x) for i, (label, own) in data.items() for t, x in own.items()], "id long, label string, term string, x double")
    extra = spark.createDataFrame([(1000,)], "id long")
    vocab = spark.createDataFrame([("good",), ("poor",), ("t1",), ("t3",), ("never",)], "term string")
    counts = sampling.label_counts(rows)
    got = {(r.id, r.label): (r.score, r.prob) for r in bayes.score(bayes.fit(flat, counts, vocab), counts, rows.select("id").union(extra), flat.drop("label")).collect()}
    terms, labels = [r.term for r in vocab.collect()], ("positive", "negative")
    scores = {}
    for label in labels:
        own = [d for x, d in data.values() if x == label]
        fits = {}
        for t in terms:
            xs = [d.get(t, 0.0) for d in own]
            mean = sum(xs) / len(xs)
            fits[t] = mean, max(math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs)), bayes.LEAST)
        for i, d in [*((i, d) for i, (_, d) in data.items()), (1000, {})]:
            scores[i, label] = math.log((len(own) + 1) / (len(data) + 2)) + sum(-math.log(s) - (d.get(t, 0.0) - m) ** 2 / (2 * s * s) for t, (m, s) in fits.items())
    assert got.keys() == scores.keys()
    for (i, label), s in scores.items():
        other = scores[i, labels[label == "positive"]]
        assert abs(got[i, label][0] - s) < 1e-8 and abs(got[i, label][1] - 1 / (1 + math.exp(min(other - s, 700)))) < 1e-8


def test_first_lines_by_place_over_files_and_splits(spark, tmp_path):
    rng, order = random.Random(4), []
    for f in ("b", "a", "c"):
        lines = [f"{rng.choice('xxy')} {f}{i} {'z' * rng.randint(0, 40)}" for i in range(400)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n")
    for f in "abc":
        order += (tmp_path / f"{f}.txt").read_text().splitlines()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)  # many splits a file, several a task
    try:
        df = labeled.placed(spark, f"file://{tmp_path}/*.txt").withColumn("label", F.substring("value", 1, 1))
        got = [r.value for r in sampling.first_by_place(df, 700).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for label in "xy":
        own = [x for x in order if x[0] == label]
        want += own[: int(700 * len(own) / len(order) + 0.5)]
    assert sorted(got) == sorted(want)
