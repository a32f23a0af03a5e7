"""Classifier pipelines on Spark ML."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, MaxAbsScaler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import ngrams, pairs, preprocess
from ..operators import sampling
from ..sources import shared_path

SEED = 42
FEATURES = 5000


def with_words(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``words`` (lower-cased, after preprocessing) and ``y``."""
    out = df.withColumn("words", F.transform(preprocess(F.col(text)), lambda t: F.lower(t)))
    return out.withColumn("y", (F.col(label) == "positive").cast("double")) if label in df.columns else out


def with_terms(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``terms`` (words and pairs after preprocessing) and ``y``."""
    out = df.withColumn("terms", ngrams(preprocess(F.col(text))))
    return out.withColumn("y", (F.col(label) == "positive").cast("double")) if label in df.columns else out


def with_pairs(df: DataFrame) -> DataFrame:
    """``terms`` of rows with ``words``, which take half the room in files."""
    return df.withColumn("terms", ngrams(F.col("words")))


def firsts(counts: DataFrame, features: int, by: str = "count") -> DataFrame:
    """The rows of each class's ``features`` commonest terms of (y, term, ``by``).
    A partition sends its own first terms of a class alone, as a rank limit beyond
    Spark's usual 1000 is pushed below the exchange as well."""
    conf, limit = counts.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(limit)) < features:
        conf.set(limit, str(features))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.desc(by), "term"))
    return counts.withColumn("r", rank).where(F.col("r") <= features)


def commonest(counts: DataFrame, features: int) -> list[str]:
    """The union of each class's ``features`` commonest terms of (y, term, count),
    in order."""
    return sorted(r.term for r in firsts(counts, features).select("term").distinct().collect())


#: Words, as wide as a few bytes each, that may be broadcast.
FEW = 500_000


def term_counts(train: DataFrame, features: int, **counts: Column) -> DataFrame:
    """(y, term, ``counts``) of all terms that can be among a class's ``features``
    commonest by one of the counts, each of which counts rows of exploded terms.

    A pair is no commoner than each of its words. Where the rows have ``words``,
    their words are counted first; the count of the last word that is in place
    bounds what can enter. Pairs are built of words at or above it alone, are
    counted by the numbers of their words (``code``, one a class and word), and
    get their text when they are at or above it themselves."""
    keys = [c for c in ("y", "fold") if c in train.columns]
    counted = lambda rows, *by: rows.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))
    if "words" not in train.columns:
        return counted(train.select(*keys, F.explode("terms").alias("term")), "y", "term")
    words = stored(counted(train.select(*keys, F.explode("words").alias("term")), "y", "term"), "words")
    bounds = [
        F.col("y").eqNullSafe(F.lit(r.y)) & (F.col(n) >= (r.least if r.n == features else 1))
        for n in counts
        for r in firsts(words.where(F.col(n) > 0), features, n).groupBy("y").agg(F.count("*").alias("n"), F.min(n).alias("least")).collect()
    ]
    enters = reduce(Column.__or__, bounds, F.lit(False))
    common = stored(words.where(enters).withColumn("code", F.monotonically_increasing_id()), "common")
    few = F.broadcast if common.count() <= FEW else lambda df: df
    side = lambda name: few(common.select(F.col("y").alias(f"{name}_y"), F.col("term").alias(name), F.col("code").alias(f"{name}_code")))
    rows = train.select(*keys, F.explode(pairs(F.col("words"))).alias("p"))
    for name in ("first", "second"):
        own = side(name)
        rows = rows.join(own, F.col("y").eqNullSafe(own[f"{name}_y"]) & (F.col("p")[name] == own[name])).drop(f"{name}_y", name)
    found = counted(rows, "first_code", "second_code").join(side("first"), "first_code").withColumnRenamed("first_y", "y").where(enters)
    found = found.join(side("second").drop("second_y"), "second_code")
    return common.drop("code").unionByName(found.select("y", F.concat_ws(" ", "first", "second").alias("term"), *counts))


def class_terms(train: DataFrame, features: int) -> list[str]:
    """The union of each class's ``features`` commonest terms, in order."""
    return commonest(term_counts(train, features, count=F.count("*")), features)


def overall_terms(train: DataFrame, features: int) -> list[str]:
    """The ``features`` commonest terms over all classes, in order."""
    return class_terms(train.withColumn("y", F.lit(0.0)), features)


def vectorizer(features: int = FEATURES, least: float = 1.0, tfidf: bool = False, terms: list[str] | None = None) -> list:
    """Presence features scaled to 0..1, or counts weighted by rarity; of the
    given terms, or else of the commonest ones over all classes."""
    counts = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=features, minDF=least, binary=not tfidf)
    if terms:
        counts = CountVectorizerModel.from_vocabulary(terms, "terms", "counts").setBinary(not tfidf)
    if tfidf:
        return [counts, IDF(inputCol="counts", outputCol="features")]
    return [counts, MaxAbsScaler(inputCol="counts", outputCol="features")]


def estimator(name: str, rows: int | None = None, trees: int = 100, depth: int = 12):
    """One of the four algorithms, with class weights where it takes them."""
    io = {"featuresCol": "features", "labelCol": "y"}
    if name == "svm":
        return LinearSVC(regParam=1 / (0.1 * max(rows or 1000, 10)), maxIter=50, standardization=False, weightCol="weight", **io)
    if name == "naive_bayes":
        return NaiveBayes(modelType="bernoulli", weightCol="weight", **io)
    if name == "logistic_regression":
        return LogisticRegression(maxIter=100, regParam=1e-6, weightCol="weight", **io)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="log2", seed=SEED, **io)
    raise ValueError(f"no such algorithm: {name}")


ALGORITHMS = ("svm", "naive_bayes", "logistic_regression", "random_forest")


def weighted(df: DataFrame) -> DataFrame:
    """Adds ``weight``: N / (K n) for classes out of balance, else 1."""
    from ..operators.quality import class_weights

    weights = class_weights(df.select("y"), 3.0, "y")
    return df.join(F.broadcast(weights), "y")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, and read from there from now on."""
    at = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stored_by(df: DataFrame, part: str, name: str) -> DataFrame:
    """``stored``, with a folder for each of the few values of ``part``. A task
    holds the open files of all of them, so rows are written as they come and
    never sorted; small row groups keep these files' buffers small."""
    spark, limit = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    at, before = shared_path(spark, name), spark.conf.get(limit)
    spark.conf.set(limit, "16")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).partitionBy(part).parquet(at)
    finally:
        spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(at)


def vectors(train: DataFrame, terms: list[str] | None = None, **options) -> tuple[list, DataFrame]:
    """The fitted stages of ``vectorizer`` and (y, weight, features) of the rows.
    Terms are looked up once; what is scaled and fitted on are numbers in files."""
    options = {k: v for k, v in options.items() if k in ("features", "least", "tfidf")}
    if terms is None and "least" not in options:
        terms = class_terms(train, options.get("features", FEATURES))
    counts, scale = vectorizer(**options, terms=terms)
    counts = counts if terms else counts.fit(train)
    rows = stored(counts.transform(weighted(train)).select("y", "weight", "counts"), "vectors")
    scale = scale.fit(rows)
    return [counts, scale], scale.transform(rows).select("y", "weight", "features")


def fit(train: DataFrame, algorithm: str, held: DataFrame | None = None, made: tuple[list, DataFrame] | None = None, **options) -> PipelineModel:
    """Fit on rows of ``with_terms``, or on their ``vectors`` where these are made
    already; the margin of the linear machine is turned into a probability by a
    logistic curve fitted on ``held`` rows."""
    wanted = estimator(algorithm, **{k: v for k, v in options.items() if k in ("rows", "trees", "depth")})
    stages, rows = made or vectors(train, **options)
    model = PipelineModel([*stages, wanted.fit(rows)])
    if algorithm != "svm":
        return model
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    platt = LogisticRegression(featuresCol="margin", labelCol="y", probabilityCol="probability", rawPredictionCol="plattRaw", predictionCol="plattPrediction", regParam=1e-3)
    scored = margin.transform(model.transform(held if held is not None else train))
    return PipelineModel([*model.stages, margin, platt.fit(scored.select("y", "margin"))])


def scored(model: Transformer, df: DataFrame) -> DataFrame:
    """Adds ``prob`` of the positive class, ``predicted`` and ``confidence``."""
    p = vector_to_array(F.col("probability"))[1]
    out = model.transform(df).withColumn("prob", p)
    return out.withColumn("predicted", F.when(p >= 0.5, "positive").otherwise("negative")).withColumn("confidence", F.greatest(p, 1 - p))


PARTS = ("train", "validation", "test")


def parted(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``split``, one of ``PARTS``."""
    return sampling.stratified_split(df, 0.6, 0.2, 0.2, seed, "id")


#: The surveyed grid of the linear kernel.
GRID = (0.01, 0.05, 0.1, 1.0)


def in_parallel(spark, pool: str, tasks: list, parallelism: int) -> list:
    """Call the tasks from driver threads, each in a pool of its own, so that
    their jobs share the cluster (fairly where ``spark.scheduler.mode`` is FAIR)."""

    def one(numbered: tuple):
        i, task = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{i}")
        return task()

    with ThreadPoolExecutor(max(1, min(parallelism, len(tasks)))) as pool_:
        return list(pool_.map(inheritable_thread_target(spark)(one), enumerate(tasks)))


def grid_search(train: DataFrame, grid: tuple[float, ...] = GRID, folds: int = 5, features: int = FEATURES, parallelism: int = 4, seed: int = SEED) -> DataFrame:
    """(c, fold, tp, fp, fn, tn) of the linear machine for each configuration and
    stratified fold; ``grid_scores`` makes scores of them.

    Folds are numbered on label and id alone. Terms are counted once by fold; a
    fold's terms are chosen from its training rows alone, by what the counts hold
    without it, and its vectors made once for all configurations, which fit from
    parallel threads. Its test rows are scored in one pass: a column for each
    configuration and one aggregate."""
    spark = train.sparkSession
    own = sampling.folds(train.select("label", "id"), folds, seed, "id").groupBy("label", "id").agg(F.min("fold").alias("fold"))
    own = own.withColumnsRenamed({"label": "label__", "id": "id__"})
    same = F.col("label").eqNullSafe(F.col("label__")) & F.col("id").eqNullSafe(F.col("id__"))
    dealt = train.join(own, same).drop("label__", "id__")
    if "words" in dealt.columns:
        dealt = with_pairs(stored(dealt.drop("terms"), "folds"))
    else:
        dealt = stored(dealt, "folds")
    uses = stored(term_counts(dealt, features, **{f"n{k}": F.count_if(F.col("fold") != k) for k in range(folds)}), "uses")

    def fold_counts(k: int) -> list[tuple]:
        own, test = dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)
        terms = commonest(uses.select("y", "term", F.col(f"n{k}").alias("count")).where("count > 0"), features)
        stages, rows = vectors(own, terms)
        n = rows.count()
        fits = in_parallel(spark, f"grid-{k}", [lambda c=c: estimator("svm", n).setRegParam(1 / (c * max(n, 10))).fit(rows) for c in grid], parallelism)
        seen = PipelineModel(stages).transform(test).select("y", "features")
        for i, model in enumerate(fits):
            seen = model.setRawPredictionCol(f"raw{i}").setPredictionCol(f"p{i}").transform(seen)
        y = F.col("y") == 1
        cells = lambda p: (y & p, ~y & p, y & ~p, ~y & ~p)
        counts = seen.agg(*(F.count_if(x) for i in range(len(grid)) for x in cells(F.col(f"p{i}") == 1))).first()
        return [(c, k, *counts[4 * i : 4 * i + 4]) for i, c in enumerate(grid)]

    found = [row for k in range(folds) for row in fold_counts(k)]
    return spark.createDataFrame(found, "c double, fold int, tp long, fp long, fn long, tn long")


def grid_scores(counts: DataFrame) -> DataFrame:
    """(c, macro_f1, accuracy, std, rank): over all folds' rows together, with the
    deviation of the folds' own macro F1; the best configuration has rank 1."""
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    macro = lambda tp, fp, fn, tn: (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2
    cells = ("tp", "fp", "fn", "tn")
    own = counts.withColumn("own", macro(*map(F.col, cells)))
    sums = own.groupBy("c").agg(*(F.sum(x).alias(x) for x in cells), F.stddev_pop("own").alias("std"))
    out = sums.select("c", macro(*map(F.col, cells)).alias("macro_f1"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), "std")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "c")))  # a row for each configuration


def feature_weights(model: PipelineModel, spark) -> DataFrame:
    """(term, weight) of a linear model: at most ``vocabSize`` rows."""
    words = vocabulary(model)
    linear = next(s for s in model.stages if hasattr(s, "coefficients"))
    return spark.createDataFrame([(w, float(c)) for w, c in zip(words, linear.coefficients.toArray(), strict=True)], "term string, weight double")


def vocabulary(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary


#: Terms of a row that one task takes out in turn.
CHUNK = 128


def zeroing_influence(model: PipelineModel, df: DataFrame, most: int = 200, seed: int = SEED, identity: str = "id") -> DataFrame:
    """(term, influence): the mean change of the largest class probability when
    the term's feature is set to zero, over at most ``most`` seeded rows.

    For any model of ``fit``, by the model itself with all it adds (intercept,
    trees): a row goes to it once as it is, and once for each of its terms
    without that term; a term that a row doesn't hold changes nothing there. Rows
    travel with their known terms, once for each ``CHUNK`` of them, and are
    repeated for the single terms only where they are scored."""
    spark, parts = df.sparkSession, df.sparkSession.sparkContext.defaultParallelism
    known = spark.createDataFrame([(w,) for w in vocabulary(model)], "term string")
    held = "words" if "words" in df.columns else "terms"
    rows = sampling.seeded_sample(df.select(identity, held), most, seed, identity)
    rows = stored((with_pairs(rows) if held == "words" else rows).select(F.col(identity).alias("row__"), "terms"), "zeroed")
    n = rows.agg(F.count("*").alias("n"))
    own = rows.select("row__", F.explode("terms").alias("term")).join(F.broadcast(known), "term", "left_semi")
    own = own.groupBy("row__").agg(F.collect_list("term").alias("terms")).withColumn("single", F.array_distinct("terms"))
    starts = F.sequence(F.lit(1), F.size("single"), F.lit(CHUNK))
    own = own.select("row__", "terms", F.explode(F.transform(starts, lambda i: F.slice("single", i, CHUNK))).alias("chunk"))
    own = own.repartition(4 * parts, "row__", F.col("chunk")[0]).select("row__", "terms", F.explode("chunk").alias("term"))
    own = own.withColumn("terms", F.array_remove("terms", F.col("term")))
    base = scored(model, rows).select("row__", F.col("confidence").alias("before"))
    moved = scored(model, own).select("row__", "term", "confidence").join(F.broadcast(base), "row__")
    sums = moved.groupBy("term").agg(F.sum(F.abs(F.col("before") - F.col("confidence"))).alias("d"))
    out = known.join(sums, "term", "left").join(F.broadcast(n))
    return out.select("term", F.coalesce(F.try_divide(F.col("d"), F.col("n")), F.lit(0.0)).alias("influence"))


def train_many(train: DataFrame, held: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS, parallelism: int = 4, **options) -> list[dict]:
    """One result per algorithm, in order; the fits run from parallel threads,
    on the same vectors, and a failure becomes a result of its own."""
    made = vectors(train, **options)

    def one(name: str) -> dict:
        began = time.time()
        out = {"algorithm": name, "status": "ok", "model": None, "error": None, "began": began}
        try:
            out["model"] = fit(train, name, held, made, **options)
        except Exception as e:  # noqa: BLE001  the run goes on with the other algorithms
            out |= {"status": "failed", "error": str(e)[:300]}
        return out | {"seconds": time.time() - began}

    return in_parallel(train.sparkSession, "train", [lambda a=a: one(a) for a in algorithms], parallelism)


def as_linear(model: PipelineModel) -> tuple[dict[str, float], float] | None:
    """(weight of each term's presence, bias) such that the positive class's
    probability is the logistic function of the sum; None for other models."""
    last = model.stages[-1]
    scale = next((s.maxAbs.toArray() for s in model.stages if hasattr(s, "maxAbs")), None)
    if scale is None or not next(s for s in model.stages if hasattr(s, "vocabulary")).getBinary():
        return None
    a, b = 1.0, 0.0
    if isinstance(last, LogisticRegressionModel) and isinstance(model.stages[-2], VectorSlicer):  # a curve over the margin
        a, b, last = float(last.coefficients[0]), float(last.intercept), model.stages[-3]
    if isinstance(last, LogisticRegressionModel | LinearSVCModel):
        w, bias = last.coefficients.toArray(), float(last.intercept)
    elif isinstance(last, NaiveBayesModel) and last.getModelType() == "bernoulli":
        theta = last.theta.toArray()
        no = np.log1p(-np.exp(theta))
        w, bias = (theta - no)[1] - (theta - no)[0], float(last.pi[1] - last.pi[0] + no[1].sum() - no[0].sum())
    else:
        return None
    w = np.divide(w, scale, out=np.zeros(len(w)), where=scale > 0)
    return {t: a * float(x) for t, x in zip(vocabulary(model), w, strict=True)}, a * bias + b


#: Bytes of weights that may be broadcast.
WEIGHTS = 64 << 20


def scored_by_all(df: DataFrame, lines: dict[tuple, tuple[dict[str, float], float]], names: tuple[str, ...], identity: str = "id") -> DataFrame:
    """``names`` of the model, the columns of ``df`` without its terms, prob,
    predicted and confidence: each row under each linear model, from one scan of
    the rows, one join with all weights side by side and one sum a model."""
    spark, keys = df.sparkSession, list(lines)
    terms = sorted({t for w, _ in lines.values() for t in w})
    table = spark.createDataFrame([(t, [lines[k][0].get(t, 0.0) for k in keys]) for t in terms], "term string, w array<double>")
    table = F.broadcast(table) if len(terms) * (8 * len(keys) + 60) <= WEIGHTS else table
    sums = df.select(identity, F.explode(F.array_distinct("terms")).alias("term")).join(table, "term").groupBy(identity).agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(keys))))
    margins = [F.struct(*(F.lit(x).alias(n) for n, x in zip(names, k, strict=True)), (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + lines[k][1]).alias("z")) for i, k in enumerate(keys)]
    rows = df.drop("terms").join(sums, identity, "left").select(*[c for c in df.columns if c != "terms"], F.explode(F.array(*margins)).alias("m"))
    p = 1 / (1 + F.exp(-F.col("m.z")))
    out = rows.select("m.*", *[c for c in df.columns if c != "terms"], p.alias("prob")).drop("z")
    return out.withColumn("predicted", F.when(F.col("prob") >= 0.5, "positive").otherwise("negative")).withColumn("confidence", F.greatest(F.col("prob"), 1 - F.col("prob")))
