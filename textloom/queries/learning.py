"""Model and stream queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..adapters import Tables
from ..functions.basic import rounded
from ..operators import evaluation
from ..plans import models, workflow
from ..registry import query
from ..sources import exists, shared_path
from ..streaming import jobs
from . import metrics

OPTIONS = {"features": models.FEATURES, "trees": 100, "depth": 12}


def prepared(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows with their words, computed once and
    written by part, so that a part is read without the others. The pairs of
    their terms are built where they are looked up."""
    rows = models.with_words(models.parted(t.samples)).select("id", "label", "y", "domain", "words", "split")
    rows = models.with_pairs(models.stored_by(rows, "split", "words"))
    return tuple(rows.where(F.col("split") == s).drop("split") for s in models.PARTS)


def judged(scored: DataFrame) -> DataFrame:
    """(accuracy, macro metrics, auc, n) of scored rows."""
    rows = models.stored(scored.select(F.col("label").alias("actual"), "predicted", "prob", F.col("y").cast("int").alias("y")), "judged")
    matrix = evaluation.confusion(rows)
    out = evaluation.averages(evaluation.class_metrics(matrix), matrix)
    return out.join(F.broadcast(evaluation.roc_auc(rows).select("auc"))).join(F.broadcast(rows.agg(F.count("*").alias("n"))))


def trained(algorithm: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        train, held, test = prepared(t)
        model = models.fit(train, algorithm, held, **OPTIONS)
        return judged(models.scored(model, test)).withColumn("algorithm", F.lit(algorithm))

    return run


query("ml_linear_svm")(trained("svm"))
query("ml_naive_bayes")(trained("naive_bayes"))
query("ml_logistic_regression")(trained("logistic_regression"))
query("ml_random_forest")(trained("random_forest"))


@query("ml_platt_scaling")
def _(t: Tables) -> DataFrame:
    """Margin, probability and label of the test rows."""
    train, held, test = prepared(t)
    out = models.scored(models.fit(train, "svm", held, **OPTIONS), test)
    return out.select("id", vector_to_array(F.col("margin"))[0].alias("margin"), "prob", "y")


@query("ml_score")
def _(t: Tables) -> DataFrame:
    train, held, test = prepared(t)
    out = models.scored(models.fit(train, "logistic_regression", held, **OPTIONS), test)
    return out.select("id", "predicted", "prob", "confidence")


@query("op_oov_zero_vector")
def _(t: Tables) -> DataFrame:
    """Rows without a known term are scored like the empty text."""
    train, held, test = prepared(t)
    model = models.fit(train, "logistic_regression", held, **OPTIONS)
    rows = test.withColumn("terms", F.transform("terms", lambda x: F.concat(F.lit("\x00"), x)))
    return models.scored(model, rows).groupBy(rounded(F.col("prob")).alias("prob")).agg(F.count("*").alias("n"))


@query("op_minmax_scale")
def _(t: Tables) -> DataFrame:
    """Largest and smallest scaled value per row: inside 0..1."""
    train, _, test = prepared(t)
    stages, _ = models.vectors(train, models.overall_terms(train, 1000))
    out = PipelineModel(stages).transform(test)
    v = vector_to_array(F.col("features"))
    return out.select("id", F.array_min(v).alias("least"), F.array_max(v).alias("most"))


@query("ml_grid_search")
def _(t: Tables) -> DataFrame:
    """Macro F1 of the linear machine's surveyed configurations over five folds."""
    train, _, _ = prepared(t)
    return models.grid_scores(models.grid_search(train)).join(F.broadcast(train.agg(F.count("*").alias("n"))))


@query("ml_train_many")
def _(t: Tables) -> DataFrame:
    train, held, test = prepared(t)
    out = None
    for r in models.train_many(train, held, ("svm", "naive_bayes", "no_such_algorithm"), **OPTIONS):
        own = judged(models.scored(r["model"], test)).select("accuracy", "macro_f1", "n") if r["model"] else train.agg(F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("macro_f1"), F.count("*").alias("n"))
        own = own.select(F.lit(r["algorithm"]).alias("algorithm"), F.lit(r["status"]).alias("status"), "*")
        out = own if out is None else out.unionByName(own)
    return out


@query("ml_train_report")
def _(t: Tables) -> DataFrame:
    """Split, fit, try out, evaluate, save with metadata, load and judge again:
    the same figures."""
    train, held, test = prepared(t)
    model = models.fit(train, "logistic_regression", held, **OPTIONS)
    workflow.try_out(model, train).collect()
    a = judged(models.scored(model, test))
    sizes = train.agg(F.count("*").alias("train_rows"))
    at, figures = shared_path(t.spark, "model"), a.select("accuracy", "macro_f1").first().asDict()
    workflow.save(model, at, t.spark, "logistic_regression", "all", sizes.first()[0], figures)
    b = judged(models.scored(workflow.load(t.spark, at, "logistic_regression")[0], test))
    return a.withColumn("run", F.lit("fitted")).unionByName(b.withColumn("run", F.lit("loaded"))).join(F.broadcast(sizes))


@query("ml_transform_consistency")
def _(t: Tables) -> DataFrame:
    """Per split: rows, features and known terms of the pipeline fitted on train."""
    splits = dict(zip(models.PARTS, prepared(t), strict=True))
    fitted = PipelineModel(models.vectors(splits["train"])[0])
    out = None
    for name, rows in splits.items():
        found = fitted.transform(rows).agg(Summarizer.metrics("count", "numNonZeros").summary(F.col("features")).alias("s"))
        own = found.where("s.count > 0").select(F.lit(name).alias("split"), F.col("s.count").alias("n"), vector_to_array("s.numNonZeros").alias("uses"))
        out = own if out is None else out.unionByName(own)
    used = F.aggregate("uses", F.lit(0.0), lambda a, x: a + x).cast("long")
    return out.select("split", F.size("uses").alias("width"), "n", used.alias("frequent"))


CROSS = ("naive_bayes", "logistic_regression")


def crossed(t: Tables) -> DataFrame:
    """Scores of every test row under each algorithm fitted on each domain."""
    train, held, test = prepared(t)
    at = shared_path(t.spark, "cross")
    workflow.cross_scores(train, test, CROSS, held, **OPTIONS)[0].write.parquet(at)
    return t.spark.read.parquet(at)


@query("ml_cross_domain")
def _(t: Tables) -> DataFrame:
    """The matrix of real fits: algorithm and training domain by test domain."""
    return evaluation.cross_domain(crossed(t), "algorithm", "train_domain", "test_domain")


@query("ml_promote_best")
def _(t: Tables) -> DataFrame:
    """The best algorithm on other domains, fitted anew on all training rows and
    stored; its line and what the stored metadata say."""
    train, _, _ = prepared(t)
    at = shared_path(t.spark, "production")
    best = workflow.promote(crossed(t), train, at, **OPTIONS)
    _, info = workflow.load(t.spark, at)
    return best.withColumn("stored", F.lit(info["model_info"]["algorithm"])).withColumn("rows", F.lit(info["training_data"]["train_samples"]))


@query("model_save_load")
def _(t: Tables) -> DataFrame:
    """Rows whose probability the loaded model changes: none."""
    train, held, test = prepared(t)
    model = models.fit(train, "svm", held, **OPTIONS)
    at = shared_path(t.spark, "model")
    workflow.save(model, at, t.spark, "svm", "all", train.count())
    a = models.scored(model, test).select("id", "prob")
    b = models.scored(workflow.load(t.spark, at, "svm")[0], test).select("id", F.col("prob").alias("again"))
    return a.join(b, "id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prob") - F.col("again")) > 1e-12).alias("changed"))


@query("ml_feature_weights")
def _(t: Tables) -> DataFrame:
    train, held, _ = prepared(t)
    model = models.fit(train, "svm", held, **OPTIONS)
    from ..functions.labels import direction

    return models.feature_weights(model, t.spark).withColumn("direction", direction(F.col("weight")))


@query("ml_permutation_zeroing")
def _(t: Tables) -> DataFrame:
    """Influence of each term on a forest, over 200 seeded training rows."""
    train, held, _ = prepared(t)
    return models.zeroing_influence(models.fit(train, "random_forest", held, **OPTIONS), train)


# --- streams ------------------------------------------------------------------


def streamed(t: Tables) -> Tables:
    """The same tables, with events as a stream."""
    schema = t["events"].schema
    out = Tables(t.spark, t.sf_dir)
    events = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")
    out.__class__ = type("Streamed", (Tables,), {"__getitem__": lambda self, name: events if name == "events" else Tables.__getitem__(self, name)})
    return out


def run(df: DataFrame, mode: str, spark: SparkSession, name: str, key: str | None = None) -> DataFrame:
    """Run a stream over all that is there, each batch in a folder of its own (a
    repeated batch replaces it). Of the mode append all rows are returned, of
    update the last row of each ``key``, of complete the last batch."""
    at = shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not exists(spark, f"{at}/rows"):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("last")).select(key, "last.*")
    return rows.select(df.columns)


@query("stream_metrics", "SELECT strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M:%S') AS start, model_version, count(*) AS total, count_if(predicted_label = 'positive') AS positive, count_if(predicted_label = 'negative') AS negative, count_if(confidence < 0.6) AS low_confidence, round(avg(confidence), 6) AS mean_confidence FROM predictions GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    out = run(jobs.metrics(streamed(t).predictions), "complete", t.spark, "metrics")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "model_version", "total", "positive", "negative", "low_confidence", rounded(F.col("mean_confidence")).alias("mean_confidence"))


@query("stream_drift", f"WITH {metrics.DRIFT} {metrics.STATUS}")
def _(t: Tables) -> DataFrame:
    """The stateful job over the rows of each batch that it can need; its batch
    twin is the oracle."""
    at = shared_path(t.spark, "drift-rows")

    def put(batch: DataFrame, number: int) -> None:
        jobs.bounded(batch, metrics.N, metrics.M).repartition(1).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    rows = streamed(t).predictions.select("model_version", "ts", "event_id", "predicted_label", "confidence")
    q = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/rows/*")
    out = run(jobs.drift(kept, metrics.N, metrics.M), "update", t.spark, "drift", "model_version")
    return metrics.six(out, "prediction_psi", "confidence_psi")


def logged(t: Tables) -> tuple[str, dict[str, int]]:
    """The folder of the log that the job has written, and its counts."""
    at, counter = shared_path(t.spark, "stream-log"), jobs.LogCounter()
    t.spark.streams.addListener(counter)
    try:
        q = jobs.log(streamed(t).predictions, f"{at}/log", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return f"{at}/log", counter.counts(q)
    finally:
        t.spark.streams.removeListener(counter)


@query("stream_prediction_log", "SELECT event_id, predicted_label, processing_time_ms, strftime(ts, '%Y-%m-%d') AS dt FROM predictions")
def _(t: Tables) -> DataFrame:
    at, _ = logged(t)
    rows = t.spark.read.schema("event_id LONG, predicted_label STRING, processing_time_ms LONG, dt STRING").json(at)
    return rows.select("event_id", "predicted_label", "processing_time_ms", "dt")


@query("stream_dropped_counts", "SELECT count(*) AS logged, CAST(0 AS BIGINT) AS dropped FROM predictions")
def _(t: Tables) -> DataFrame:
    """Rows read back from the log, and rows that the job counted as dropped."""
    at, counts = logged(t)
    rows = t.spark.read.schema("event_id LONG").json(at)
    return rows.agg(F.count("*").alias("logged"), F.lit(counts["dropped"]).cast("long").alias("dropped"))


@query(
    "stream_late_counts",
    """WITH p AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE predicted_label END AS label FROM predictions),
    w AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM p WHERE event_id % 2 = 0 AND label IS NOT NULL),
    r AS (SELECT label IS NULL AS bad, label IS NOT NULL AND event_id % 2 = 1 AND epoch_us(ts) <= mark * 1000 AS late FROM p, w)
    SELECT count(*) FILTER (NOT bad AND NOT late) AS logged, count(*) FILTER (bad) AS dropped, count(*) FILTER (late) AS late, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (NOT bad AND NOT late) AS in_log FROM r""",
)
def _(t: Tables) -> DataFrame:
    """A log in two runs of one job: rows with even ids, then those with odd ids,
    of which all that lie ten minutes before the newest come late; every
    eleventh row has no label. The counts of both runs, and the rows in the log."""
    at, counter = shared_path(t.spark, "late-log"), jobs.LogCounter()
    label = F.when(F.col("event_id") % 11 != 0, F.col("predicted_label"))
    rows = t.predictions.select("event_id", "ts", label.alias("predicted_label"))
    t.spark.streams.addListener(counter)
    try:
        for odd in (0, 1):
            rows.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{at}/rows")
            source = t.spark.readStream.schema(rows.schema).parquet(f"{at}/rows")
            q = jobs.log(source, f"{at}/log", f"{at}/checkpoint", late="10 minutes").trigger(availableNow=True).start()
            q.awaitTermination()
            counts = counter.counts(q)
    finally:
        t.spark.streams.removeListener(counter)
    own = t.spark.read.schema("event_id LONG").json(f"{at}/log").agg(F.count("*").alias("in_log"))
    return own.select(*[F.lit(counts[k]).cast("long").alias(k) for k in ("logged", "dropped", "late", "repeated")], "in_log")


@query("stream_score")
def _(t: Tables) -> DataFrame:
    """Documents as a stream, scored by a model fitted on the labelled ones."""
    train, held, _ = prepared(t)
    model = models.fit(train, "logistic_regression", held, **OPTIONS)
    docs = t.spark.readStream.schema(t["documents"].schema).parquet(f"{t.sf_dir}/documents.parquet*")
    texts = models.with_terms(docs.select("doc_id", "text")).select("doc_id", "terms")
    out = jobs.score(texts, lambda df: models.scored(model, df), 0.6)
    return run(out.select("doc_id", "label", "confidence", "warning"), "append", t.spark, "scores")


