"""Source and sink queries: whole tables written, read again and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions import labels as L
from ..functions.basic import rounded
from ..operators import quality
from ..registry import query
from ..sources import documents, labeled, predictions, shared_path
from . import data, metrics
from .texts import REJECT, case_label

SUMMED = "count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars"
ACCEPTED = f"SELECT {case_label('raw_label')} AS label, {SUMMED} FROM raw_labels WHERE {REJECT} IS NULL GROUP BY 1"


def summed(rows: DataFrame) -> DataFrame:
    return labeled.accepted(rows).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def as_csv(t: Tables, sep: str) -> str:
    at = shared_path(t.spark, "csv")
    rows = t.raw_labels.select(F.col("doc_id"), F.col("text").alias("Review"), F.col("raw_label").alias("POLARITY"))
    rows.write.csv(at, header=True, sep=sep, quote='"', escape='"', quoteAll=True)
    return at


@query("src_labeled_csv", ACCEPTED)
def _(t: Tables) -> DataFrame:
    return summed(labeled.read_csv(t.spark, as_csv(t, ","), ","))


@query("src_delimiter_by_ext", ACCEPTED)
def _(t: Tables) -> DataFrame:
    sep = labeled.separator("reviews.TSV")
    return summed(labeled.read_csv(t.spark, as_csv(t, sep), sep))


@query("src_jsonl_samples", ACCEPTED)
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "jsonl")
    t.raw_labels.select(F.col("text").alias("body"), F.col("raw_label").alias("Class")).write.json(at, ignoreNullFields=False)
    return summed(labeled.read_json_lines(t.spark, at))


@query("src_text_samples", "SELECT label, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM samples WHERE length(trim(text)) <= 10000 GROUP BY label")
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "text")
    line = F.concat(F.lit("__label__"), "label", F.lit(" "), F.regexp_replace("text", r"\n", " "))
    t.samples.select(line.alias("value")).write.text(at)
    return summed(labeled.read_prefixed_text(t.spark, at))


@query("src_star_reviews", "SELECT CASE WHEN stars >= 4 THEN 'positive' WHEN stars <= 2 THEN 'negative' ELSE 'neutral' END AS raw_label, count(*) AS n FROM (SELECT doc_id % 5 + 1 AS stars FROM documents) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t["documents"].select("text", (F.col("doc_id") % 5 + 1).alias("stars"))
    return labeled.star_reviews(rows).groupBy("raw_label").agg(F.count("*").alias("n"))


@query("src_schema_check", "SELECT 'documents' AS dataset, count(*) AS rows, count(*) >= 100 AS enough_rows, 'sentiment' AS missing FROM documents")
def _(t: Tables) -> DataFrame:
    return labeled.schema_report(t["documents"], "documents", ("text", "sentiment"), 100)


@query("sink_samples_csv", "SELECT label, count(*) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM samples GROUP BY label")
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "samples")
    labeled.write_csv(t.samples, at)
    rows = labeled.read_csv(t.spark, at, ",")
    return rows.groupBy(L.normalize(F.col("raw_label")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sink_split_manifest", f"WITH {data.CHECKSUM}, c AS (SELECT split, count_if(label = 'positive') AS positive, count_if(label = 'negative') AS negative FROM splits GROUP BY split) SELECT sums.split, rows AS samples, checksum AS sha256, positive, negative FROM sums JOIN c ON c.split = sums.split WHERE sums.split <> 'validation'")
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "manifest")
    documents.write_json(documents.manifest(data.split_samples(t), "all", data.SEED, ["id", "label"]), at)
    back = documents.read_manifest(t.spark, at)
    return back.select(F.explode(F.array("train", "test")).alias("p")).select(F.col("p.file").alias("split"), "p.samples", "p.sha256", "p.positive", "p.negative")


@query("op_prepare_dataset", f"WITH {data.KEYED}, {data.COUNTS}, b AS (SELECT id, label, k FROM numbered WHERE r <= (SELECT min(n) FROM counts) OR (SELECT min(n) >= 0.95 * max(n) FROM counts)), m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM b) SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, label, count(*) AS n FROM m GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """Load, balance, split and write by part with a manifest; a second call finds
    the manifest and the parts are read again."""
    from ..plans import workflow

    at = shared_path(t.spark, "prepared")
    workflow.prepare(t.samples, at, "all", seed=data.SEED)
    workflow.prepare(t.samples.limit(0), at, "all", seed=data.SEED)
    return workflow.parts(t.spark, at).groupBy("split", "label").agg(F.count("*").alias("n"))


LOGGED = "SELECT event_id % 100 AS part, count(*) AS n, CAST(sum(processing_time_ms) AS BIGINT) AS ms, count(DISTINCT CAST(ts AS DATE)) AS days FROM predictions GROUP BY 1"


def logged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("processing_time_ms").alias("ms"), F.count_distinct(F.to_date("ts")).alias("days"))


def log_rows(t: Tables) -> DataFrame:
    return t.predictions.select("ts", F.col("event_id").cast("string").alias("text_hash"), F.lit(0).alias("text_length"), "predicted_label", "confidence", "processing_time_ms", "model_version")


@query("sink_prediction_jsonl", LOGGED)
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "log")
    predictions.write(log_rows(t), at)
    return logged(predictions.read(t.spark, at).withColumn("part", F.col("text_hash").cast("long") % 100))


@query("src_prediction_jsonl", LOGGED)
def _(t: Tables) -> DataFrame:
    """Rows as single JSON lines and back, without files."""
    rows = log_rows(t)
    back = rows.select(predictions.from_line(predictions.to_line(rows)).alias("r")).select("r.*").withColumnsRenamed(predictions.NAMES)
    return logged(back.withColumn("part", F.col("text_hash").cast("long") % 100))


@query("op_log_retention", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS dt FROM events) SELECT CAST(dt AS VARCHAR) AS dt FROM d WHERE dt < (SELECT max(dt) FROM d) - 7")
def _(t: Tables) -> DataFrame:
    days = t["events"].select(F.to_date("ts").alias("dt")).distinct()
    last = F.lit(days.agg(F.max("dt")).first()[0])
    return predictions.expired(days, last).select(F.col("dt").cast("string").alias("dt"))


def metadata_files(t: Tables) -> str:
    """A metadata file per algorithm and training domain, from the grid."""
    at = shared_path(t.spark, "metadata")
    own = metrics.cross(t).where("in_domain")
    own.select(
        F.col("train_domain").alias("domain"),
        F.struct("algorithm", F.lit("1.0").alias("version")).alias("model_info"),
        F.struct(F.col("train_domain").alias("dataset"), F.col("test_samples").alias("train_samples")).alias("training_data"),
        F.create_map(F.lit("k"), F.length("algorithm").cast("string")).alias("hyperparameters"),
        F.struct("accuracy", "macro_f1", "macro_precision", "macro_recall").alias("performance"),
    ).repartition("domain").write.partitionBy("domain").json(at)
    return at


@query("src_model_metadata", f"WITH {metrics.XMATRIX} SELECT algorithm, train_domain AS dataset, test_samples AS train_samples, round(accuracy, 6) AS accuracy FROM xm WHERE in_domain")
def _(t: Tables) -> DataFrame:
    rows = t.spark.read.schema(documents.METADATA).json(metadata_files(t))
    return metrics.six(rows.select("model_info.algorithm", "training_data.dataset", "training_data.train_samples", "performance.accuracy"), "accuracy")


@query("op_model_catalog", f"WITH {metrics.XMATRIX} SELECT train_domain AS domain, 'loaded' AS status, count(DISTINCT train_domain) AS files FROM xm WHERE in_domain GROUP BY 1")
def _(t: Tables) -> DataFrame:
    found = documents.model_catalog(t.spark, metadata_files(t))
    return found.groupBy("domain", "status").agg(F.count_distinct("path").alias("files"))


@query("agg_model_comparison", f"WITH {metrics.XMATRIX} SELECT algorithm, train_domain AS dataset, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(accuracy, 6) DESC, algorithm, train_domain) AS INTEGER) AS rank FROM xm WHERE in_domain")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.spark.read.schema(documents.METADATA).json(metadata_files(t))
    rows = metrics.six(rows.select("model_info.algorithm", "training_data.dataset", "performance.accuracy"), "accuracy")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "algorithm", "dataset")))


@query("sink_eval_json", f"WITH {metrics.XMATRIX} SELECT algorithm, train_domain || '->' || test_domain AS run, round(accuracy, 6) AS accuracy FROM xm")
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "matrix")
    rows = metrics.cross(t).select("algorithm", F.concat_ws("->", "train_domain", "test_domain").alias("run"), rounded(F.col("accuracy")).alias("accuracy"))
    documents.write_json(documents.nested(rows, "algorithm", "run"), at)
    back = t.spark.read.schema("value MAP<STRING, MAP<STRING, STRUCT<accuracy: DOUBLE>>>").json(at)
    back = back.select(F.explode("value").alias("algorithm", "runs")).select("algorithm", F.explode("runs").alias("run", "v"))
    return back.select("algorithm", "run", "v.accuracy")


@query("sink_quality_json", "SELECT label, round(avg(length(text)), 6) AS mean_length FROM samples GROUP BY label")
def _(t: Tables) -> DataFrame:
    at = shared_path(t.spark, "quality")
    means = quality.length_bias(t.samples).select("label", rounded(F.col("mean_length")).alias("mean_length"))
    documents.write_json(documents.nested(means, "label"), at)
    back = t.spark.read.schema("value MAP<STRING, STRUCT<mean_length: DOUBLE>>").json(at)
    return back.select(F.explode("value").alias("label", "v")).select("label", "v.mean_length")


@query("sink_feature_json", f"{data.TOPK} SELECT term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    at = shared_path(t.spark, "features")
    order = (F.desc(F.abs("weight")), "term")
    top = data.weights(t).orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    documents.write_json(top.select("term", rounded(F.col("weight")).alias("weight"), "rank"), at)
    return t.spark.read.schema("term STRING, weight DOUBLE, rank INT").json(at)


@query("op_fit_transform_consistency", f"WITH {data.O.SAMPLE_WORDS}, {data.SPLIT}, v AS (SELECT DISTINCT t.term FROM terms t JOIN splits s ON s.id = t.id WHERE s.split = 'train') SELECT s.split, count(*) AS terms, count_if(t.term IN (SELECT term FROM v)) AS known FROM terms t JOIN splits s ON s.id = t.id GROUP BY s.split")
def _(t: Tables) -> DataFrame:
    """Every split is counted against the vocabulary of train alone."""
    split = data.split_samples(t).select("id", "split")
    rows = data.sample_terms(t).select("id", "term").join(split, "id")
    known = rows.where("split = 'train'").select("term", F.lit(1).alias("k")).distinct()
    return rows.join(known, "term", "left").groupBy("split").agg(F.count("*").alias("terms"), F.count("k").alias("known"))


