"""Evaluation, calibration, cross-domain and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions.basic import rounded
from ..operators import calibration, evaluation, monitoring
from ..registry import query

CM = "cm AS (SELECT actual, predicted, count(*) AS n FROM scored GROUP BY 1, 2)"
CLS = f"""{CM}, sup AS (SELECT actual AS class, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1),
called AS (SELECT predicted AS class, sum(n) AS called FROM cm GROUP BY 1),
pr AS (SELECT class, coalesce(support, 0) AS support, coalesce(tp * 1.0 / nullif(called, 0), 0) AS p, coalesce(tp * 1.0 / nullif(support, 0), 0) AS r FROM sup FULL JOIN called USING (class)),
metrics AS (SELECT class, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, support FROM pr)"""


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def metrics(t: Tables) -> DataFrame:
    return evaluation.class_metrics(evaluation.confusion(t.scored))


@query("agg_confusion_matrix", f"WITH {CM} SELECT actual, coalesce(sum(CASE WHEN predicted = 'negative' THEN n END), 0)::BIGINT AS negative, coalesce(sum(CASE WHEN predicted = 'positive' THEN n END), 0)::BIGINT AS positive FROM cm GROUP BY actual")
def _(t: Tables) -> DataFrame:
    return t.scored.groupBy("actual").pivot("predicted", ["negative", "positive"]).agg(F.count("id")).na.fill(0)


@query("agg_class_metrics", f"WITH {CLS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM metrics")
def _(t: Tables) -> DataFrame:
    return six(metrics(t), "precision", "recall", "f1")


@query("agg_metrics_by_class", f"WITH {CLS} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics WHERE class = 'positive'")
def _(t: Tables) -> DataFrame:
    return six(metrics(t).where("class = 'positive'").select("precision", "recall", "f1"), "precision", "recall", "f1")


AVG = "round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1"


@query("agg_macro_weighted", f"WITH {CLS} SELECT {AVG}, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round((SELECT sum(CASE WHEN actual = predicted THEN n ELSE 0 END) * 1.0 / sum(n) FROM cm), 6) AS accuracy FROM metrics")
def _(t: Tables) -> DataFrame:
    matrix = evaluation.confusion(t.scored)
    out = evaluation.averages(evaluation.class_metrics(matrix), matrix)
    return six(out, *out.columns)


@query("op_macro_f1", f"WITH {CLS} SELECT round(avg(f1), 6) AS macro_f1 FROM metrics")
def _(t: Tables) -> DataFrame:
    return metrics(t).agg(rounded(F.avg("f1")).alias("macro_f1"))


@query("agg_kappa", f"WITH {CM}, s AS (SELECT sum(n) AS n, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS c FROM cm), e AS (SELECT sum(a.k * b.k) AS ab FROM (SELECT actual AS x, sum(n) AS k FROM cm GROUP BY 1) a JOIN (SELECT predicted AS x, sum(n) AS k FROM cm GROUP BY 1) b USING (x)) SELECT CAST(c AS BIGINT) AS correct, CAST(n - c AS BIGINT) AS incorrect, round((c * 1.0 / n - ab * 1.0 / (n * n)) / (1 - ab * 1.0 / (n * n)), 6) AS kappa FROM s, e")
def _(t: Tables) -> DataFrame:
    return six(evaluation.kappa(evaluation.confusion(t.scored)), "kappa")


@query("agg_roc_auc", "WITH p AS (SELECT prob, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY prob), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos)::DOUBLE AS positives, sum(neg)::DOUBLE AS negatives FROM w")
def _(t: Tables) -> DataFrame:
    return six(evaluation.roc_auc(t.scored), "auc")


@query(
    "agg_pr_auc",
    """WITH r AS (SELECT 'negative' AS class, 1 - prob AS p, 1 - y AS y FROM scored UNION ALL SELECT 'positive', prob, y FROM scored),
    s AS (SELECT class, p, sum(y) AS pos, count(*) AS k FROM r GROUP BY 1, 2),
    c AS (SELECT class, pos, k, sum(pos) OVER w AS hits, sum(k) OVER w AS called FROM s WINDOW w AS (PARTITION BY class ORDER BY p DESC)),
    a AS (SELECT class, sum(pos * (hits * 1.0::DOUBLE / called + coalesce((hits - pos) * 1.0::DOUBLE / nullif(called - k, 0), hits * 1.0::DOUBLE / called)) / 2) / sum(pos) AS area FROM c GROUP BY class)
    SELECT (SELECT count(*) FROM scored) AS n, round(max(CASE WHEN class = 'positive' THEN area END), 6) AS pr_auc, round(max(CASE WHEN class = 'negative' THEN area END), 6) AS pr_auc_negative, round(avg(area), 6) AS pr_auc_macro FROM a""",
)
def _(t: Tables) -> DataFrame:
    """The area of each class against the other, and their mean."""
    sides = F.array(F.struct(F.lit("negative").alias("class"), (1 - F.col("prob")).alias("prob"), (1 - F.col("y")).alias("y")), F.struct(F.lit("positive").alias("class"), "prob", "y"))
    areas = evaluation.pr_auc(t.scored.select(F.explode(sides).alias("s")).select("s.*"), "class")
    of = lambda c: F.max(F.when(F.col("class") == c, F.col("pr_auc")))
    out = areas.agg(of("positive").alias("pr_auc"), of("negative").alias("pr_auc_negative"), F.avg("pr_auc").alias("pr_auc_macro"))
    return six(t.scored.agg(F.count("*").alias("n")).join(F.broadcast(out)), *out.columns)


@query("agg_brier", "SELECT round(avg((prob - y) ** 2), 6) AS brier FROM scored")
def _(t: Tables) -> DataFrame:
    return six(calibration.brier(t.scored), "brier")


BINS = "raw AS (SELECT least(CAST(floor(prob * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(prob) AS c, avg(y) AS a FROM scored GROUP BY 1), binned AS (SELECT CAST(b AS INTEGER) AS bin, b / 10.0 AS lower, (b + 1) / 10.0 AS upper, coalesce(n, 0) AS n, c AS confidence, a AS accuracy FROM range(10) t(b) LEFT JOIN raw ON raw.bin = b)"


@query("agg_calibration_bins", f"WITH {BINS} SELECT bin, round(lower::DOUBLE, 6) AS lower, round(upper::DOUBLE, 6) AS upper, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM binned")
def _(t: Tables) -> DataFrame:
    return six(calibration.bins(t.scored, 10), "lower", "upper", "confidence", "accuracy")


@query("agg_ece", f"WITH {BINS} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM binned")
def _(t: Tables) -> DataFrame:
    return six(calibration.errors(calibration.bins(t.scored, 10)).select("ece"), "ece")


@query("agg_mce", f"WITH {BINS} SELECT round(max(abs(accuracy - confidence)), 6) AS mce FROM binned WHERE n > 0")
def _(t: Tables) -> DataFrame:
    return six(calibration.errors(calibration.bins(t.scored, 10)).select("mce"), "mce")


@query("agg_reliability_table", f"WITH {BINS} SELECT bin, round(lower::DOUBLE, 6) AS lower, round(upper::DOUBLE, 6) AS upper, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(accuracy - confidence, 6) AS gap FROM binned")
def _(t: Tables) -> DataFrame:
    return six(calibration.reliability(calibration.bins(t.scored, 10)), "lower", "upper", "confidence", "accuracy", "gap")


@query("op_calibration_validate", "SELECT id, CASE WHEN p < 0 OR p > 1 THEN 'probability_out_of_range' ELSE 'label_not_binary' END AS reason FROM (SELECT id, prob * 1.05 AS p, CASE WHEN id % 11 = 0 THEN 2 ELSE y END AS y FROM scored) WHERE p < 0 OR p > 1 OR y NOT IN (0, 1)")
def _(t: Tables) -> DataFrame:
    rows = t.scored.select("id", (F.col("prob") * 1.05).alias("prob"), F.when(F.col("id") % 11 == 0, 2).otherwise(F.col("y")).alias("y"))
    return calibration.invalid(rows, 10).select("id", "reason")


@query(
    "agg_calibration_multiclass",
    "WITH x AS (SELECT 0 AS class, 1 - prob AS p, 1 - y AS y FROM scored UNION ALL SELECT 1, prob, y FROM scored), b AS (SELECT class, avg((p - y) ** 2) AS brier FROM x GROUP BY 1), g AS (SELECT class, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM x GROUP BY 1, 2), e AS (SELECT class, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM g GROUP BY 1) SELECT round(avg(brier), 6) AS brier, round(avg(ece), 6) AS ece, round(avg(mce), 6) AS mce FROM b JOIN e USING (class)",
)
def _(t: Tables) -> DataFrame:
    rows = t.scored.select(F.array(1 - F.col("prob"), F.col("prob")).alias("probabilities"), "y")
    return six(calibration.multiclass(rows, 10), "brier", "ece", "mce")


@query("op_smooth_probabilities", "WITH c AS (SELECT id, least(greatest(1 - prob, 0.001), 0.999) AS a, least(greatest(prob, 0.001), 0.999) AS b FROM scored) SELECT id, round(a / (a + b), 6) AS negative, round(b / (a + b), 6) AS positive FROM c")
def _(t: Tables) -> DataFrame:
    p = evaluation.smooth(F.array(1 - F.col("prob"), F.col("prob")))
    return t.scored.select("id", p.alias("p")).select("id", rounded(F.col("p")[0]).alias("negative"), rounded(F.col("p")[1]).alias("positive"))


@query("op_cv_stddev", "WITH f AS (SELECT domain, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) AS a, count(*) AS n FROM scored GROUP BY domain) SELECT domain, round(sqrt(a * (1 - a) / n) * sqrt(5), 6) AS std FROM f")
def _(t: Tables) -> DataFrame:
    rows = t.scored.groupBy("domain").agg(F.avg(F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)).alias("a"), F.count("*").alias("n"))
    return rows.select("domain", rounded(F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n")) * F.sqrt(F.lit(5.0))).alias("std"))


# --- cross-domain -------------------------------------------------------------

GRID = """grid AS (SELECT a.algorithm, d.train_domain, s.domain AS test_domain, s.id, s.actual, s.y, (s.id * a.k + length(d.train_domain) * 31 + ascii(d.train_domain)) % 997 / 996.0::DOUBLE AS prob
FROM scored s CROSS JOIN (VALUES ('svm', 7919), ('bayes', 104729)) a(algorithm, k) CROSS JOIN (SELECT DISTINCT domain AS train_domain FROM scored) d),
called AS (SELECT *, CASE WHEN prob >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted FROM grid)"""
XMATRIX = f"""{GRID}, xm AS (SELECT algorithm, train_domain, test_domain, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) AS accuracy, avg((prob - y) ** 2) AS brier, count(*) AS test_samples, train_domain = test_domain AS in_domain FROM called GROUP BY 1, 2, 3)"""


def grid(t: Tables) -> DataFrame:
    """Scores of two algorithms trained on each domain: every model scores every
    row, so the grid is the few models by the rows."""
    scored = t.scored
    algorithms = t.spark.createDataFrame([("svm", 7919), ("bayes", 104729)], "algorithm string, k int")
    models = algorithms.crossJoin(scored.select(F.col("domain").alias("train_domain")).distinct())
    one = models.agg(F.collect_list(F.struct("algorithm", "k", "train_domain")).alias("models"))
    rows = scored.join(F.broadcast(one)).select("*", F.explode("models").alias("m")).select("*", "m.*", F.col("domain").alias("test_domain"))
    prob = (F.col("id") * F.col("k") + F.length("train_domain") * 31 + F.ascii("train_domain")) % 997 / 996.0
    rows = rows.select("algorithm", "train_domain", "test_domain", "id", "actual", "y", prob.alias("prob"))
    return rows.withColumn("predicted", F.when(F.col("prob") >= 0.5, "positive").otherwise("negative"))


def cross(t: Tables) -> DataFrame:
    return evaluation.cross_domain(grid(t), "algorithm", "train_domain", "test_domain")


@query("agg_cross_domain_matrix", f"WITH {XMATRIX} SELECT algorithm, train_domain, test_domain, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, test_samples, in_domain FROM xm")
def _(t: Tables) -> DataFrame:
    return six(cross(t).drop("macro_f1", "macro_precision", "macro_recall"), "accuracy", "brier")


@query("agg_cross_domain_avg", f"WITH {XMATRIX} SELECT algorithm, train_domain, round(avg(CASE WHEN NOT in_domain THEN accuracy END), 6) AS mean_other FROM xm GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return six(evaluation.cross_domain_average(cross(t)), "mean_other")


@query("agg_best_model", f"WITH {XMATRIX}, a AS (SELECT algorithm, train_domain, round(avg(CASE WHEN NOT in_domain THEN accuracy END), 6) AS mean_other FROM xm GROUP BY 1, 2) SELECT * FROM a ORDER BY mean_other DESC, algorithm, train_domain LIMIT 1")
def _(t: Tables) -> DataFrame:
    return evaluation.best_model(six(evaluation.cross_domain_average(cross(t)), "mean_other"))


META = "meta AS (SELECT DISTINCT 'svm' AS algorithm, domain AS train_domain, 'v-' || domain AS version FROM scored WHERE domain <> 'es')"


def metadata(t: Tables) -> DataFrame:
    return t.scored.where("domain <> 'es'").select(F.lit("svm").alias("algorithm"), F.col("domain").alias("train_domain"), F.concat(F.lit("v-"), "domain").alias("version")).distinct()


@query("join_eval_metadata", f"WITH {XMATRIX}, {META} SELECT xm.algorithm, xm.train_domain, xm.test_domain, round(accuracy, 6) AS accuracy, version FROM xm JOIN meta ON meta.algorithm = xm.algorithm AND meta.train_domain = xm.train_domain")
def _(t: Tables) -> DataFrame:
    out = cross(t).join(metadata(t), ["algorithm", "train_domain"])
    return six(out.select("algorithm", "train_domain", "test_domain", "accuracy", "version"), "accuracy")


@query("join_model_grid", f"WITH {META}, dom AS (SELECT DISTINCT domain FROM scored), alg AS (SELECT unnest(['svm', 'bayes']) AS algorithm) SELECT alg.algorithm, a.domain AS train_domain, b.domain AS test_domain FROM alg CROSS JOIN dom a CROSS JOIN dom b JOIN meta ON meta.algorithm = alg.algorithm AND meta.train_domain = a.domain")
def _(t: Tables) -> DataFrame:
    """Runs of available models over all test sets (a grid of a few names)."""
    domains = t.scored.select("domain").distinct()
    tests = domains.agg(F.collect_set("domain").alias("tests"))
    runs = metadata(t).select("algorithm", "train_domain").join(F.broadcast(tests))
    return runs.select("algorithm", "train_domain", F.explode("tests").alias("test_domain"))


@query("join_copy_metadata", f"WITH {XMATRIX}, {META}, best AS (SELECT algorithm, train_domain, round(avg(accuracy), 6) AS mean_all FROM xm GROUP BY 1, 2) SELECT meta.algorithm, meta.train_domain, version, mean_all FROM meta LEFT JOIN best ON best.algorithm = meta.algorithm AND best.train_domain = meta.train_domain")
def _(t: Tables) -> DataFrame:
    block = cross(t).groupBy("algorithm", "train_domain").agg(rounded(F.avg("accuracy")).alias("mean_all"))
    return metadata(t).join(block, ["algorithm", "train_domain"], "left").select("algorithm", "train_domain", "version", "mean_all")


@query("op_promote_best", f"WITH {XMATRIX}, {META}, a AS (SELECT algorithm, train_domain, round(avg(CASE WHEN NOT in_domain THEN accuracy END), 6) AS mean_other FROM xm GROUP BY 1, 2) SELECT a.algorithm, a.train_domain, mean_other, 'production' AS stage FROM a JOIN meta ON meta.algorithm = a.algorithm AND meta.train_domain = a.train_domain ORDER BY mean_other DESC, 1, 2 LIMIT 1")
def _(t: Tables) -> DataFrame:
    """The best model that has metadata becomes the production model."""
    average = six(evaluation.cross_domain_average(cross(t)), "mean_other").join(metadata(t), ["algorithm", "train_domain"], "left_semi")
    return evaluation.best_model(average).withColumn("stage", F.lit("production"))


@query("agg_report_validate", f"WITH {XMATRIX} SELECT count_if(accuracy IS NULL) AS missing, count_if(accuracy = 0) AS zeros, count_if(test_samples < 100) AS small, count(*) AS runs FROM xm")
def _(t: Tables) -> DataFrame:
    return cross(t).agg(F.count_if(F.col("accuracy").isNull()).alias("missing"), F.count_if(F.col("accuracy") == 0).alias("zeros"), F.count_if(F.col("test_samples") < 100).alias("small"), F.count("*").alias("runs"))


# --- monitoring ----------------------------------------------------------------


@query("agg_prediction_metrics", "SELECT count(*) AS total, count_if(predicted_label = 'positive') AS positive, count_if(predicted_label = 'negative') AS negative, count_if(predicted_label = 'uncertain') AS uncertain, round(100.0 * count_if(confidence < 0.6) / count(*), 6) AS low_confidence_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(processing_time_ms), 6) AS latency_mean, round(quantile_cont(processing_time_ms, 0.5), 6) AS latency_p50, round(quantile_cont(processing_time_ms, 0.95), 6) AS latency_p95, round(quantile_cont(processing_time_ms, 0.99), 6) AS latency_p99 FROM predictions")
def _(t: Tables) -> DataFrame:
    out = monitoring.prediction_metrics(t.predictions)
    return six(out, *[c for c in out.columns if "rate" in c or "mean" in c or "_p" in c])


@query("agg_confidence_summary", "SELECT round(quantile_cont(confidence * 100, 0.5), 6) AS p50, round(quantile_cont(confidence * 100, 0.95), 6) AS p95, round(quantile_cont(confidence * 100, 0.99), 6) AS p99 FROM predictions")
def _(t: Tables) -> DataFrame:
    return six(monitoring.confidence_summary(t.predictions), "p50", "p95", "p99")


@query("agg_batch_summary", "SELECT strftime(ts, '%Y-%m-%d') AS batch, user_id, count(*) AS processed, count_if(predicted_label <> 'uncertain') AS success, count_if(predicted_label = 'uncertain') AS error, CAST(sum(processing_time_ms) AS BIGINT) AS total_ms FROM predictions GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    fail = F.col("predicted_label") == "uncertain"
    rows = t.predictions.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch"), "user_id")
    return rows.agg(F.count("*").alias("processed"), F.count_if(~fail).alias("success"), F.count_if(fail).alias("error"), F.sum("processing_time_ms").alias("total_ms"))


N, M = 1000, 500
REF = f"ordered AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY ts, event_id) AS r, row_number() OVER (PARTITION BY model_version ORDER BY ts DESC, event_id DESC) AS back FROM predictions), refw AS (SELECT * FROM ordered WHERE r <= {N}), cmpw AS (SELECT * FROM ordered WHERE r > {N} AND back <= {M})"


def shares(source: str) -> str:
    return f"""{source}_l AS (SELECT m.model_version, k.key, coalesce(x.n, 0) * 1.0 / sum(coalesce(x.n, 0)) OVER (PARTITION BY m.model_version) AS share FROM (SELECT DISTINCT model_version FROM {source}) m CROSS JOIN (SELECT DISTINCT predicted_label AS key FROM predictions) k LEFT JOIN (SELECT model_version, predicted_label AS key, count(*) AS n FROM {source} GROUP BY 1, 2) x ON x.model_version = m.model_version AND x.key = k.key),
{source}_c AS (SELECT m.model_version, CAST(t.b AS INTEGER) AS key, coalesce(x.n, 0) * 1.0 / sum(coalesce(x.n, 0)) OVER (PARTITION BY m.model_version) AS share FROM (SELECT DISTINCT model_version FROM {source}) m CROSS JOIN range(10) t(b) LEFT JOIN (SELECT model_version, least(floor(confidence * 10), 9) AS b, count(*) AS n FROM {source} GROUP BY 1, 2) x ON x.model_version = m.model_version AND x.b = t.b)"""


def psi_sql(name: str, kind: str) -> str:
    e, a = "greatest(coalesce(e.share, 0), 0.0001)", "greatest(coalesce(a.share, 0), 0.0001)"
    return f"{name} AS (SELECT e.model_version, greatest(sum(({a} - {e}) * ln({a} / {e})), 0) AS psi FROM refw_{kind} e FULL JOIN cmpw_{kind} a ON a.model_version = e.model_version AND a.key = e.key GROUP BY e.model_version)"


DRIFT = f"{REF}, {shares('refw')}, {shares('cmpw')}, {psi_sql('pl', 'l')}, {psi_sql('pc', 'c')}"


@query("win_reference_window", f"WITH {REF} SELECT event_id, model_version FROM refw")
def _(t: Tables) -> DataFrame:
    return monitoring.reference_window(t.predictions, N).select("event_id", "model_version")


@query("win_comparison_window", f"WITH {REF} SELECT event_id, model_version FROM cmpw")
def _(t: Tables) -> DataFrame:
    return monitoring.comparison_window(t.predictions, N, M).select("event_id", "model_version")


@query("win_rolling_confidence", "WITH o AS (SELECT event_id, model_version, confidence, row_number() OVER (PARTITION BY model_version ORDER BY ts, event_id) AS rn FROM predictions), g AS (SELECT *, rn // 101 AS run, rn % 101 = 0 AS head FROM o) SELECT event_id, model_version, round(coalesce(sum(CASE WHEN head THEN 0 ELSE confidence END) OVER w / nullif(sum(CASE WHEN head THEN 0 ELSE 1 END) OVER w, 0), 0), 12) AS rolling FROM g WINDOW w AS (PARTITION BY model_version, run ORDER BY rn)")
def _(t: Tables) -> DataFrame:
    out = monitoring.rolling_confidence(t.predictions, 101)
    return out.select("event_id", "model_version", rounded(F.col("rolling"), 12).alias("rolling"))


@query("agg_drift_shares", f"WITH {REF}, {shares('refw')} SELECT model_version, CAST(key AS VARCHAR) AS key, round(share, 6) AS share FROM refw_l UNION ALL SELECT model_version, CAST(key AS VARCHAR), round(share, 6) FROM refw_c")
def _(t: Tables) -> DataFrame:
    own = monitoring.reference_window(t.predictions, N)
    a = monitoring.label_shares(own, "model_version")
    b = monitoring.confidence_shares(own, 10, "model_version").withColumn("key", F.col("key").cast("string"))
    return six(a.unionByName(b), "share")


@query("agg_psi", f"WITH {DRIFT} SELECT model_version, round(psi, 6) AS psi FROM pl")
def _(t: Tables) -> DataFrame:
    a, b = monitoring.reference_window(t.predictions, N), monitoring.comparison_window(t.predictions, N, M)
    return six(monitoring.psi(monitoring.label_shares(a, "model_version"), monitoring.label_shares(b, "model_version"), "model_version"), "psi")


@query("join_psi_outer", f"WITH {DRIFT} SELECT e.model_version, e.key, round(e.share, 6) AS expected, round(coalesce(a.share, 0), 6) AS actual FROM refw_l e FULL JOIN cmpw_l a ON a.model_version = e.model_version AND a.key = e.key")
def _(t: Tables) -> DataFrame:
    a, b = (monitoring.label_shares(w, "model_version") for w in (monitoring.reference_window(t.predictions, N), monitoring.comparison_window(t.predictions, N, M)))
    both = a.withColumnRenamed("share", "expected").join(b.withColumnRenamed("share", "actual"), ["model_version", "key"], "full")
    return six(both.na.fill(0.0), "expected", "actual")


STATUS = f"SELECT pl.model_version, (SELECT count(*) FROM refw r WHERE r.model_version = pl.model_version) AS reference_size, (SELECT count(*) FROM cmpw c WHERE c.model_version = pl.model_version) AS comparison_size, round(pl.psi, 6) AS prediction_psi, round(pc.psi, 6) AS confidence_psi, CASE WHEN (SELECT count(*) FROM refw r WHERE r.model_version = pl.model_version) < {N} OR (SELECT count(*) FROM cmpw c WHERE c.model_version = pl.model_version) < {M // 2} THEN 'not_ready' WHEN greatest(pl.psi, pc.psi) >= 0.25 THEN 'critical' WHEN greatest(pl.psi, pc.psi) >= 0.1 THEN 'warning' ELSE 'healthy' END AS status FROM pl JOIN pc ON pc.model_version = pl.model_version"


@query("agg_drift_status", f"WITH {DRIFT} {STATUS}")
def _(t: Tables) -> DataFrame:
    return six(monitoring.drift(t.predictions, N, M), "prediction_psi", "confidence_psi")


@query("agg_health_snapshot", f"WITH {DRIFT}, st AS ({STATUS}), p AS (SELECT count(*) AS total, round(avg(confidence), 6) AS mean_confidence, round(100.0 * count_if(confidence < 0.6) / count(*), 6) AS low_confidence_rate FROM predictions), d AS (SELECT count_if(status = 'critical') AS critical, count(*) AS models FROM st) SELECT total, mean_confidence, low_confidence_rate, critical, models FROM p, d")
def _(t: Tables) -> DataFrame:
    a = monitoring.prediction_totals(t.predictions).select("total", "mean_confidence", "low_confidence_rate")
    b = monitoring.drift(t.predictions, N, M).agg(F.count_if(F.col("status") == "critical").alias("critical"), F.count("*").alias("models"))
    return six(a.join(F.broadcast(b)), "mean_confidence", "low_confidence_rate")
