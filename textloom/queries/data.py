"""Quality, sampling, feature and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..adapters import quoted as q
from ..functions.basic import rounded
from ..operators import features, quality, sampling
from ..operators.ranks import shuffled
from ..plans import bayes
from ..registry import query
from . import oracle_text as O

COUNTS = "counts AS (SELECT label, count(*) AS n FROM samples GROUP BY label)"


def sample_terms(t: Tables) -> DataFrame:
    """(id, label, domain, term): a sample's distinct lower-cased words."""
    return features.term_rows(t.samples, "id", F.split(F.lower("text"), r"\s+"), "label", "domain")


@query("agg_label_distribution", f"WITH {COUNTS} SELECT label, n, round(100.0 * n / (SELECT sum(n) FROM counts), 6) AS percent, round((SELECT min(n) * 1.0 / max(n) FROM counts), 6) AS balance FROM counts")
def _(t: Tables) -> DataFrame:
    return quality.label_distribution(t.samples).withColumns({"percent": rounded(F.col("percent")), "balance": rounded(F.col("balance"))})


@query("win_share_of_total", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM c")
def _(t: Tables) -> DataFrame:
    return quality.label_distribution(t["documents"], "lang").select("lang", "n", rounded(F.col("percent")).alias("percent"))


@query("agg_text_length_stats", "SELECT CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, round(avg(length(text)), 6) AS mean_length, round(quantile_cont(length(text), 0.5), 6) AS median_length FROM samples")
def _(t: Tables) -> DataFrame:
    return quality.length_stats(t.samples).withColumns({c: rounded(F.col(c)) for c in ("mean_length", "median_length")})


@query("agg_duplicates", "SELECT count(*) AS n, count(DISTINCT lower(trim(text))) AS unique_texts, count(*) - count(DISTINCT lower(trim(text))) AS duplicates FROM samples")
def _(t: Tables) -> DataFrame:
    return quality.duplicates(t.samples)


@query("agg_vocabulary_size", f"WITH {O.SAMPLE_WORDS} SELECT count(DISTINCT term) AS vocabulary FROM terms")
def _(t: Tables) -> DataFrame:
    return quality.vocabulary_size(t.samples)


@query("distinct_texts", "SELECT DISTINCT lower(text) AS text FROM samples")
def _(t: Tables) -> DataFrame:
    return t.samples.select(F.lower("text").alias("text")).distinct()


@query(
    "agg_quality_flags",
    f"WITH {COUNTS}, b AS (SELECT min(n) * 1.0 / max(n) AS b FROM counts), s AS (SELECT count(*) AS n, count(*) - count(DISTINCT lower(trim(text))) AS d, min(length(text)) AS lo, max(length(text)) AS hi FROM samples) SELECT b >= 0.8 AS balanced, d < 0.01 * n AS few_duplicates, lo > 10 AND hi < 100000 AS lengths_ok, b >= 0.8 AND d < 0.01 * n AND lo > 10 AND hi < 100000 AS all_ok FROM b, s",
)
def _(t: Tables) -> DataFrame:
    return quality.quality_flags(t.samples)


@query("agg_length_bias", "WITH m AS (SELECT label, avg(length(text)) AS m FROM samples GROUP BY label) SELECT label, round(m, 6) AS mean_length, (SELECT (max(m) - min(m)) / max(m) > 0.2 FROM m) AS biased FROM m")
def _(t: Tables) -> DataFrame:
    return quality.length_bias(t.samples).withColumn("mean_length", rounded(F.col("mean_length")))


@query("agg_duplicate_rate", "WITH p AS (SELECT text, count(*) AS n FROM samples GROUP BY text) SELECT round(count_if(n > 1) * 1.0 / sum(n), 6) AS duplicate_rate FROM p")
def _(t: Tables) -> DataFrame:
    return quality.duplicate_rate(t.samples).select(rounded(F.col("duplicate_rate")).alias("duplicate_rate"))


@query("agg_label_inconsistency", "WITH p AS (SELECT text, count(DISTINCT label) AS n FROM samples GROUP BY text) SELECT round(count_if(n > 1) * 1.0 / count(*), 6) AS inconsistency FROM p")
def _(t: Tables) -> DataFrame:
    return quality.label_inconsistency(t.samples).select(rounded(F.col("inconsistency")).alias("inconsistency"))


@query(
    "agg_label_noise",
    f"WITH m AS (SELECT label, regexp_matches(lower(text), {q('|'.join(quality.POSITIVE_WORDS))}) AS g, regexp_matches(lower(text), {q('|'.join(quality.NEGATIVE_WORDS))}) AS b FROM samples), s AS (SELECT count(*) AS sample_size, count_if((label = 'positive' AND b AND NOT g) OR (label = 'negative' AND g AND NOT b)) AS suspicious FROM m) SELECT sample_size, suspicious, round(suspicious * 1.0 / sample_size, 6) AS noise_rate FROM s",
)
def _(t: Tables) -> DataFrame:
    return quality.label_noise(t.samples).withColumn("noise_rate", rounded(F.col("noise_rate")))


@query("op_class_weights", f"WITH {COUNTS} SELECT label, round(CASE WHEN (SELECT max(n) * 1.0 / min(n) FROM counts) > 3 THEN (SELECT sum(n) FROM counts) * 1.0 / ((SELECT count(*) FROM counts) * n) ELSE 1 END, 6) AS weight FROM counts")
def _(t: Tables) -> DataFrame:
    return quality.class_weights(t.samples).withColumn("weight", rounded(F.col("weight")))


@query("op_imbalance_check", f"WITH {COUNTS} SELECT round(max(n) * 1.0 / min(n), 6) AS ratio, count(*) < 2 AS one_class, max(n) * 1.0 / min(n) > 10 AS imbalanced, sum(n) < 10 AS few_rows FROM counts")
def _(t: Tables) -> DataFrame:
    return quality.imbalance(t.samples).withColumn("ratio", rounded(F.col("ratio")))


# --- sampling and splits -----------------------------------------------------

SEED = 42
KEYED = "keyed AS (SELECT *, md5('42:' || CAST(id AS VARCHAR)) AS k FROM samples), numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM keyed)"
SPLIT = f"{KEYED}, splits AS (SELECT id, label, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM numbered)"
QUOTA = f"{COUNTS}, quota AS (SELECT label, n, greatest(1, CAST(floor(100 * n * 1.0 / (SELECT sum(n) FROM counts) + 0.5) AS BIGINT)) AS quota FROM counts), ordered AS (SELECT s.id, s.label, row_number() OVER (PARTITION BY s.label ORDER BY s.id) AS r FROM samples s)"


def split_samples(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.samples, 0.7, 0.15, 0.15, SEED, "id")


@query("src_quota_sample", f"WITH {QUOTA} SELECT o.id, o.label FROM ordered o JOIN quota q ON o.label = q.label WHERE o.r <= q.quota")
def _(t: Tables) -> DataFrame:
    return sampling.quota_sample(t.samples, 100, "id").select("id", "label")


@query("src_quota_sample_files", f"WITH {QUOTA} SELECT o.id, o.label FROM ordered o JOIN quota q ON o.label = q.label WHERE o.r <= q.quota")
def _(t: Tables) -> DataFrame:
    """The first lines of each class by their place in several text files, which
    hold the samples in the order of their ids; no column tells the order."""
    from ..sources import labeled, shared_path

    at, parts = shared_path(t.spark, "lines"), 4 * t.spark.sparkContext.defaultParallelism
    rows = t.samples.select("id", "label", "text").repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows.select(F.to_json(F.struct("id", "label", "text"))).write.text(at)
    lines = labeled.placed(t.spark, at).withColumn("row", F.from_json("value", "id long, label string"))
    return sampling.first_by_place(lines.select("row.*", "place"), 100).select("id", "label")


@query("src_quota_deviation", f"WITH {QUOTA} SELECT label, n, quota, least(n, quota) AS actual, round(abs(least(n, quota) - quota) * 1.0 / quota, 6) AS deviation FROM quota")
def _(t: Tables) -> DataFrame:
    sample = sampling.quota_sample(t.samples, 100, "id")
    return sampling.quota_deviation(sample, sampling.quotas(t.samples, 100)).withColumn("deviation", rounded(F.col("deviation")))


@query("src_seeded_sample", "SELECT id, label FROM samples ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return sampling.seeded_sample(t.samples, 50, SEED, "id").select("id", "label")


@query("sample_eval_rows", "WITH k AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS r FROM samples) SELECT id, domain FROM k WHERE r <= 2000")
def _(t: Tables) -> DataFrame:
    return shuffled(t.samples, ["domain"], SEED, "id").where("rank <= 2000").select("id", "domain")


@query("op_undersample", f"WITH {COUNTS}, {KEYED} SELECT id, label FROM numbered WHERE r <= (SELECT min(n) FROM counts) OR (SELECT min(n) >= 0.95 * max(n) FROM counts)")
def _(t: Tables) -> DataFrame:
    return sampling.undersample(t.samples, SEED, "id").select("id", "label")


@query("op_stratified_split", f"WITH {SPLIT} SELECT * FROM splits")
def _(t: Tables) -> DataFrame:
    return split_samples(t).select("id", "label", "split")


@query("op_kfold", f"WITH {KEYED} SELECT id, label, CAST((r - 1) % 5 AS INTEGER) AS fold FROM numbered")
def _(t: Tables) -> DataFrame:
    return sampling.folds(t.samples, 5, SEED, "id").select("id", "label", "fold")


@query("op_kfold_rounds", f"WITH {KEYED}, f AS (SELECT (r - 1) % 5 AS fold FROM numbered), x AS (SELECT fold, unnest(range(5)) AS round FROM f) SELECT CAST(round AS INTEGER) AS round, CASE WHEN fold = round THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM x GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return sampling.cross_validation(sampling.folds(t.samples, 5, SEED, "id"), 5).groupBy("round", "split").agg(F.count("*").alias("n"))


@query(
    "op_stratification_check",
    f"WITH {SPLIT}, c AS (SELECT split, label, count(*) AS n FROM splits GROUP BY 1, 2 UNION ALL SELECT 'original', label, count(*) FROM splits GROUP BY 2) SELECT split, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6) AS percent FROM c",
)
def _(t: Tables) -> DataFrame:
    return sampling.stratification(split_samples(t)).withColumn("percent", rounded(F.col("percent")))


@query("op_leakage_check", f"WITH {SPLIT}, d AS (SELECT s.text, count(DISTINCT p.split) AS splits FROM splits p JOIN samples s ON s.id = p.id GROUP BY s.text) SELECT text, splits FROM d WHERE splits > 1")
def _(t: Tables) -> DataFrame:
    """Texts that stand in more than one split (ids never do)."""
    return sampling.leaks(split_samples(t), "text")


@query("agg_class_balance", f"WITH {SPLIT} SELECT split, count_if(label = 'positive') AS positive, count_if(label = 'negative') AS negative FROM splits GROUP BY split")
def _(t: Tables) -> DataFrame:
    return split_samples(t).groupBy("split").pivot("label", ["positive", "negative"]).agg(F.count("id")).na.fill(0)


ROWS = "SELECT split, sha256(CAST(id AS VARCHAR) || chr(31) || label) AS h FROM splits"
CHECKSUM = f"{SPLIT}, h AS ({ROWS}), b AS (SELECT split, substring(h, 1, 3) AS k, sha256(string_agg(h, '' ORDER BY h)) AS own, count(*) AS n FROM h GROUP BY 1, 2), sums AS (SELECT split, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(own, '' ORDER BY k)) AS checksum FROM b GROUP BY split)"


@query("op_split_checksum", f"WITH {CHECKSUM} SELECT * FROM sums")
def _(t: Tables) -> DataFrame:
    return sampling.checksum(split_samples(t), ["id", "label"], [F.col("split")])


@query("op_split_verify", f"WITH {CHECKSUM} SELECT split, rows, true AS valid FROM sums")
def _(t: Tables) -> DataFrame:
    from ..operators.ranks import shuffle_key

    split = split_samples(t)
    own = sampling.checksum(split, ["id", "label"], [F.col("split")])
    again = sampling.checksum(split.repartition(7, shuffle_key(1, F.col("id"))), ["id", "label"], [F.col("split")])
    return own.join(again.withColumnsRenamed({"rows": "r", "checksum": "c"}), "split", "left").select("split", "rows", F.expr("coalesce(rows = r and checksum = c, false)").alias("valid"))


LANES = [f"sum(CAST(('0x' || substring(h, {15 * i + 1}, 15)) AS BIGINT))" for i in range(4)]


@query("op_split_multiset", f"WITH {SPLIT}, h AS ({ROWS}) SELECT split, count(*) AS rows, sha256(concat_ws(':', count(*), {', '.join(LANES)})) AS digest FROM h GROUP BY split")
def _(t: Tables) -> DataFrame:
    """The mergeable checksum of each split, added up from those of its labels."""
    parts = sampling.multiset(split_samples(t), ["id", "label"], [F.col("split"), F.col("label").alias("part")])
    return sampling.merged(parts, ["split"]).select("split", "rows", sampling.digest().alias("digest"))


@query("set_union", "SELECT DISTINCT term FROM (SELECT lang AS term FROM documents UNION SELECT source FROM documents)")
def _(t: Tables) -> DataFrame:
    d = t["documents"]
    return d.select(F.col("lang").alias("term")).unionByName(d.select(F.col("source").alias("term"))).distinct()


# --- features ----------------------------------------------------------------

VOCAB = "tf AS (SELECT term, count(*) AS tf FROM sample_words WHERE term <> '' GROUP BY term), dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term)"


def _cell(tc: str, a: str, b: str) -> str:
    return f"CASE WHEN {tc} > 0 THEN {tc} * 1.0 / n * ln({tc} * 1.0 * n / ({a} * 1.0 * {b})) ELSE 0 END"


MI = f"""{O.SAMPLE_WORDS}, {COUNTS}, lt AS (SELECT term, label, count(*) AS k FROM terms GROUP BY 1, 2), tt AS (SELECT term, sum(k) AS t FROM lt GROUP BY term),
grid AS (SELECT tt.term, tt.t, c.n AS c, (SELECT sum(n) FROM counts) AS n, coalesce(lt.k, 0) AS tc FROM tt CROSS JOIN counts c LEFT JOIN lt ON lt.term = tt.term AND lt.label = c.label),
mi AS (SELECT term, greatest(sum({_cell("tc", "t", "c")} + {_cell("(c - tc)", "(n - t)", "c")}), 0) AS mi FROM grid GROUP BY term)"""


def mutual(t: Tables) -> DataFrame:
    return features.mutual_information(sample_terms(t), sampling.label_counts(t.samples))


def words_of(t: Tables):
    return F.split(F.lower("text"), r"\s+")


@query("op_vocab_counts", f"WITH {O.SAMPLE_WORDS}, {VOCAB} SELECT tf.term, tf, df FROM tf JOIN dfs ON tf.term = dfs.term")
def _(t: Tables) -> DataFrame:
    return features.vocab_counts(t.samples, words_of(t))


@query("op_mutual_information", f"WITH {MI} SELECT term, round(mi, 6) AS mi FROM mi")
def _(t: Tables) -> DataFrame:
    return mutual(t).withColumn("mi", rounded(F.col("mi")))


# ties of a rounded score are broken by the term on both sides
@query("op_mi_top_k", f"WITH {MI}, {VOCAB}, top AS (SELECT term, round(mi, 9) AS m FROM mi ORDER BY 2 DESC, 1 LIMIT 200) SELECT top.term, tf, round(m, 6) AS mi, round((SELECT sum(m) FROM top) / (SELECT sum(round(mi, 9)) FROM mi), 6) AS kept FROM top JOIN tf ON top.term = tf.term")
def _(t: Tables) -> DataFrame:
    mi = mutual(t).withColumn("mi", F.round("mi", 9))
    top = features.top_terms(mi, 200)
    share = top.agg(F.sum("mi").alias("a")).join(F.broadcast(mi.agg(F.sum("mi").alias("b")))).select((F.col("a") / F.col("b")).alias("kept"))
    out = top.join(features.vocab_counts(t.samples, words_of(t)).select("term", "tf"), "term").join(F.broadcast(share))
    return out.select("term", "tf", rounded(F.col("mi")).alias("mi"), rounded(F.col("kept")).alias("kept"))


@query("top_mi_terms", f"WITH {MI} SELECT term, round(mi, 6) AS mi FROM (SELECT term, round(mi, 9) AS mi FROM mi) ORDER BY round(mi, 9) DESC, term LIMIT 50")
def _(t: Tables) -> DataFrame:
    top = features.top_terms(mutual(t).withColumn("mi", F.round("mi", 9)), 50)
    return top.select("term", rounded(F.col("mi")).alias("mi"))


@query("top_terms_per_class", f"WITH {O.SAMPLE_WORDS}, c AS (SELECT label, term, count(*) AS n FROM terms GROUP BY 1, 2), r AS (SELECT label, term, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rank FROM c) SELECT label, term, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100")
def _(t: Tables) -> DataFrame:
    return features.top_terms_per_class(sample_terms(t), 100)


def class_vocabulary(t: Tables) -> DataFrame:
    """(term): the union of each class's 5000 commonest terms."""
    return features.top_terms_per_class(sample_terms(t), 5000).select("term").distinct()


TOP = "ranked AS (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) AS r FROM terms GROUP BY 1, 2), vocab AS (SELECT DISTINCT term FROM ranked WHERE r <= 5000)"


@query(
    "op_vectorize",
    f"WITH {O.SAMPLE_WORDS}, {TOP}, c AS (SELECT w.id, w.term, count(*) AS tf FROM sample_words w JOIN vocab v ON v.term = w.term GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT c.id, c.term, round(ln(1 + tf) * ln(((SELECT count(*) FROM samples) + 1) * 1.0 / (df + 1)), 6) AS weight FROM c JOIN d ON c.term = d.term",
)
def _(t: Tables) -> DataFrame:
    vocab = class_vocabulary(t)
    return features.tf_idf(t.samples, "id", words_of(t), vocab).withColumn("weight", rounded(F.col("weight")))


NORMAL = f"""{O.SAMPLE_WORDS}, {TOP}, {COUNTS}, x AS (SELECT w.id, w.label, w.term, count(*)::DOUBLE AS x FROM sample_words w JOIN vocab v ON v.term = w.term GROUP BY 1, 2, 3),
sums AS (SELECT label, term, sum(x) AS s, sum(x * x) AS ss FROM x GROUP BY 1, 2),
moments AS (SELECT c.label, v.term, coalesce(s, 0) / c.n AS mean, coalesce(ss, 0) / c.n AS square FROM vocab v CROSS JOIN counts c LEFT JOIN sums ON sums.term = v.term AND sums.label = c.label),
normal AS (SELECT label, term, mean, greatest(sqrt(greatest(square - mean * mean, 0)), 1::DOUBLE / 6) AS sd FROM moments)"""


def normal_bayes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model in closed form, the counts of the classes, (id, term, x)."""
    vocab = class_vocabulary(t)
    rows = t.samples.select("id", "label", F.explode(words_of(t)).alias("term")).join(vocab, "term", "left_semi")
    rows = rows.groupBy("id", "label", "term").agg(F.count("*").cast("double").alias("x"))
    counts = sampling.label_counts(t.samples)
    return bayes.fit(rows, counts, vocab), counts, rows


@query("ml_normal_bayes_moments", f"WITH {NORMAL} SELECT label, term, round(mean, 6) AS mean, round(sd, 6) AS sd FROM normal")
def _(t: Tables) -> DataFrame:
    """Mean and deviation of every term in every class, zeros included."""
    model, _, _ = normal_bayes(t)
    return model.select("label", "term", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))


@query(
    "ml_normal_bayes_scores",
    f"""WITH {NORMAL}, start AS (SELECT m.label, sum(-ln(sd) - mean * mean / (2 * sd * sd)) + ln((c.n + 1.0::DOUBLE) / ((SELECT sum(n) + count(*) FROM counts))) AS start FROM normal m JOIN counts c ON c.label = m.label GROUP BY m.label, c.n),
    gains AS (SELECT x.id, m.label, sum((2 * x.x * m.mean - x.x * x.x) / (2 * m.sd * m.sd)) AS gain FROM x JOIN normal m ON m.term = x.term GROUP BY 1, 2),
    scores AS (SELECT p.id, s.label, s.start + coalesce(g.gain, 0) AS score FROM samples p CROSS JOIN start s LEFT JOIN gains g ON g.id = p.id AND g.label = s.label)
    SELECT id, label, round(exp(score - max(score) OVER w) / sum(exp(score - top)) OVER w, 6) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scores) WINDOW w AS (PARTITION BY id)""",
)
def _(t: Tables) -> DataFrame:
    """Every row's probability of every class, the rows being those fitted on."""
    model, counts, rows = normal_bayes(t)
    out = bayes.score(model, counts, t.samples, rows.select("id", "term", "x"))
    return out.select("id", "label", rounded(F.col("prob")).alias("prob"))


@query("op_vocab_overlap", f"WITH {O.SAMPLE_WORDS}, a AS (SELECT DISTINCT term FROM terms WHERE domain = 'en'), b AS (SELECT DISTINCT term FROM terms WHERE domain = 'de') SELECT count_if(term IN (SELECT term FROM b)) AS shared, count(*) AS total, round(count_if(term IN (SELECT term FROM b)) * 1.0 / count(*), 6) AS ratio FROM a")
def _(t: Tables) -> DataFrame:
    rows = sample_terms(t)
    return features.vocab_overlap(rows.where("domain = 'en'"), rows.where("domain = 'de'")).withColumn("ratio", rounded(F.col("ratio")))


WEIGHTS = "weights AS (SELECT term, round(mi * CASE WHEN ascii(term) % 2 = 0 THEN 1 ELSE -1 END, 9) AS weight FROM mi)"


def weights(t: Tables) -> DataFrame:
    """A signed weight per term: its information, the sign by its first letter."""
    sign = F.when(F.ascii("term") % 2 == 0, 1).otherwise(-1)
    return mutual(t).select("term", F.round(F.col("mi") * sign, 9).alias("weight"))


@query("ml_linear_score_sql", f"WITH {MI}, {WEIGHTS}, s AS (SELECT t.id, sum(w.weight) AS s FROM terms t JOIN weights w ON w.term = t.term GROUP BY t.id) SELECT p.id, round(coalesce(s, 0) + 0.25, 6) AS score FROM samples p LEFT JOIN s ON s.id = p.id")
def _(t: Tables) -> DataFrame:
    return features.linear_scores(t.samples, "id", words_of(t), weights(t), 0.25).withColumn("score", rounded(F.col("score")))


@query("agg_feature_stats", f"WITH {MI}, {WEIGHTS} SELECT round(avg(abs(weight)), 6) AS mean, round(stddev_pop(abs(weight)), 6) AS std, round(quantile_cont(abs(weight), 0.5), 6) AS median, round(quantile_cont(abs(weight), 0.95), 6) AS p95, count(*) AS n FROM weights")
def _(t: Tables) -> DataFrame:
    return features.weight_stats(weights(t)).select(*[rounded(F.col(c)).alias(c) for c in ("mean", "std", "median", "p95")], "n")


@query("agg_feature_stats_floor", f"WITH {MI}, {WEIGHTS}, o AS (SELECT abs(weight) AS w, row_number() OVER (ORDER BY abs(weight)) AS r, count(*) OVER () AS n FROM weights) SELECT round((SELECT avg(w) FROM o), 6) AS mean, round((SELECT stddev_pop(w) FROM o), 6) AS std, round(w, 6) AS p95, n FROM o WHERE r = floor(0.95 * (n - 1)) + 1")
def _(t: Tables) -> DataFrame:
    return features.weight_floor(weights(t)).select(*[rounded(F.col(c)).alias(c) for c in ("mean", "std", "p95")], "n")


BAYES = f"""{O.SAMPLE_WORDS}, {SPLIT}, tr AS (SELECT t.id, t.label, t.term FROM terms t JOIN splits s ON s.id = t.id WHERE s.split = 'train'),
cls AS (SELECT label, count(*) AS n FROM splits WHERE split = 'train' GROUP BY label),
kt AS (SELECT label, term, count(*) AS k FROM tr GROUP BY 1, 2), rk AS (SELECT term, row_number() OVER (PARTITION BY label ORDER BY k DESC, term) AS r FROM kt), vocab AS (SELECT DISTINCT term FROM rk WHERE r <= 5000),
mu AS (SELECT c.label, v.term, coalesce(kt.k, 0) * 1.0::DOUBLE / c.n AS mean FROM vocab v CROSS JOIN cls c LEFT JOIN kt ON kt.term = v.term AND kt.label = c.label),
sd AS (SELECT label, term, mean, greatest(sqrt(greatest(mean - mean * mean, 0)), 1.0::DOUBLE / 6) AS sd FROM mu),
zero AS (SELECT sd.label, sum(-ln(sd) - mean * mean / (2 * sd * sd)) + ln((any_value(cls.n) + 1) * 1.0::DOUBLE / (SELECT sum(n) + count(*) FROM cls)) AS start FROM sd JOIN cls ON cls.label = sd.label GROUP BY sd.label),
te AS (SELECT id, label FROM splits WHERE split = 'test'),
gain AS (SELECT t.id, sd.label, sum((2 * mean - 1) / (2 * sd * sd)) AS g FROM terms t JOIN te ON te.id = t.id JOIN sd ON sd.term = t.term GROUP BY 1, 2),
sc AS (SELECT te.id, te.label AS actual, z.label, start + coalesce(g, 0) AS s FROM te CROSS JOIN zero z LEFT JOIN gain ON gain.id = te.id AND gain.label = z.label),
pr AS (SELECT id, actual, label, s, exp(s - max(s) OVER w) / sum(exp(s - (SELECT max(x.s) FROM sc x WHERE x.id = sc.id))) OVER w AS prob FROM sc WINDOW w AS (PARTITION BY id))"""


@query("ml_gaussian_bayes", f"WITH {BAYES} SELECT id, actual, max_by(label, s) AS predicted, round(max(prob), 6) AS prob FROM pr GROUP BY id, actual")
def _(t: Tables) -> DataFrame:
    """Test rows under normal distributions per class and term, fitted on the
    train rows' presence of 5000 terms of each class."""
    from ..plans import bayes

    split = split_samples(t).select("id", "label", "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'").withColumnRenamed("label", "actual")
    rows = sample_terms(t).select("id", "label", "term", F.lit(1.0).alias("x"))
    own = rows.join(train.select("id"), "id", "left_semi")
    vocab = features.top_terms_per_class(own, 5000).select("term").distinct()
    counts = sampling.label_counts(train)
    scores = bayes.score(bayes.fit(own, counts, vocab), counts, test, rows.drop("label").join(test.select("id"), "id", "left_semi"))
    best = scores.groupBy("id").agg(F.max_by("label", "score").alias("predicted"), F.max("prob").alias("prob"))
    return test.select("id", "actual").join(best, "id").select("id", "actual", "predicted", rounded(F.col("prob")).alias("prob"))


@query("op_direction", f"WITH {MI}, {WEIGHTS} SELECT term, CASE WHEN weight > 0 THEN 'positive' WHEN weight < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM weights")
def _(t: Tables) -> DataFrame:
    from ..functions.labels import direction

    return weights(t).select("term", direction(F.col("weight")).alias("direction"))


TOPK = f"WITH {MI}, {WEIGHTS}, r AS (SELECT term, weight, row_number() OVER (ORDER BY abs(weight) DESC, term) AS rank FROM weights)"


@query("top_features", f"{TOPK} SELECT term, round(weight, 6) AS weight FROM r WHERE rank <= 100")
def _(t: Tables) -> DataFrame:
    return weights(t).orderBy(F.desc(F.abs("weight")), "term").limit(100).select("term", rounded(F.col("weight")).alias("weight"))


@query("win_rank_features", f"{TOPK} SELECT term, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 1000")
def _(t: Tables) -> DataFrame:
    """Ranks of the thousand largest weights (a bounded report)."""
    from pyspark.sql import Window

    top = weights(t).orderBy(F.desc(F.abs("weight")), "term").limit(1000)
    return top.select("term", F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "term")).alias("rank"))


@query("join_mi_tf", f"WITH {MI}, {VOCAB} SELECT mi.term, tf, round(mi, 6) AS mi FROM mi JOIN tf ON tf.term = mi.term")
def _(t: Tables) -> DataFrame:
    return mutual(t).join(features.vocab_counts(t.samples, words_of(t)), "term").select("term", "tf", rounded(F.col("mi")).alias("mi"))


@query("join_vocab_weights", f"WITH {MI}, {WEIGHTS}, {VOCAB}, big AS (SELECT term, weight FROM weights WHERE abs(weight) >= 0.001) SELECT tf.term, round(coalesce(big.weight, 0), 6) AS weight FROM tf LEFT JOIN big ON big.term = tf.term")
def _(t: Tables) -> DataFrame:
    big = weights(t).where(F.abs("weight") >= 0.001)
    out = features.vocab_counts(t.samples, words_of(t)).join(big, "term", "left")
    return out.select("term", rounded(F.coalesce("weight", F.lit(0.0))).alias("weight"))
