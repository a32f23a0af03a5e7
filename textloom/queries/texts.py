"""Label, cleaning and token queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..adapters import quoted as q
from ..functions import labels as L
from ..functions import text as T
from ..functions import tokens as K
from ..functions.basic import rounded
from ..operators import quality
from ..registry import query
from . import oracle_text as O


def case_label(x: str) -> str:
    key = f"lower(trim({x}))"
    return (
        f"CASE WHEN {key} IN {O.words(L.POSITIVE)} THEN 'positive' WHEN {key} IN {O.words(L.NEGATIVE)} THEN 'negative' WHEN {key} IN {O.words(L.NEUTRAL)} THEN 'neutral'"
        f" WHEN try_cast({key} AS DOUBLE) <= 2 THEN 'negative' WHEN try_cast({key} AS DOUBLE) >= 4 THEN 'positive' WHEN try_cast({key} AS DOUBLE) IS NOT NULL THEN 'neutral' END"
    )


@query("op_label_normalize", f"SELECT doc_id, {case_label('raw_label')} AS label FROM raw_labels")
def _(t: Tables) -> DataFrame:
    return t.raw_labels.select("doc_id", L.normalize(F.col("raw_label")).alias("label"))


@query("op_label_num", f"SELECT doc_id, CASE {case_label('raw_label')} WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END AS label_num FROM raw_labels")
def _(t: Tables) -> DataFrame:
    return t.raw_labels.select("doc_id", L.number(L.normalize(F.col("raw_label"))).alias("label_num"))


REJECT = f"CASE WHEN trim(text) = '' THEN 'empty_text' WHEN raw_label IS NULL OR trim(raw_label) = '' THEN 'empty_label' WHEN {case_label('raw_label')} IS NULL THEN 'unknown_label' WHEN {case_label('raw_label')} = 'neutral' THEN 'neutral_label' WHEN length(trim(text)) > 10000 THEN 'text_too_long' END"


@query("src_row_rejects", f"SELECT coalesce({REJECT}, 'accepted') AS reason, count(*) AS n FROM raw_labels GROUP BY 1")
def _(t: Tables) -> DataFrame:
    reason = F.coalesce(L.reject_reason(F.col("text"), F.col("raw_label")), F.lit("accepted"))
    return t.raw_labels.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("op_sample_validate", "SELECT id, CASE WHEN trim(text) = '' THEN 'blank_text' WHEN length(text) > 10000 THEN 'text_too_long' WHEN NOT (confidence * 1.1 BETWEEN 0 AND 1) THEN 'confidence_out_of_range' END AS reason FROM samples")
def _(t: Tables) -> DataFrame:
    return t.samples.select("id", L.invalid_reason(F.col("text"), F.col("confidence") * 1.1).alias("reason"))


@query("op_high_confidence", "SELECT id, confidence FROM samples WHERE confidence >= 0.8")
def _(t: Tables) -> DataFrame:
    return t.samples.where(F.col("confidence") >= L.HIGH_CONFIDENCE).select("id", "confidence")


@query("op_source_filter", "SELECT id, source FROM samples WHERE lower(source) = 'src3'")
def _(t: Tables) -> DataFrame:
    return t.samples.where(F.lower("source") == "SRC3".lower()).select("id", "source")


@query("op_text_length", "SELECT id, length(text) AS n FROM samples")
def _(t: Tables) -> DataFrame:
    return t.samples.select("id", F.length("text").alias("n"))


@query("op_threshold_uncertain", "SELECT event_id, CASE WHEN confidence < 0.5 THEN 'uncertain' ELSE predicted_label END AS label, CASE WHEN confidence < 0.75 THEN 'low confidence' END AS warning FROM predictions")
def _(t: Tables) -> DataFrame:
    c = F.col("confidence")
    return t.predictions.select("event_id", L.with_threshold(F.col("predicted_label"), c, F.lit(0.5)).alias("label"), L.confidence_warning(c).alias("warning"))


def step(name: str, sql: str, fn) -> None:
    query(name, f"SELECT doc_id, {sql} AS text FROM decorated")(lambda t: t.decorated.select("doc_id", fn(F.col("text")).alias("text")))


step("op_url_token", O.rr("text", T.URL, " url_token "), T.url_token)
step("op_email_token", O.rr("text", rf"\b{T.EMAIL}\b", " email_token "), T.email_token)
step("op_mention_token", O.rr("text", T.MENTION, " mention_token "), T.mention_token)
step("op_hashtag_token", f"lower({O.rr('text', T.HASHTAG, r' hashtag_\1 ')})", lambda x: F.lower(T.hashtag_token(x)))
step("op_emoticons", O.emoticons("text"), T.emoticons)
step("op_strip_html", O.rr("text", T.HTML, " "), T.strip_html)
step("op_expand_contractions", O.contractions("text"), T.expand_contractions)
step("op_lowercase", "lower(text)", F.lower)
step("op_squeeze_repeats", O.squeeze("lower(text)"), lambda x: T.squeeze_repeats(F.lower(x)))
step("op_squeeze_space", f"trim({O.rr('text', r'\s+', ' ')})", T.squeeze_space)
step("op_truncate", "CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END", lambda x: T.truncate(x, 80))
step("op_text_hash", "substring(sha256(substring(text, 1, 10000)), 1, 16)", T.text_hash)
SANITIZED = f"trim({O.rr(O.rr('text', r'[^A-Za-z0-9_\s]', ' '), r'\s+', ' ')})"
step("op_sanitize_features", f"CASE WHEN {SANITIZED} = '' THEN 'empty_content_placeholder' ELSE {SANITIZED} END", T.sanitize_features)


@query("op_has_contractions", f"SELECT doc_id, regexp_matches(text, {q(O.ANY_CONTRACTION)}) AS has FROM decorated")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", (T.count_contractions(F.col("text")) > 0).alias("has"))


@query("op_count_contractions", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {q(O.ANY_CONTRACTION)})) AS INTEGER) AS n FROM decorated")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", T.count_contractions(F.col("text")).alias("n"))


@query("op_contraction_stats", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), " + q(O.ANY_CONTRACTION) + ")) AS w FROM decorated) GROUP BY w")
def _(t: Tables) -> DataFrame:
    """Uses of each dictionary entry in the corpus."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(T.ANY_CONTRACTION), F.lit(0))
    return t.decorated.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("op_contraction_totals", "SELECT count(*) AS uses, count_if(regexp_matches(w, 'n.?t$') OR w IN ('cannot')) AS negative FROM (SELECT unnest(regexp_extract_all(lower(text), " + q(O.ANY_CONTRACTION) + ")) AS w FROM decorated)")
def _(t: Tables) -> DataFrame:
    """Uses of contractions in the corpus, and of those that negate."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(T.ANY_CONTRACTION), F.lit(0))
    rows = t.decorated.select(F.explode(found).alias("w"))
    return rows.agg(F.count("*").alias("uses"), F.count_if(F.col("w").isin(*T.negative_contractions())).alias("negative"))


@query("op_clean_text", f"WITH {O.CLEAN} SELECT doc_id, text FROM cleaned")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", T.clean_text(F.col("text")).alias("text"))


def _n(p: str) -> str:
    return f"CAST(sum(len(regexp_extract_all(text, {q(p)}))) AS BIGINT)"


@query(
    "op_cleaning_metrics",
    f"SELECT {_n(T.URL)} AS urls, {_n(chr(92) + 'b' + T.EMAIL + chr(92) + 'b')} AS emails, {_n(T.MENTION)} AS mentions, {_n(T.HASHTAG)} AS hashtags, {_n(T.HTML)} AS tags, {_n(T.HAPPY)} AS happy, {_n(T.SAD)} AS sad,"
    f" count_if(regexp_matches(text, {q(O.ANY_CONTRACTION)})) AS has_contractions, count_if({O.squeeze('text')} <> text) AS has_repeats FROM decorated",
)
def _(t: Tables) -> DataFrame:
    counts = T.cleaning_counts(F.col("text"))
    return t.decorated.select(*[c.alias(n) for n, c in counts.items()]).agg(*[F.sum(n).alias(n) for n in counts])


@query("op_infer_dataset_name", "SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)/[^/]+$', 1) = '' THEN regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1) ELSE regexp_extract(url, '([^/]+)/[^/]+$', 1) END AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", T.dataset_name(F.col("url")).alias("name"))


@query("op_hyphen_compounds", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, {q(chr(92) + 'b' + K.COMPOUND + chr(92) + 'b')}), lambda c: {O.valid('c')}), ' ') AS compounds FROM decorated")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", F.array_join(K.compounds(F.col("text")), " ").alias("compounds"))


SPLIT = O.split_steps("decorated", "s")


@query("op_tokenize", f"WITH {SPLIT} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM s_split")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", F.array_join(K.split_tokens(F.col("text")), " ").alias("tokens"))


@query("op_token_filter", f"WITH {SPLIT}, {O.filtered_step('s_split', 'f')} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM f")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", F.array_join(K.tokenize(F.col("text")), " ").alias("tokens"))


@query("op_token_metrics", f"WITH {SPLIT}, x AS (SELECT unnest(tokens) AS t FROM s_split) SELECT {O.reason('t', False)} AS reason, count(*) AS n FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.decorated.select(F.explode(K.split_tokens(F.col("text"))).alias("t"))
    return rows.groupBy(K.drop_reason(F.col("t"), False, 2).alias("reason")).agg(F.count("*").alias("n"))


TYPE = f"CASE WHEN regexp_full_match(t, {q(K.COMPOUND)}) THEN 'hyphenated' WHEN regexp_full_match(t, '\\w+''\\w+') THEN 'contraction' WHEN regexp_full_match(t, {q(K.NUMBER)}) THEN 'number' WHEN regexp_full_match(t, '[^a-zA-Z0-9]+') THEN 'punctuation' WHEN length(t) = 1 THEN 'single_char' WHEN regexp_full_match(t, '\\w+') THEN 'word' ELSE 'other' END"


@query("op_token_type", f"WITH {SPLIT}, x AS (SELECT unnest(tokens) AS t FROM s_split) SELECT {TYPE} AS type, count(*) AS n FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.decorated.select(F.explode(K.split_tokens(F.col("text"))).alias("t"))
    return rows.groupBy(K.token_type(F.col("t")).alias("type")).agg(F.count("*").alias("n"))


def _c(p: str) -> str:
    return f"CAST(len(regexp_extract_all(text, {q(p)})) AS INTEGER)"


@query("op_tokenization_analysis", f"SELECT doc_id, {_c(chr(92) + 'b' + K.COMPOUND + chr(92) + 'b')} AS hyphenated, {_c(chr(92) + 'b' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?' + chr(92) + 'b')} AS numbers, {_c('[.!?]+|[,;:]+')} AS punctuation, CAST(len(string_split_regex(text, '\\s+')) AS INTEGER) AS words FROM decorated")
def _(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p))
    return t.decorated.select("doc_id", n(T.B + K.COMPOUND + T.B).alias("hyphenated"), n(T.B + r"\d+(?:\.\d+)?" + T.B).alias("numbers"), n(r"[.!?]+|[,;:]+").alias("punctuation"), F.size(F.split("text", r"\s+")).alias("words"))


@query("op_tokenization_compare", f"WITH {SPLIT}, {O.filtered_step('s_split', 'f')} SELECT d.doc_id, len(string_split_regex(d.text, '\\s+')) AS simple, len(f.tokens) AS full_, abs(len(string_split_regex(d.text, '\\s+')) - len(f.tokens)) AS diff FROM decorated d JOIN f ON d.doc_id = f.doc_id")
def _(t: Tables) -> DataFrame:
    rows = t.decorated.select("doc_id", F.size(F.split("text", r"\s+")).cast("long").alias("simple"), F.size(K.tokenize(F.col("text"))).cast("long").alias("full_"))
    return rows.withColumn("diff", F.abs(F.col("simple") - F.col("full_")))


@query("op_negation_scope", f"WITH {O.TOKENS}, {O.negation_steps('tokenized', 'negated')} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM negated")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", F.array_join(K.negation_scope(K.tokenize(T.clean_text(F.col("text")))), " ").alias("tokens"))


SIMPLE = "simple AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s.,;]+'), lambda w: w <> '') AS tokens FROM decorated)"


def simple_tokens(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[\s.,;]+"), lambda w: w != "")
    return t.decorated.select("doc_id", words.alias("tokens"))


for _strategy in ("basic", "extended", "minimal", "sentiment_aware"):
    query(f"op_stopwords_{_strategy.split('_')[0]}", f"WITH {SIMPLE}, {O.kept_step('simple', 'k', _strategy)} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM k")(
        lambda t, s=_strategy: simple_tokens(t).select("doc_id", F.array_join(K.remove_stopwords(F.col("tokens"), s), " ").alias("tokens"))
    )


@query("op_protected_phrases", f"WITH {SIMPLE} SELECT doc_id, array_to_string(list_filter(tokens, lambda t, i: {O.phrase('tokens', 'i')}), ' ') AS kept FROM simple")
def _(t: Tables) -> DataFrame:
    own = F.col("tokens")
    return simple_tokens(t).select("doc_id", F.array_join(F.filter(own, lambda x, i: K.in_phrase(own, i)), " ").alias("kept"))


@query(
    "op_stopword_analysis",
    f"WITH {SIMPLE}, x AS (SELECT unnest(tokens) AS t FROM simple) SELECT count(*) AS total, count_if({O.stopword('t', 'basic')}) AS basic, count_if({O.stopword('t', 'extended')}) AS extended, count_if({O.stopword('t', 'sentiment_aware')}) AS sentiment_aware, count_if(t IN {O.words(K.NEGATIONS)}) AS negations, count_if(t IN {O.words(K.INTENSIFIERS)}) AS intensifiers FROM x",
)
def _(t: Tables) -> DataFrame:
    rows, w = simple_tokens(t).select(F.explode("tokens").alias("t")), F.col("t")
    removed = [F.count_if(K.is_stopword(w, s)).alias(s) for s in ("basic", "extended", "sentiment_aware")]
    return rows.agg(F.count("*").alias("total"), *removed, F.count_if(w.isin(*K.NEGATIONS)).alias("negations"), F.count_if(w.isin(*K.INTENSIFIERS)).alias("intensifiers"))


@query(
    "op_stopword_compare",
    f"WITH {SIMPLE}, "
    + ", ".join(O.kept_step("simple", f"k_{s}", s) for s in ("basic", "extended", "minimal", "sentiment_aware"))
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT '{s}' AS strategy, sum(len(k.tokens)) AS n FROM k_{s} k" for s in ("basic", "extended", "minimal", "sentiment_aware"))
    + ") SELECT strategy, CAST(n AS BIGINT) AS tokens, round(100.0 * n / (SELECT sum(len(tokens)) FROM simple), 6) AS retention FROM u",
)
def _(t: Tables) -> DataFrame:
    names = ("basic", "extended", "minimal", "sentiment_aware")
    # Words are split once, and of a text only what a list can remove goes on.
    rows = simple_tokens(t).select(F.size("tokens").alias("n"), K.removable(F.col("tokens")).alias("out"))
    rows = rows.select("n", F.posexplode_outer("out").alias("i", "w"))
    gone = rows.agg(F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))).alias("total"), *[F.count_if(K.is_stopword(F.col("w"), s)).alias(s) for s in names])
    sums = gone.select("total", *[(F.col("total") - F.col(s)).alias(s) for s in names])
    long = sums.unpivot("total", list(names), "strategy", "tokens")
    return long.select("strategy", "tokens", rounded(100.0 * F.col("tokens") / F.col("total")).alias("retention"))


@query("op_preprocess", f"WITH {O.PIPELINE} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM kept")
def _(t: Tables) -> DataFrame:
    return t.decorated.select("doc_id", F.array_join(K.preprocess(F.col("text")), " ").alias("tokens"))


@query(
    "op_preprocessing_stats",
    f"WITH {O.PIPELINE}, o AS (SELECT count(*) AS n, sum(len(string_split_regex(text, '\\s+'))) AS o FROM decorated), c AS (SELECT sum(len(string_split_regex(text, '\\s+'))) AS c FROM cleaned), k AS (SELECT sum(len(tokens)) AS k FROM kept) SELECT n AS texts, CAST(o AS BIGINT) AS original, CAST(c AS BIGINT) AS cleaned, CAST(k AS BIGINT) AS filtered, round(k / o, 6) AS compression, round(c / o, 6) AS efficiency, round(k / c, 6) AS filtering FROM o, c, k",
)
def _(t: Tables) -> DataFrame:
    words = lambda c: F.size(F.split(c, r"\s+"))
    # A text is cleaned once; the optimiser leaves a costly column that is used twice where it is.
    rows = t.decorated.select(words(F.col("text")).alias("o"), T.clean_text(F.col("text")).alias("clean"))
    rows = rows.select("o", words(F.col("clean")).alias("c"), F.size(K.preprocess_clean(F.col("clean"))).alias("k"))
    sums = rows.agg(F.count("*").alias("texts"), F.sum("o").alias("original"), F.sum("c").alias("cleaned"), F.sum("k").alias("filtered"))
    ratio = lambda a, b: rounded(F.col(a) / F.col(b))
    return sums.withColumns({"compression": ratio("filtered", "original"), "efficiency": ratio("cleaned", "original"), "filtering": ratio("filtered", "cleaned")})


@query("op_ngrams", f"WITH {SIMPLE}, g AS (SELECT doc_id, list_concat(tokens, list_transform(range(1, greatest(len(tokens), 1)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS g FROM simple) SELECT doc_id, array_to_string(g, '|') AS grams FROM g")
def _(t: Tables) -> DataFrame:
    return simple_tokens(t).select("doc_id", F.array_join(K.ngrams(F.col("tokens")), "|").alias("grams"))


@query(
    "win_negation_scope",
    f"WITH {O.TOKENS}, {O.negation_steps('tokenized', 'negated')}, x AS (SELECT unnest(tokens) AS t FROM negated) SELECT count_if(t LIKE 'NOT\\_%' ESCAPE '\\') AS tagged, count(*) AS total FROM x",
)
def _(t: Tables) -> DataFrame:
    rows = t.decorated.select(F.explode(K.negation_scope(K.tokenize(T.clean_text(F.col("text"))))).alias("t"))
    return rows.agg(F.count_if(F.col("t").startswith("NOT_")).alias("tagged"), F.count("*").alias("total"))


@query("win_phrase_neighbors", f"WITH {SIMPLE}, x AS (SELECT doc_id, unnest(list_filter(tokens, lambda t, i: {O.phrase('tokens', 'i')})) AS t FROM simple) SELECT t, count(*) AS n FROM x GROUP BY t")
def _(t: Tables) -> DataFrame:
    """Words of protected pairs, found with the neighbours on both sides."""
    from pyspark.sql import Window

    rows = simple_tokens(t).select("doc_id", F.posexplode("tokens").alias("pos", "t"))
    own = Window.partitionBy("doc_id").orderBy("pos")
    pairs = [f"{a} {b}" for a, ends in K.PHRASES.items() for b in ends]
    rows = rows.withColumn("after", F.concat_ws(" ", "t", F.lead("t").over(own))).withColumn("before", F.concat_ws(" ", F.lag("t").over(own), "t"))
    return rows.where(F.col("after").isin(*pairs) | F.col("before").isin(*pairs)).groupBy("t").agg(F.count("*").alias("n"))


@query("join_stopwords", f"WITH {SIMPLE}, x AS (SELECT unnest(tokens) AS term FROM simple) SELECT term, count(*) AS n FROM x WHERE term NOT IN {O.words(K.EXTENDED)} GROUP BY term")
def _(t: Tables) -> DataFrame:
    """The relational form: an anti join with the word list."""
    words = t.spark.createDataFrame([(w,) for w in set(K.EXTENDED)], "term string")
    rows = simple_tokens(t).select(F.explode("tokens").alias("term"))
    return rows.join(F.broadcast(words), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


@query("limit_suspicious_examples", f"WITH s AS (SELECT id, label, lower(text) AS low FROM samples), m AS (SELECT id, label, regexp_matches(low, {q('|'.join(quality.POSITIVE_WORDS))}) AS g, regexp_matches(low, {q('|'.join(quality.NEGATIVE_WORDS))}) AS b FROM s) SELECT id, label FROM m WHERE (label = 'positive' AND b AND NOT g) OR (label = 'negative' AND g AND NOT b) ORDER BY id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return quality.suspicious(t.samples).select("id", "label").orderBy("id").limit(10)
