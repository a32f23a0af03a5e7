"""The registered queries of the training-data operators.

Each takes (spark, sf_dir), reads whole tables and derives the digest columns
of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, licenses, lines, lmscore, neardup, packing, quality, search, sharding, suffixes, tokens, warc
from .common import Scratch, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; the files are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, least=0.8)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=40)


def op3_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents"), depth=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "archives").path("pages")
    warc.write(table(spark, sf_dir, "pages"), at, least=1000)
    return warc.read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.aligned(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).drop("groups")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_sort": op3_suffix_sort,
    "op4_quality": op4_quality,
    "op5_line_templates": op5_line_templates,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_simhash": op9_simhash,
    "op10_elias_fano": op10_elias_fano,
    "op11_license_templates": op11_license_templates,
    "op12_alignment": op12_alignment,
    "op13_block_max": op13_block_max,
}

ORACLE: dict[str, str] = {
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
        CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to FROM q""",
    "op11_license_templates": licenses.sql(),
    "op13_block_max": search.SQL,
}
