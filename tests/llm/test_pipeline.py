"""The corpus pipeline against a walk through its stages."""

from collections import Counter

import corpus_pipeline
from textloom.llm import decontam, quality
from textloom.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "t")
    given = {r.doc_id for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        seen[name] = docs
    for name in list(seen)[:-1]:
        assert seen[name].columns == columns, name
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    judged = quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert set(ids["quality_rules"]) == {r.doc_id for r in judged if r.kept} and set(ids["quality_rules"]) < given
    assert Counter(ids["line_dedup"]) == Counter(ids["quality_rules"])
    assert set(ids["near_dedup"]) < set(ids["line_dedup"])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.contaminated(seen["near_dedup"], benchmark).collect()}
    assert set(ids["decontamination"]) == set(ids["near_dedup"]) - leaks
    assert set(ids["best_fit_packing"]) == set(ids["decontamination"])
    texts = [r.text for r in seen["near_dedup"].collect()]
    assert len(texts) == len(set(texts))
    run = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(run) == key(seen["best_fit_packing"])


def test_no_pair_of_a_large_bucket_is_left_untested(spark, monkeypatch):
    """All texts in one bucket, and no other way to meet: each text's partner must
    be found although the turns compare a text with few others."""
    import random

    from pyspark.sql import functions as F

    from textloom.llm import neardup

    rng, texts = random.Random(3), []
    for i in range(90):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [(i, " ".join(words)), (1000 + i, " ".join(words + ["more"]))]
    rng.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sketches = neardup.sketches
    monkeypatch.setattr(neardup, "REACH", 1)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "sketches", lambda d, w: sketches(d, w).withColumn("keys", F.transform("keys", lambda k: F.xxhash64(k, "node"))))
    monkeypatch.setattr(neardup, "near_duplicates", lambda d, *_: d.select("doc_id", F.lit(0).alias("component_id").cast("long")))
    got = {r.doc_id: r.component_id for r in neardup.similar(docs).collect()}
    assert got == {i: i % 1000 for i, _ in texts}
