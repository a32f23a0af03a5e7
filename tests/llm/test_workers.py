"""What reaches the executors, and what copies of a text may do."""

import os
import random
import subprocess
import sys
from pathlib import Path

from textloom.llm import quality

ROOT = Path(__file__).resolve().parents[2]

ALONE = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
def seen(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("textloom") is not None])], ["x"])
assert not spark.range(1).mapInArrow(seen, "x boolean").first()[0], "the workers see the package"
sys.path.insert(0, sys.argv[1])
import __spark_entry__
failed = {}
for name, q in __spark_entry__.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        try:
            q(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as e:
            failed[name] = str(e)[-300:]
print("FAILED", failed)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "alone.py"
    script.write_text(ALONE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, str(script), str(ROOT), f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED {}" in out.stdout, (out.stdout + out.stderr)[-3000:]


def test_copies_do_not_vouch_for_a_text(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice(["an", "th", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200))) for _ in range(200)]
    junk = ["".join(chr(rng.randint(33, 126)) + (" " if i % 6 == 5 else "") for i in range(600)) for _ in range(4)]
    texts = clean + junk * 30 + clean[:3] * 40
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    rejected = {r.doc_id for r in quality.judged(df).collect() if not r.kept}
    assert rejected >= set(range(200, 320)) and len(rejected) <= 124
    distinct = [r.text for r in quality.distinct_texts(df.union(df.limit(4)), quality.Scratch(spark, "t")).collect()]
    assert sorted(distinct) == sorted(set(texts))


def test_a_worker_keeps_one_operators_memory():
    import sys as system

    from textloom.llm.common import worker_memory

    before = system.modules.pop("textloom_worker_memory", None)
    try:
        worker_memory("packing")["words"] = kept = [1]
        assert worker_memory("packing")["words"] is kept
        assert worker_memory("quality") == {} and worker_memory("packing") == {}
    finally:
        system.modules.pop("textloom_worker_memory", None)
        if before:
            system.modules["textloom_worker_memory"] = before


def test_memory_of_the_texts_of_a_task():
    """Codes of three million characters never lie in memory together."""
    import tracemalloc

    import numpy as np

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(1000)]
    quality.symbols()
    tracemalloc.start()
    for own in quality.pieces(iter(texts)):
        np.unique(quality.coded(own)[0], return_inverse=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20, most
