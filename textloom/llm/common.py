"""Shared helpers of the training-data operators.

Everything here is small: where scratch tables go, how lineage is cut, and a
distributed connected-components routine.
"""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder is made and
    set as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-textloom-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


#: Rows of an Arrow batch, on both sides of a Python worker; texts are long.
BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of batches of texts; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def worker_memory(owner: str) -> dict:
    """What a Python process keeps from task to task for one operator, by key. A
    process serves stage after stage, so the first task of another operator drops
    what the former has left.

    Functions reach tasks by value, with module variables of their own, so a
    cache that is to outlive a task lies in a module made for it."""
    held = sys.modules.setdefault("textloom_worker_memory", types.ModuleType("textloom_worker_memory")).__dict__
    if held.get("owner") != owner:
        held["owner"], held["kept"] = owner, {}
    return held["kept"]


class Scratch:
    """Tables of one run under the shared folder.

    ``keep`` writes a table and reads it back, so later steps start from files
    that every executor sees, and the shuffle files behind it can go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        short_batches(spark)
        atexit.register(self.remove)  # results are read from here while the session lasts

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        schema = df.schema
        del df
        self.settle()
        out = self.spark.read.schema(schema).parquet(at)
        out._scratch_path = at
        return out

    def settle(self) -> None:
        """Let the cleaner drop shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration() if sc._jsc is None else sc._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table written by ``keep`` that no later step reads."""
        self.delete(df._scratch_path)

    def remove(self) -> None:
        """Delete all tables of the run, at the end of the driver's process."""
        if self.spark.sparkContext._jvm is not None:
            self.delete(self.root)


#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.
FEW = 500_000


def looked_up(left: DataFrame, right: DataFrame, on: str, how: str = "inner", few: int = FEW) -> DataFrame:
    """``left`` joined to ``right``, which holds each key once and a few numbers,
    however many rows of ``left`` share a key.

    A right side of few rows (counted, so give a written table) is broadcast,
    and a hot key stays where it is. A larger one is joined by a shuffle, whose
    partitions the engine splits where a hot key has filled one: give the result
    to a step that doesn't ask for the key's partitioning."""
    return left.join(F.broadcast(right) if right.count() <= few else right, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """Names the row of a text, alike on both sides of a later join."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (long, no nulls).

    Returns ``(node, root)`` for each node of an edge, root being the smallest
    node that it reaches. Alternating large-star and small-star rounds: every
    round is a grouped minimum and a join, its edges are written before the
    next round, and the number of rounds is logarithmic in the component size.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(20, 0))"))).first())

    now = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        after = scratch.keep(star(star(now, True), False), "edges")
        scratch.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
