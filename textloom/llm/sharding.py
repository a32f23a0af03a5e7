"""Histogram sort of documents into shards of near equal bytes.

The key of a document holds 32 bits of its text's hash before 32 bits of its
id's, so equal texts lie together, and a group of copies that outweighs a shard
can still be cut. Splitters come from iterated histograms: the exact bytes below
a few candidate keys around each target are counted over all partitions, each
target's bracket narrows to the candidates next to it, and counting stops once
every splitter is within the tolerance (a share of a shard) or its bracket holds
one key. Only ``shards * probes`` sums reach the driver. Rows are then exchanged
once, and get gapless slots from salted windows, so no task holds a shard.

Defined cases: a null text counts no bytes and has checksum 0; repeated rows
each take a slot; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

OVERHEAD = 16
TOP = 1 << 63


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = "(xxhash64(text_) & -4294967296L) | (xxhash64(doc_id, text_) & 4294967295L)"
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text_"))
    return rows.select("doc_id", (F.octet_length("text_").cast("long") + OVERHEAD).alias("size"), F.crc32("text_").alias("text_crc32"), F.expr(key).alias("key"))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(TOP)


def below(rows: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact sum of ``size`` over the keys less than each ascending probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, unsigned(b["key"]), side="right")
            np.add.at(total, at, b["size"].to_numpy(zero_copy_only=False))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "bytes"])

    sums = rows.select("key", "size").mapInArrow(run, "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    out = np.zeros(len(probes) + 1, np.int64)
    for bucket, size in sums.collect():
        out[bucket] = size
    return np.cumsum(out)[:-1]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 16) -> np.ndarray:
    """The ascending first keys (unsigned) of all shards but the first."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * i / shards for i in range(1, shards)]
    near = tolerance * total / shards
    brackets = [((0, 0), (1 << 64, total))] * (shards - 1)
    done: list[int | None] = [None] * (shards - 1)
    while any(x is None for x in done):
        for i, ((lo, lo_bytes), (hi, hi_bytes)) in enumerate(brackets):
            gap, key = min((abs(lo_bytes - targets[i]), lo), (abs(hi_bytes - targets[i]), hi))
            if gap <= near or hi - lo <= 1:
                done[i] = min(key, (1 << 64) - 1)
        ask = sorted({lo + (hi - lo) * k // probes for i, ((lo, _), (hi, _)) in enumerate(brackets) if done[i] is None for k in range(1, probes)} - {0})
        if not ask:
            continue
        sums = dict(zip(ask, below(rows, np.array(ask, np.uint64)).tolist(), strict=True))
        for i, (lo, hi) in enumerate(brackets):
            if done[i] is None:
                own = [(k, n) for k, n in sums.items() if lo[0] < k < hi[0]]
                lo = max([lo, *(x for x in own if x[1] <= targets[i])])
                hi = min([hi, *(x for x in own if x[1] > targets[i])])
                brackets[i] = (lo, hi)
    return np.array(sorted(done), np.uint64)


def slotted(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each value of ``shard``."""
    salts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    rows = rows.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, key), {salts})"))
    own = Window.partitionBy("shard", "salt")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("key", "doc_id")))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    first = first.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    slot = (F.col("first") + F.col("rank") - 1).cast("long")
    return rows.join(first, ["shard", "salt"]).withColumn("slot", slot).drop("salt", "rank", "first")


def sharded(docs: DataFrame, shards: int = 40, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document:
    law ``bytes``, shards of near equal total size."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.keep(keyed(docs), "keys")
    first = splitters(rows, shards, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.searchsorted(first, unsigned(b["key"]), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], [*b.schema.names, "shard"])

    out = slotted(rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, key long, shard int"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write whole documents as one folder per shard, rows in slot order, each
    row once; input columns named shard or slot are replaced."""
    key, nth = fresh(docs, "key"), fresh(docs, "nth")
    name = lambda crc: F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), crc)
    repeat = lambda *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    placed = sharded(docs, shards).withColumn(key, name(F.col("text_crc32"))).withColumn(nth, repeat("shard", "slot")).select(key, nth, "shard", "slot")
    # rows of one id and checksum take its places in an order of their own
    own = docs.withColumn(key, name(F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    own = own.withColumn(nth, repeat(F.xxhash64(*docs.columns), *docs.columns))
    rows = own.drop("shard", "slot").join(placed, [key, nth]).drop(key, nth)
    rows.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
