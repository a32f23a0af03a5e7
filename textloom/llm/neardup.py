"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits exactly if some 64-bit value
lies within half the radius of both. So each fingerprint emits every variant
within half the radius (2081 of them for radius 4), the variants are shuffled,
and fingerprints that meet at one are linked. A variant's bucket holds at most
2081 distinct fingerprints, so no group grows with the data, and members are
chained to their neighbour in the bucket instead of paired all with all.

Emitting that ball for every fingerprint costs 2081 rows each, although nearly
all of them meet nobody. A first round therefore plays the same game on
projections: of three blocks of 21 or 22 bits, some two hold at most two thirds
of the differing bits (2 of 4), so fingerprints within the radius share a
variant within one flipped bit on that pair of blocks. This emits 132 rows for
each fingerprint and loses no link; only fingerprints that met another there
emit their whole ball.

Defined cases: null and wordless texts have fingerprint zero and are linked
like any other; texts of fewer words than a shingle hash their whole sequence;
repeated rows each get a row; a null doc_id never names a component; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, looked_up, row_key

SEED = 42
CHUNK = 1 << 16
#: Sub-fingerprints of a shingle set, and the least hashes that make one. A pair
#: at similarity 0.8 shares none of them with a chance of 3 in a million.
BANDS, LEAST = 32, 5
#: Members of a bucket that each one is compared with in the later rounds, and
#: members of a block in the last round, which compares all blocks.
REACH, BLOCK = 32, 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, A-Z lower-cased, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first = (ends - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(first, ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(first))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(x.as_py(), width)) for x in b["text"]), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int) -> list[list[int]]:
    """Bit positions of the projections: two of three blocks of the 64 bits."""
    cuts = [list(range(64 * i // 3, 64 * (i + 1) // 3)) for i in range(3)]
    return [cuts[0] + cuts[1], cuts[0] + cuts[2], cuts[1] + cuts[2]]


def flips(bits: list[int], most: int) -> np.ndarray:
    """Masks that flip at most ``most`` of the given bits."""
    masks = [0]
    level = [(0, -1)]
    for _ in range(most):
        level = [(m | 1 << bits[j], j) for m, i in level for j in range(i + 1, len(bits))]
        masks += [m for m, _ in level]
    return np.array(masks, np.uint64)


def met_on_projections(fps: DataFrame, radius: int) -> DataFrame:
    """Fingerprints that share a projected variant with another one."""
    near = (2 * radius // 3) // 2 + (2 * radius // 3) % 2
    plan = [(np.uint64(sum(1 << b for b in bits)), flips(bits, near)) for bits in blocks(radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2048):
                own = fp[at : at + 2048]
                for i, (mask, flip) in enumerate(plan):
                    key = ((own & mask)[:, None] ^ flip).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), i, np.int8)), pa.array(key.view(np.int64)), pa.array(np.repeat(own, len(flip)).view(np.int64))],
                        ["side", "key", "fp"],
                    )

    met = Window.partitionBy("side", "key").orderBy("fp")
    rows = fps.mapInArrow(run, "side byte, key long, fp long")
    rows = rows.withColumn("before", F.lag("fp").over(met)).withColumn("after", F.lead("fp").over(met))
    return rows.where("before is not null or after is not null").select("fp").distinct()


def ball_links(fps: DataFrame, radius: int, part: int, parts: int) -> DataFrame:
    """Links (a, b) of fingerprints that meet at a variant of this part.

    The variants are dealt over ``parts`` rounds by their own value, so a round
    holds that share of them and no meeting is split over two rounds.
    """
    ball = flips(list(range(64)), radius // 2)
    mix = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 256):
                own = fp[at : at + 256]
                key = (own[:, None] ^ ball).ravel()
                mine = (key * mix) >> np.uint64(48)
                mine = mine % np.uint64(parts) == part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[mine].view(np.int64)), pa.array(np.repeat(own, len(ball))[mine].view(np.int64))], ["key", "fp"]
                )

    met = Window.partitionBy("key").orderBy("fp")
    rows = fps.mapInArrow(run, "key long, fp long").withColumn("before", F.lag("fp").over(met))
    links = rows.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius)
    return links.select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, parts: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id
    that is reachable over links of at most ``radius`` differing bits.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4")
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.keep(fingerprints(docs, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    met = scratch.keep(met_on_projections(nodes.select("fp"), radius), "met")
    links = None
    for part in range(parts):
        own = scratch.keep(ball_links(met, radius, part, parts), "links")
        links = own if links is None else links.unionByName(own)
    roots = components(links, scratch)
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = scratch.keep(labelled, "labelled")
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, node, n, keys): node names the shingle set of the text, n
    is its size and keys holds its ``BANDS`` sub-fingerprints, each the hash of
    the least shingle under ``LEAST`` orders."""
    rng = np.random.default_rng(SEED)
    flip, mix = (rng.integers(0, 1 << 64, (BANDS * LEAST, 1), np.uint64) for _ in range(2))
    mix |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, keys = [], [], []
            for x in b["text"]:
                own = np.unique(shingle_hashes(x.as_py(), width))
                least = np.full(BANDS * LEAST, ~np.uint64(0))
                for i in range(0, len(own), 1024):
                    np.minimum(least, ((own[i : i + 1024] ^ flip) * mix).min(axis=1), out=least)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                keys.append([xxhash.xxh64_intdigest(k.tobytes(), SEED) - (1 << 63) for k in least.reshape(BANDS, LEAST)])
            cols = [b["doc_id"], b["row"], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "node", "n", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the given rows: sorted hashes of eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width)).astype("<u8").tobytes() for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = docs.select(row_key().alias("row"), F.col("text").cast("string")).join(rows, "row")
    return texts.dropDuplicates(["row"]).select("node", "text").mapInArrow(run, "node long, shingles binary")


def candidates(met: DataFrame, turn: int, least: float) -> DataFrame:
    """(a, b): pairs of members of a bucket that are in different groups so far.

    The first turn compares each member with the bucket's first one, the later
    ones also with the ``REACH`` members before it, in an order of their own.
    """
    order = F.col("node") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
    bucket = Window.partitionBy("band", "key")
    mine = F.struct("node", "root", "n")
    rows = met.withColumn("split", F.min("root").over(bucket) != F.max("root").over(bucket)).where("split")
    rows = rows.withColumn("order", order)
    near = F.array(F.first(mine).over(bucket.orderBy("order", "node")))
    if turn:
        near = F.concat(near, F.collect_list(mine).over(bucket.orderBy("order", "node").rowsBetween(-REACH, -1)))
    pairs = rows.withColumn("near", near).select("node", "root", "n", F.explode("near").alias("other"))
    pairs = pairs.where("root <> other.root").where(F.least("n", "other.n") >= least * F.greatest("n", "other.n"))
    return pairs.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def remaining(met: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of members of a bucket that are in different groups, of
    the buckets that reach beyond ``REACH`` (in the others no pair is left).

    Members are numbered by group and cut into blocks. Each pair of blocks is a
    key of its own, so a task holds two blocks at a time and a large bucket is
    dealt over all tasks; two blocks of one and the same group don't meet."""
    bucket = Window.partitionBy("band", "key")
    rows = met.withColumn("split", F.min("root").over(bucket) != F.max("root").over(bucket)).where("split")
    rows = rows.withColumn("members", F.count("*").over(bucket)).where(F.col("members") > REACH + 1)
    rows = rows.withColumn("block", F.floor((F.row_number().over(bucket.orderBy("root", "node")) - 1) / BLOCK))
    cuts = rows.groupBy("band", "key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    left, right = (cuts.select("band", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi"))) for s in "xy")
    meet = left.join(right, ["band", "key"]).where("block_x <= block_y and not (lo_x = hi_y)").select("band", "key", "block_x", "block_y")
    one, two = (rows.select("band", "key", F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n"))) for s in "xy")
    pairs = meet.join(one, ["band", "key", "block_x"]).join(two, ["band", "key", "block_y"])
    pairs = pairs.where("root_x < root_y").where(F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y"))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets have a similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [
                similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least
                for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, component_id) for each row: the smallest doc_id reachable over
    pairs of texts whose shingle sets have a Jaccard similarity of ``least``.

    Candidates share a sub-fingerprint of their shingles or a component of near
    SimHash fingerprints; every pair is verified on the whole sets. Turns go on
    until one brings no link, so a group is met through other members too. What
    the turns left apart in a bucket is then compared pair by pair, all of it.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.keep(sketches(docs, width), "sketches")
    nodes = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    bands = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    near = near_duplicates(docs, radius, width).where("component_id is not null").select("doc_id", F.col("component_id").alias("key")).distinct()
    ball = rows.join(near, "doc_id").select("node", "n", F.lit(-1).alias("band"), "key").distinct()
    bucket = Window.partitionBy("band", "key")
    met = bands.unionByName(ball).withColumn("members", F.count("*").over(bucket)).where("members > 1")
    met = scratch.keep(met.select("node", "n", "band", "key"), "met")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "row")
    sets = scratch.keep(shingle_sets(docs, wanted, width), "sets")
    links = tested = None
    roots = met.sparkSession.createDataFrame([], "node long, root long")
    turn, last = 0, False
    while True:
        named = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = remaining(named, least) if last else candidates(named, turn, least)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        found = scratch.keep(verified(pairs, sets, least), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        any_new = not found.isEmpty()
        if any_new:
            roots = scratch.keep(components(links, scratch), "roots")
        if last:
            break
        last = turn > 0 and not any_new
        turn += 1
    labelled = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    groups = scratch.keep(labelled, "groups")
    named = groups.join(groups.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first document of their component.

    Of rows with the same doc_id all stay if that id is the first one; rows
    with a null doc_id stay, as nothing names them.
    """
    found = similar(docs, **options)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    copies = Scratch(docs.sparkSession, "similar").keep(copies, "copies")
    return looked_up(docs, copies, "doc_id", "left_anti").select(docs.columns)
