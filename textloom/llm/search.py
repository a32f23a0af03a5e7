"""Ranked lexical search by Block-Max MaxScore over shards of documents.

The query set is given as a table and goes in blocks of bounded size; its terms
are what the index holds lists of. For a block of items:

1. a pass over all texts counts terms and writes the postings of the block's
   terms, a row per shard of at most ``DOCS`` documents in the order of their ids;
2. document frequencies and lengths are summed over all shards, and each shard's
   postings become byte-coded blocks of 128 neighbouring documents, each with the
   highest impact that stands in it;
3. a shard answers all items of the block: global bounds of the terms split each
   item's lists into essential ones, which bring candidates, and others, whose
   block maxima must lift a candidate above the shard's current worst hit before
   one of their blocks is decoded;
4. the shards' heaps of ``k`` hits per item are merged by a ranked window, which
   Spark cuts to ``k`` rows per item in each task before it shuffles.

Scores are integers, so the ranking is exact and the same on any cluster. The
driver sees a block's items, and a few numbers for each of its terms; a task
holds one shard. A hot source or group of copies fills shards like other rows.

Defined cases: a null or wordless text is not ranked and not counted; equal
scores go by ascending doc_id, a null doc_id behind all others; repeated rows
are each ranked; each row of the items is a query of its own, without terms it
has no hits; an empty table on either side gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .files import packed, unpacked
from .words import FOLD, word_ids

#: Documents, and words, with which a shard is full.
DOCS, WORDS = 1 << 14, 1 << 22
#: log2 of the documents of a block, and blocks that are looked at together.
BITS, WINDOW = 7, 16
#: Items, and bytes of their texts, with which a block of the query set is full.
ITEMS, ITEM_BYTES = 2000, 1 << 22
LAST = (1 << 63) - 1  # stands for a null doc_id


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    own, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        text = bytes(r[1] or b"")
        if own and (len(own) == ITEMS or size + len(text) > ITEM_BYTES):
            yield own
            own, size = [], 0
        own.append((r[0], text))
        size += len(text)
    if own:
        yield own


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(shard, docs, words, terms, counts, data): the shards' postings of the
    known terms; docs and words count what has a word at all."""
    names = ["shard", "docs", "words", "terms", "counts", "data"]

    def shard(number: int, ids: list, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        doc = np.array([LAST if x is None else x for x in ids], np.int64)
        by = np.argsort(doc, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        n = np.array(sizes, np.int64)
        terms = np.concatenate([np.empty(0, np.int64), *found])
        where = np.repeat(place, [len(x) for x in found])
        key, tf = np.unique(terms * DOCS + where, return_counts=True)
        term, counts = np.unique(key // DOCS, return_counts=True)
        data = packed({"doc": doc[by], "n": n[by], "term": (key // DOCS).astype(np.int32), "at": (key % DOCS).astype(np.uint16), "tf": tf.astype(np.uint32)})
        cols = [pa.array([number]), pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([term], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, found, words = [], [], [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                own = word_ids(text.as_py() or b"", known)
                if not len(own):
                    continue
                ids.append(doc)
                sizes.append(len(own))
                found.append(own[own > 0].astype(np.int64))
                words += len(found[-1])
                if len(ids) == DOCS or words >= WORDS:
                    yield shard(number, ids, sizes, found)
                    ids, sizes, found, words, number = [], [], [], 0, number + 1
        if ids:
            yield shard(number, ids, sizes, found)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "shard long, docs long, words long, terms array<long>, counts array<long>, data binary")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def sealed(lists: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """(shard, terms, tops, data): the shards' lists as byte-coded blocks with
    their highest impacts; tops are the highest of whole lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b["shard"].to_pylist(), b["data"], strict=True):
                p = unpacked(np.frombuffer(raw.as_buffer(), np.uint8))
                m = 100 - 25 + 25 * p["n"] * n_docs // n_words
                at = p["at"].astype(np.int64)
                gain = impact(p["tf"], m[at])
                edge = np.flatnonzero(np.diff(p["term"].astype(np.int64) << 32 | at >> BITS, prepend=-1))
                many = p["tf"] > 1
                before = np.cumsum(many) - many
                term = p["term"][edge]
                first = np.flatnonzero(np.diff(term, prepend=-1))
                high = np.maximum.reduceat(gain, edge) if len(edge) else gain
                tops = np.maximum.reduceat(high, first) if len(first) else high
                data = packed({
                    "doc": p["doc"], "m": m, "term": term[first], "first": first, "block": (at[edge] >> BITS).astype(np.uint16),
                    "start": edge, "more": before[edge], "high": high.astype(np.uint32),
                    "code": (at & (1 << BITS) - 1).astype(np.uint8) | many.astype(np.uint8) << BITS, "tf": p["tf"][many],
                })
                cols = [pa.array([shard]), pa.array([term[first].astype(np.int64)], pa.list_(pa.int64())), pa.array([tops], pa.list_(pa.int64())), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "terms", "tops", "data"])

    return lists.select("shard", "data").mapInArrow(run, "shard long, terms array<long>, tops array<long>, data binary")


class Shard:
    """The coded lists of one shard."""

    def __init__(self, raw: np.ndarray):
        p = unpacked(raw)
        self.doc, self.m, self.block, self.high, self.code, self.tf = (p[k] for k in ("doc", "m", "block", "high", "code", "tf"))
        self.start, self.more = np.append(p["start"], len(self.code)), np.append(p["more"], len(self.tf))
        self.lists = dict(zip(p["term"].tolist(), zip(p["first"].tolist(), [*p["first"].tolist()[1:], len(self.block)], strict=True), strict=True))
        self.blocks = (len(self.doc) >> BITS) + 1
        self.decoded = 0

    def maxima(self, term: int) -> np.ndarray:
        """The highest impact in each block of the shard, 0 where the list has none."""
        out = np.zeros(self.blocks, np.int64)
        s, e = self.lists[term]
        out[self.block[s:e]] = self.high[s:e]
        return out

    def decode(self, term: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a list's blocks that ``wanted`` marks."""
        s, e = self.lists[term]
        own = s + np.flatnonzero(wanted[self.block[s:e]])
        self.decoded += len(own)
        code = self.code[spans(self.start[own], self.start[own + 1])]
        at = (np.repeat(self.block[own].astype(np.int64), self.start[own + 1] - self.start[own]) << BITS) + (code & (1 << BITS) - 1)
        tf = np.ones(len(code), np.int64)
        tf[code >> BITS == 1] = self.tf[spans(self.more[own], self.more[own + 1])]
        return at, impact(tf, self.m[at])

    def top(self, terms: list[tuple[int, int, int]], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, document) of an item. terms: (number, weight
        times uses, global bound of that times an impact)."""
        terms = sorted((t for t in terms if t[0] in self.lists), key=lambda t: t[2])
        if not terms:
            return []
        bound = np.cumsum([b for _, _, b in terms])
        most = np.array([w * self.maxima(t) for t, w, _ in terms])
        upto = np.cumsum(most, axis=0)
        score, hit = np.zeros(self.blocks << BITS, np.int64), np.empty(0, np.int64)
        worst = 0
        for a in range(0, self.blocks, WINDOW):
            wanted = np.zeros(self.blocks, bool)
            wanted[a : a + WINDOW] = upto[-1][a : a + WINDOW] > worst
            if not wanted.any():
                continue
            idle = int(np.searchsorted(bound, worst, side="right"))  # lists that can't lift a document alone
            for t, w, _ in terms[idle:]:
                at, gain = self.decode(t, wanted)
                score[at] += w * gain
            found = (a << BITS) + np.flatnonzero(score[a << BITS : (a + WINDOW) << BITS])
            for i in range(idle - 1, -1, -1):
                found = found[score[found] + upto[i][found >> BITS] > worst]
                block = found[most[i][found >> BITS] > 0] >> BITS
                if len(block):
                    wanted[:] = False
                    wanted[block] = True
                    at, gain = self.decode(terms[i][0], wanted)
                    score[at] += terms[i][1] * gain
            found = found[score[found] > worst]
            hit = np.concatenate([hit, found])
            hit = hit[np.lexsort((hit, -score[hit]))][:k]
            worst = int(score[hit[-1]]) if len(hit) == k else 0
        return [(int(score[h]), int(self.doc[h])) for h in hit]


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def search_block(docs: DataFrame, items: list[tuple[int, bytes]], k: int, scratch: Scratch) -> DataFrame:
    """(item, item_id, rank, doc_id, score) for a block of items."""
    spark = docs.sparkSession
    uses = [Counter(text.translate(FOLD).split()) for _, text in items]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for own in uses for w in own), 1)}
    lists = scratch.keep(postings(docs, known), "postings")
    n_docs, n_words = lists.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    pairs = lambda df, a, b: df.select(F.explode(F.arrays_zip(a, b)).alias("x")).select(f"x.{a}", f"x.{b}").groupBy(a)
    df = dict(pairs(lists, "terms", "counts").agg(F.sum("counts")).collect())
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    index = scratch.keep(sealed(lists, n_docs, max(n_words, 1)), "index")
    scratch.drop(lists)
    tops = dict(pairs(index, "terms", "tops").agg(F.max("tops")).collect())
    asked = [[(t, w * n, w * n * tops[t]) for term, n in own.items() if (w := weight.get(t := known[term], 0)) > 0] for own in uses]
    given = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["data"]:
                shard, rows = Shard(np.frombuffer(raw.as_buffer(), np.uint8)), []
                for i, terms in enumerate(given.value):
                    rows += [(i, doc, score) for score, doc in shard.top(terms, k)]
                cols = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    heaps = index.select("data").mapInArrow(run, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    merged = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    return merged.join(F.broadcast(names), "item")  # a block's items, at most ITEMS rows


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    scratch = Scratch(docs.sparkSession, "search")
    out = [search_block(docs, own, k, scratch) for own in item_blocks(items)]
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    doc = F.when(F.col("doc_id") < LAST, F.col("doc_id"))
    return reduce(DataFrame.unionByName, out).select("item_id", "rank", doc.alias("doc_id"), "score")


#: DuckDB SQL for ``ranked`` with 20 hits, over documents and benchmark.
SQL = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_words FROM d WHERE len(w) > 0),
    i AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    q AS (SELECT i, item_id, term, count(*) AS uses FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term),
    g AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + CAST((25 * n * n_docs) // n_words AS BIGINT)))) AS g FROM p JOIN f USING (term), s),
    c AS (SELECT i, item_id, r, doc_id, CAST(sum(uses * g) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY i, item_id, r, doc_id HAVING sum(uses * g) > 0),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
