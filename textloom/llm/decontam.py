"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

For every benchmark item a window of the item's length in words slides over the
text, and a window of similarity 0.8 or more counts as a leak. Each window's
64-bit SimHash over its weighted shingles (from running sums of bit votes)
probes a multi-index of the items of its length: five blocks of 12 or 13 bits,
each item entered under every value within three bits of its own block.
Fingerprints that differ in at most 19 bits agree in some block up to three
bits, so no item within that radius is missed, and a random fingerprint meets
about a fifth of the items before its radius is tested. Candidates are then
verified exactly by the weighted Jaccard similarity of their shingle counts.

The candidates are those of the index alone. Only windows that hold not a single
shingle of the whole benchmark are not probed: their similarity to any item is 0.

Radius 19 lies three deviations above the 10 differing bits to be expected at
similarity 0.8 (weighted cosine 0.89, an angle of 27 of 180 degrees, deviation 3
bits), so a leak at exactly 0.8 is missed about once in seven hundred times, and a
closer one less often.

The benchmark is taken in blocks of at most ``block_items`` items and
``block_bytes`` bytes, one pass over the documents and one broadcast for each
block, released before the next, so what is broadcast is bounded whatever the
size of the benchmark.

Defined cases: items without a word match nothing; an item shorter than a
shingle is one shingle of all its words, and so is a window of its length; a
text shorter than the item is one window; a text of any length is taken whole;
null texts leak nothing; a row with a null doc_id is judged by its own text;
repeated rows each get a row; of equally similar windows the first is told; an
empty table gives an empty result, and an empty benchmark finds nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, looked_up, row_key
from .hashing import Powers, word_hashes

#: Where the blocks of bits begin and end, the bits in which an entry may differ
#: from its item's, and the radius that is then complete.
CUTS, FLIPS = (0, 13, 26, 39, 52, 64), 3
RADIUS = (len(CUTS) - 1) * (FLIPS + 1) - 1
#: Characters of texts that are looked up together.
CHUNK = 1 << 20
SHIFTS = np.arange(64, dtype=np.uint64)


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts, A-Z lower-cased, with a blank before each, and where each
    begins."""
    own = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    size = np.fromiter((len(t) + 1 for t in own), np.int64, len(own))
    return b"".join(b"\n" + t for t in own), np.cumsum(size) - size


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(joined([text])[0], Powers())[0]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ words[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the bits (+1 or -1) of the hashes, one row ahead."""
    bits = ((hashes[:, None] >> SHIFTS) & np.uint64(1)).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def sketch(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from bit votes, one per row."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


def near_masks(bits: int, most: int) -> np.ndarray:
    """Masks that flip at most ``most`` of the low bits."""
    return np.array([sum(1 << x for x in own) for k in range(most + 1) for own in combinations(range(bits), k)], np.uint64)


class Multi:
    """The multi-index over the fingerprints of the items of one length: per block
    of bits, every item under each value within FLIPS bits of its own."""

    def __init__(self, items: list[int], prints: np.ndarray):
        self.items, self.prints = np.array(items, np.int64), prints
        self.blocks = []
        for shift, bits in zip(CUTS, np.diff(CUTS).tolist(), strict=False):
            mask = np.uint64((1 << bits) - 1)
            keys = ((prints >> np.uint64(shift) & mask)[:, None] ^ near_masks(bits, FLIPS)).astype(np.int64)
            order = np.argsort(keys.ravel(), kind="stable")
            first = np.searchsorted(keys.ravel()[order], np.arange((1 << bits) + 1))
            self.blocks.append((np.uint64(shift), mask, first, order // keys.shape[1]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a given fingerprint, item) for all within RADIUS bits."""
        pairs = []
        for shift, mask, first, own in self.blocks:
            key = (prints >> shift & mask).astype(np.int64)
            size = first[key + 1] - first[key]
            of = np.repeat(np.arange(len(key)), size)
            at = np.arange(len(of)) + np.repeat(first[key] - (np.cumsum(size) - size), size)
            pairs.append(of * len(self.items) + own[at])
        of, own = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        ok = np.bitwise_count(prints[of] ^ self.prints[own]) <= RADIUS
        return of[ok], self.items[own[ok]]


class Index:
    """Items of one block: shingle counts, and a multi-index per length."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.ids, self.sizes, self.counts, prints = [], [], [], []
        for item, text in items:
            if not len(words := words_of(text)):
                continue
            own = shingles(words, min(width, len(words)))
            self.ids.append(item)
            self.sizes.append(len(words))
            self.counts.append(Counter(own.tolist()))
            prints.append(int(sketch(votes(own)[-1:])[0]))
        self.grams = {w: np.unique(np.array([x for c, n in zip(self.counts, self.sizes, strict=True) if min(width, n) == w for x in c], np.uint64)) for w in {min(width, n) for n in self.sizes}}
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes):
            by_size.setdefault(n, []).append(i)
        self.multi = {n: Multi(own, np.array([prints[i] for i in own], np.uint64)) for n, own in by_size.items()}


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of about CHUNK characters; a longer text
    comes alone."""
    own, size, first = [], 0, 0
    for i, x in enumerate(texts):
        t = x.as_py()
        if own and size + len(t or "") > CHUNK:
            yield first, own
            own, size, first = [], 0, i
        own.append(t)
        size += len(t or "")
    if own:
        yield first, own


def with_hits(texts: list[str | None], index: Index, powers: Powers) -> dict[int, np.ndarray]:
    """The word hashes of those texts that hold any shingle of the benchmark,
    by their number. All texts are looked up in one go."""
    data, begin = joined(texts)
    words, start, _ = word_hashes(data, powers)
    first = np.searchsorted(start, begin)
    ends = np.append(first[1:], len(words))
    found: set[int] = set()
    for w, grams in index.grams.items():
        own = shingles(words, w)
        if not len(own) or not len(grams):
            continue
        likely = np.zeros(1 << 16, bool)
        likely[grams >> np.uint64(48)] = True
        at = np.flatnonzero(likely[own >> np.uint64(48)])
        at = at[np.isin(own[at], grams)]
        text = np.searchsorted(ends, at, side="right")
        found.update(text[at + w <= ends[text]].tolist())
    return {i: words[first[i] : ends[i]] for i in sorted(found)}


def leaks(words: np.ndarray, index: Index, width: int, least: float) -> list[tuple[int, int, int, float]]:
    """(item number, first word, words, similarity): the best window of each
    item that some window of the text reaches."""
    best: dict[int, tuple[int, int, int, float]] = {}
    for w, grams in index.grams.items():
        own = shingles(words, w)
        if not len(own) or not len(grams):
            continue
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        hits = np.flatnonzero(grams[at] == own)
        if not len(hits):
            continue
        sizes = {n for n in index.sizes if min(width, n) == w}
        reach = max(sizes)
        # stretches of shingles that a window with a hit can touch
        cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for run in np.split(hits, cut):
            lo, hi = max(0, int(run[0]) - reach), min(len(own), int(run[-1]) + reach + 1)
            part = own[lo:hi]
            sums = votes(part)
            shared = np.zeros(len(part) + 1, np.int32)
            shared[run - lo + 1] = 1
            shared = np.cumsum(shared)
            for n in sizes:
                m = min(n - w + 1, len(part))
                first = np.flatnonzero(shared[m:] > shared[:-m])
                if not len(first):
                    continue
                of, items = index.multi[n].near(sketch(sums[first + m] - sums[first]))
                for s, i in zip(first[of].tolist(), items.tolist(), strict=True):
                    score = weighted_jaccard(Counter(part[s : s + m].tolist()), index.counts[i])
                    if score >= least and (i not in best or score > best[i][3]):
                        best[i] = (i, lo + s, m + w - 1, score)
    return list(best.values())


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of a bounded number of items and bytes."""
    own, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for item, text in rows.toLocalIterator():
        if own and (len(own) >= block_items or size + len(text) > block_bytes):
            yield own
            own, size = [], 0
        own.append((item, text))
        size += len(text)
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """(row, doc_id, item_id, first_word, n_words, similarity): one row for each
    text and item that it leaks; row is ``row_key`` of the text. The blocks run
    one after another, each with its own pass, table and broadcast."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "row long, doc_id long, item_id long, first_word long, n_words long, similarity double"
    names = ["row", "doc_id", "item_id", "first_word", "n_words", "similarity"]
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_items, block_bytes):
        given = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            index, powers = Index(given.value, width), Powers()
            for b in batches:
                out = []
                for at, texts in groups(b["text"]):
                    for i, words in with_hits(texts, index, powers).items():
                        row, doc = b["row"][at + i].as_py(), b["doc_id"][at + i].as_py()
                        out += [(row, doc, index.ids[k], s, n, round(x, 6)) for k, s, n, x in leaks(words, index, width, least)]
                cols = zip(*out, strict=True) if out else [[]] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        found = found.unionByName(scratch.keep(rows.mapInArrow(run, schema), "leaks"))
        given.destroy()
    return found


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, max_similarity) for each row of
    ``docs``; item_ids is ascending."""
    found = contaminated(docs, benchmark, **options)
    by_row = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"))
    by_row = Scratch(docs.sparkSession, "decontam").keep(by_row, "rows")
    out = looked_up(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row")), by_row, "row", "left")
    return out.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        "max_similarity",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    name = fresh(docs, "row")
    found = contaminated(docs, benchmark, **options).select(F.col("row").alias(name)).distinct()
    found = Scratch(docs.sparkSession, "decontam").keep(found, "rows")
    return looked_up(docs.withColumn(name, row_key()), found, name, "left_anti").select(docs.columns)
