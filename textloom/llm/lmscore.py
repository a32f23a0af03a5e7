"""Language-model scoring with an Elias-Fano bigram trie.

The first level is the vocabulary: word hashes in ascending order, Elias-Fano
coded in files by hash range, with their counts; a word's id is its place. The
second level holds the pairs, in files of about ``shard_pairs`` pairs. A file has
three Elias-Fano sequences: the ids of its contexts, a monotone pointer for each
to its first successor, and the successors' ids, each coded relative to its
context: the context's base is the end of the range of the context before, so
that the whole sequence ascends. A search finds the context's place, its two
pointers (their distance is the number of different successors) and its base, and
then the successor of base + word. Beside each entry lies its discounted
probability as a quantised logarithm, rounded down. Levels are written by the
tasks that counted them to the shared folder and memory-mapped by the tasks that
score; nothing of the model passes the driver but its sums.

The probability of a word after a context is the discounted share of the pair
(absolute discount 0.75) plus the freed mass times the smoothed unigram
probability. Unknown words share one place in the unigram, an unknown context
leaves the unigram alone, so probabilities add up to at most one.

Pairs travel as compressed blocks of sorted codes, one per task and shard. A
context seen more than ``shard_pairs / 16`` times is dealt over all shards by
word, so a shard's size does not grow with the corpus; the numbers of successors
of these contexts are summed in Spark and lie in files by id range. Pair codes
fill 64 bits at 3 * 10^9 different words: beyond it the model is refused.

Defined cases: a null or empty text holds the end mark alone; a null doc_id
counts as the text ``""`` for the split; without training text every word is
unknown; repeated rows each get a row (and train twice); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .files import mapped, packed, put

END = b"\n"
DISCOUNT = 0.75
STEPS = 1 << 11
REMEMBER = 400_000
#: Tokens that a task codes at a time.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


class EliasFano:
    """An ascending sequence of distinct unsigned numbers."""

    @staticmethod
    def coded(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = values & U((1 << bits) - 1)
        at = np.arange(n, dtype=np.int64) * bits
        words = np.zeros(n * bits // 64 + 2, U)
        if n and bits:
            word, off = at >> 6, (at & 63).astype(U)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.bitwise_or.reduceat(low << off, first)
            over = (at & 63) + bits > 64
            words[word[over] + 1] |= low[over] >> (U(64) - off[over])
        high = np.zeros((n + (universe >> bits) + 2 + 511) // 512 * 512, bool)
        high[(values >> U(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(high, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, 8).sum(axis=1)
        zeros = np.concatenate([[0], np.cumsum(512 - ones)])[:-1]
        return {"size": np.array([n, bits], np.int64), "low": words, "high": high, "zeros": zeros}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["size"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.ones = np.arange(len(self.zeros)) * 512 - self.zeros

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(U)
        out = self.low[word] >> off
        out |= (self.low[word + 1] << U(1)) << (U(63) - off)
        return out & U((1 << self.bits) - 1)

    def place(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th one (or zero) bit of the high parts stands."""
        before = self.ones if ones else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        rest = k - before[block]
        word = block * 8
        flip = U(0) if ones else ~U(0)
        for _ in range(7):
            c = np.bitwise_count(self.high[word] ^ flip).astype(np.int64)
            go = rest >= c
            rest -= np.where(go, c, 0)
            word += go
        left, place = self.high[word] ^ flip, word * 64
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(left & U((1 << step) - 1)).astype(np.int64)
            go = rest >= c
            rest -= np.where(go, c, 0)
            left = np.where(go, left >> U(step), left)
            place += np.where(go, step, 0)
        return place

    def bucket_ends(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most k: the place of the k-th
        zero bit, less the zeros before."""
        return self.place(k, False) - k

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return ((self.place(i, True) - i).astype(U) << U(self.bits)) | self.lows(i)

    def rank(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first value not below q stands, and whether it is q."""
        if not self.n:
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        high, low = (q >> U(self.bits)).astype(np.int64), q & U((1 << self.bits) - 1)
        hi = self.bucket_ends(high)
        end = hi.copy()
        lo = np.where(high > 0, self.bucket_ends(np.maximum(high - 1, 0)), 0)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.lows(mid) < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        hit = lo < end
        hit[hit] = self.lows(lo[hit]) == low[hit]
        return lo, hit


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): signed hash and count of each token of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(hashes(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        seen: Counter = Counter()
        for b in batches:
            for x in b["text"]:
                seen.update(tokens(x.as_py()))
                seen[END] += 1
                if len(seen) > REMEMBER:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The first level: ids and counts of words."""

    def __init__(self, root: str, bits: int, first: list[int]):
        self.bits, self.first = bits, np.array(first, np.int64)
        self.files = [mapped(f"{root}/words-{i}") for i in range(len(first) - 1)]
        self.sets = [EliasFano(f) for f in self.files]
        self.known: dict[bytes, int] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        shard = (h >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for i in np.unique(shard).tolist():
            own = np.flatnonzero(shard == i)
            at, hit = self.sets[i].rank(h[own] & U((1 << 64 - self.bits) - 1))
            out[own[hit]] = at[hit] + self.first[i]
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self.known.clear()
        if new := [w for w in set(words) if w not in self.known]:
            self.known.update(zip(new, self.find(hashes(new)).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, side="right") - 1
        for i in np.unique(shard[ids >= 0]).tolist():
            own = np.flatnonzero((shard == i) & (ids >= 0))
            out[own] = self.files[i]["n"][ids[own] - self.first[i]]
        return out


def write_vocabulary(words: DataFrame, root: str, bits: int) -> list[int]:
    """Write the first level in 2**bits files; their cumulative sizes."""

    def write(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        h = own["word"].to_numpy(np.int64).view(U) & U((1 << 64 - bits) - 1)
        order = np.argsort(h)
        n = own["n"].to_numpy(np.int64)[order]
        n = n.astype(np.uint32) if n.max() < 1 << 32 else n
        put(f"{root}/words-{key[0]}", packed(EliasFano.coded(h[order], 1 << 64 - bits) | {"n": n}))
        return pd.DataFrame({"shard": [key[0]], "n": [len(own)]})

    shard = F.expr(f"shiftrightunsigned(word, {64 - bits})") if bits else F.lit(0).cast("long")
    sizes = dict(words.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "shard long, n long").collect())
    for i in range(1 << bits):
        if i not in sizes:
            put(f"{root}/words-{i}", packed(EliasFano.coded(np.empty(0, U), 1) | {"n": np.empty(0, np.uint32)}))
    return np.cumsum([0] + [sizes.get(i, 0) for i in range(1 << bits)]).tolist()


class Setting:
    """What tasks need to open the model."""

    def __init__(self, root: str, bits: int, first: list[int], shard_pairs: int, docs: int, total: int):
        self.root, self.bits, self.first = root, bits, first
        self.shards = max(1, -(-total // shard_pairs))
        self.docs, self.total, self.words = docs, total, first[-1]
        self.width = self.words + 1  # the id ``words`` is the start of a text
        self.hot = shard_pairs // 16
        if (self.width + 1) ** 2 >= 1 << 63:
            raise ValueError(f"{self.words} different words: codes of pairs would pass 64 bits")

    def shard_of(self, context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
        key = context.astype(U) * MIX
        key ^= np.where(hot, (word.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F), U(0))
        key ^= key >> U(31)
        key *= MIX
        return ((key >> U(33)) % U(self.shards)).astype(np.int64)

    def context_counts(self, vocabulary: Vocabulary, context: np.ndarray) -> np.ndarray:
        out = vocabulary.counts(np.where(context == self.words, -1, context))
        out[context == self.words] = self.docs
        return out


def chunks(texts: Iterator) -> Iterator[list[list[bytes]]]:
    """Lists of tokenised texts of about CHUNK tokens; a longer one comes alone."""
    own, size = [], 0
    for x in texts:
        t = tokens(x.as_py())
        if own and size + len(t) > CHUNK:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 1
    if own:
        yield own


def pairs(texts: list[list[bytes]], vocabulary: Vocabulary, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context ids, word ids, first place of each text), end marks included."""
    flat = [w for t in texts for w in (*t, END)]
    word = vocabulary.ids(flat)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    context = np.concatenate([[start], word[:-1]])
    context[first] = start
    return context, word, first


def pair_blocks(docs: DataFrame, setting: Setting) -> DataFrame:
    """(shard, block): compressed sorted pair codes with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(setting.root, setting.bits, setting.first)
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for texts in chunks(b["text"]):
                context, word, _ = pairs(texts, vocabulary, setting.words)
                code, n = np.unique(context * setting.width + word, return_counts=True)
                context, word = np.divmod(code, setting.width)
                hot = setting.context_counts(vocabulary, context) > setting.hot
                shard = setting.shard_of(context, word, hot)
                order = np.argsort(shard, kind="stable")
                shard, code, n = shard[order], code[order], n[order]
                cut = np.flatnonzero(np.diff(shard, prepend=-1))
                out = []
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(code)], strict=True):
                    step = np.diff(code[s:e], prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)
                    planes = [np.ascontiguousarray(step.T), n[s:e].astype("<u4").view(np.uint8).reshape(-1, 4).T]
                    out.append(press.compress(b"".join(p.tobytes() for p in planes)))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(out, pa.binary())], ["shard", "block"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "shard int, block binary")


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n = len(raw) // 12
    code = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(code.astype(np.int64)), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def level(contexts: np.ndarray, first: np.ndarray, word: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The second level's sequences. ``word`` holds the successors' ids, ascending
    within each context; those of ``contexts[j]`` start at ``first[j]``."""
    ends = np.append(first[1:], len(word))
    tops = np.cumsum(word[ends - 1] + 1)
    base = np.append(0, tops[:-1])
    parts = {
        "contexts": EliasFano.coded(contexts.astype(U), width + 1),
        "pointers": EliasFano.coded(np.append(first, len(word)).astype(U), len(word) + 1),
        "successors": EliasFano.coded((word + np.repeat(base, ends - first)).astype(U), int(tops[-1]) + 1),
    }
    return {f"{k}-{name}": a for k, x in parts.items() for name, a in x.items()}


class Successors:
    """A file of the second level."""

    def __init__(self, file: dict[str, np.ndarray]):
        part = lambda k: EliasFano({n: file[f"{k}-{n}"] for n in ("size", "low", "high", "zeros")})
        self.contexts, self.pointers, self.ids, self.share = part("contexts"), part("pointers"), part("successors"), file["share"]
        self.top = self.ids.at(np.array([self.ids.n - 1]))[0] + U(1)

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, base) of the successors of each context."""
        start, end, base = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64), np.zeros(len(context), U)
        place, hit = self.contexts.rank(context.astype(U))
        start[hit] = self.pointers.at(place[hit])
        end[hit] = self.pointers.at(place[hit] + 1)
        later = start > 0
        base[later] = self.ids.at(start[later] - 1) + U(1)
        return start, end, base

    def find(self, start: np.ndarray, end: np.ndarray, base: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words within their contexts' ranges, and whether they are there."""
        place, hit = self.ids.rank(np.minimum(base + word.astype(U), self.top))
        return place, hit & (start <= place) & (place < end)


def write_pairs(blocks: DataFrame, setting: Setting) -> None:
    """Write the second level, a file per shard, and the numbers of successors of
    the contexts that are dealt over all shards, a file per part of the vocabulary."""

    def write(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        code, n = (np.concatenate(x) for x in zip(*map(unpacked, own["block"]), strict=True))
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, n = code[first], np.add.reduceat(n, first)
        vocabulary = Vocabulary(setting.root, setting.bits, setting.first)
        context, word = np.divmod(code, setting.width)
        contexts, first, kinds = np.unique(context, return_index=True, return_counts=True)
        total = setting.context_counts(vocabulary, contexts)
        share = np.ceil(-np.log2((n - DISCOUNT) / np.repeat(total, kinds)) * STEPS)
        share = share.astype(np.uint16 if share.max() < 1 << 16 else np.uint32)
        put(f"{setting.root}/pairs-{key[0]}", packed(level(contexts, first, word, setting.width) | {"share": share}))
        hot = total > setting.hot
        part = np.searchsorted(setting.first, contexts[hot], side="right") - 1
        return pd.DataFrame({"part": part, "context": contexts[hot], "n": kinds[hot]})

    def write_kinds(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("context")
        put(f"{setting.root}/kinds-{key[0]}", packed({c: own[c].to_numpy(np.int64) for c in ("context", "n")}))
        return pd.DataFrame({"n": [len(own)]})

    found = blocks.groupBy("shard").applyInPandas(write, "part long, context long, n long")
    found.groupBy("part", "context").agg(F.sum("n").alias("n")).groupBy("part").applyInPandas(write_kinds, "n long").agg(F.sum("n")).collect()


class Model:
    """Both levels, opened for scoring."""

    def __init__(self, setting: Setting):
        self.setting = setting
        self.vocabulary = Vocabulary(setting.root, setting.bits, setting.first)
        self.files: dict[int, Successors | None] = {}
        self.kinds: dict[int, dict] = {}

    def shard(self, i: int) -> Successors | None:
        if i not in self.files:
            try:
                self.files[i] = Successors(mapped(f"{self.setting.root}/pairs-{i}"))
            except FileNotFoundError:  # no pair fell here
                self.files[i] = None
        return self.files[i]

    def hot_kinds(self, contexts: np.ndarray) -> np.ndarray:
        """Numbers of successors of contexts that are dealt over all shards."""
        out = np.zeros(len(contexts), np.int64)
        part = np.searchsorted(self.setting.first, contexts, side="right") - 1
        for i in np.unique(part).tolist():
            if i not in self.kinds:
                self.kinds[i] = mapped(f"{self.setting.root}/kinds-{i}")
            own = part == i
            out[own] = self.kinds[i]["n"][np.searchsorted(self.kinds[i]["context"], contexts[own])]
        return out

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.setting.total + 0.5 * (self.setting.words + 1))

    def given(self, context: np.ndarray, word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probabilities of words after known contexts, in ascending order of
        contexts; ``base``: their unigram probabilities. Words of id -1 are unknown."""
        s = self.setting
        contexts, back = np.unique(context, return_inverse=True)
        total = s.context_counts(self.vocabulary, contexts)
        hot = total > s.hot
        kinds = np.zeros(len(contexts), np.int64)
        if hot.any():
            kinds[hot] = self.hot_kinds(contexts[hot])
        share = np.zeros(len(context))
        shard = s.shard_of(context, word, hot[back])
        shard[(word < 0) & hot[back]] = -1
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(s.shards + 1))
        for i in range(s.shards):
            own = order[cut[i] : cut[i + 1]]
            if not len(own) or not (file := self.shard(i)):
                continue
            new = np.diff(back[own], prepend=-1) > 0
            ids, of = back[own[new]], np.cumsum(new) - 1
            start, end, first = file.ranges(contexts[ids])
            kinds[ids] = np.where(hot[ids], kinds[ids], end - start)
            known = word[own] >= 0
            own, of = own[known], of[known]
            at, hit = file.find(start[of], end[of], first[of], word[own])
            share[own[hit]] = np.exp2(-file.share[at[hit]].astype(np.float64) / STEPS)
        return (DISCOUNT * kinds / np.maximum(total, 1))[back] * base + share

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        context, word, first = pairs(texts, self.vocabulary, self.setting.words)
        kinds, back = np.unique(word, return_inverse=True)
        base = self.unigram(self.vocabulary.counts(kinds))[back]
        p = base.copy()
        known = context >= 0 if self.setting.docs else np.zeros(len(context), bool)
        code, at, same = np.unique(context[known] * (self.setting.width + 1) + word[known] + 1, return_index=True, return_inverse=True)
        if len(code):
            p[known] = self.given(context[known][at], word[known][at], base[known][at])[same]
        sums = lambda x: np.add.reduceat(x, first)
        return np.diff(np.append(first, len(word))), sums((word >= 0).astype(np.int64)), sums(np.log10(base)), sums(np.log10(p))


def trained(docs: DataFrame, scratch: Scratch, shard_words: int, shard_pairs: int) -> Setting:
    """Count and write the model of all texts of ``docs``."""
    words = scratch.keep(word_counts(docs), "words")
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    root = scratch.path("model")
    bits = max(0, (kinds // shard_words).bit_length())
    first = write_vocabulary(words, root, bits)
    setting = Setting(root, bits, first, shard_pairs, docs.count(), total)
    write_pairs(pair_blocks(docs, setting), setting)
    scratch.settle()
    return setting


def scored(docs: DataFrame, shard_words: int = 1 << 20, shard_pairs: int = 1 << 21) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from the documents whose crc32 of the id as text leaves
    another remainder than 1 by 5, and scores all."""
    scratch = Scratch(docs.sparkSession, "lm")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    setting = trained(rows.where("not held_out"), scratch, shard_words, shard_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(setting)
        for b in batches:
            parts = [model.score(texts) for texts in chunks(b["text"])]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0)] * 4
            n_tokens, n_known, base, score = (pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True))
            total = pa.array(np.full(len(b), setting.total), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], n_tokens, n_known, total, base, score], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
