"""Best-fit packing of tokenised documents by a configuration linear program.

Only longer documents are cut into pieces; all that the planner sees is the
histogram of piece lengths, at most ``capacity`` rows however large the corpus
is. A configuration says how many pieces of each length share one sequence. The
covering program over configurations is solved by multiplicative weights: each
round prices the lengths by their weights, a knapsack dynamic programme finds
the most valuable configurations, they are used a little more, and the weights
of the lengths they cover shrink. The fractional uses are rounded down, and
what is left is packed by the same dynamic programme and a best-fit top-up.

Pieces of a length are numbered by salted windows (a third of all rows may
share one length), and each number is looked up in the plan's ranges, which
names its sequence and offset. The plan holds a few ranges per configuration;
configurations number at most ``capacity * log2(count)``, so its size does not
follow the corpus.

Defined cases: a null or empty text is one piece that holds the end mark only;
repeated rows are packed each for itself; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from string import ascii_letters
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, worker_memory
from .hashing import VALUE, Powers, U, grouped, running, word_spans

END = 1
#: Words that a worker remembers with their ids before it starts anew.
REMEMBER = 1_000_000
#: Bytes of texts whose words are looked up together.
CHUNK = 1 << 19
#: How the tokenizer's vocabulary marks the last piece of a word.
CLOSE = "</w>"
#: Marks that stay one piece of text when they follow a word.
MARKS = ".,;:!?|*#$%&"


#: Counters of letters, marks and bytes beyond ASCII in one number: bits of each.
PLACES = 20
KIND = np.zeros(256, np.int64)
KIND[list(ascii_letters.encode())], KIND[list(MARKS.encode())], KIND[128:] = 1, 1 << PLACES, 1 << 2 * PLACES


class Words:
    """Ids of the words of texts, each word encoded once and remembered by its
    64-bit hash; the ids of all remembered words lie in one array."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores busy
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.closing = np.zeros(self.tok.get_vocab_size(), bool)
        self.closing[[i for t, i in self.tok.get_vocab().items() if t.endswith(CLOSE)]] = True
        self.powers = Powers()
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.empty(0, U), np.empty(0, np.int64)
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([END], "<u4")  # row 0 is the end mark

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words of letters, encoded in one go: each ends
        with the one piece that closes a word."""
        if not words:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ids = self.encode(" ".join(words))
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=0)
        own = [self.encode(w) for w in words]
        return np.concatenate(own), np.array(list(map(len, own)), np.int64)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Units of letters are encoded in one go; other words by their letters
        and the marks behind, or whole."""
        plain = np.fromiter(map(bytes.isalpha, words), bool, len(words))
        other = np.flatnonzero(~plain)
        texts = [words[i].decode("utf-8", "replace") for i in other.tolist()]
        cores = [t.rstrip(MARKS) for t in texts]
        fits = [c.isalpha() and (is_normalized("NFC", c) or normalize("NFC", c).isalpha()) and c.lower().isalpha() for c in cores]
        own = list(dict.fromkeys(c for c, ok in zip(cores, fits, strict=True) if ok))
        known = [words[i].decode() for i in np.flatnonzero(plain).tolist()]
        ids, size = self.letters(known + own)
        ends = np.cumsum(size)
        cut = int(ends[len(known) - 1]) if known else 0
        place = {c: (e - n, e) for c, e, n in zip(own, ends[len(known) :].tolist(), size[len(known) :].tolist(), strict=True)}
        tails: dict[str, np.ndarray] = {}
        rest = []
        for text, core, ok in zip(texts, cores, fits, strict=True):
            tail = text[len(core) :] if ok else text
            if tail and tail not in tails:
                tails[tail] = self.encode(tail)
            sides = [ids[slice(*place[core])]] if ok else []
            rest.append(np.concatenate([*sides, tails[tail]]) if tail else sides[0])
        size = np.concatenate([size[: len(known)], np.fromiter(map(len, rest), np.int64, len(rest))])
        begin = len(self.ids)
        self.rows = np.concatenate([self.rows, len(self.size) + np.arange(len(size))])
        self.keys = np.concatenate([self.keys, keys[plain], keys[other]])
        self.ids = np.concatenate([self.ids, ids[:cut], *rest])
        self.first = np.concatenate([self.first, begin + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.rows = self.keys[by], self.rows[by]

    def spans(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with A-Z lower-cased in words of ASCII, and where the units
        begin and end: words, and apart from them marks after ASCII letters."""
        start, end = word_spans(code)
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(KIND[code], out=upto[1:])
        held = upto[end] - upto[start]
        short = end - start < 1 << PLACES  # of longer words the counters may run over
        plain = (held >> 2 * PLACES == 0) & short
        big = np.flatnonzero((code >= 65) & (code <= 90))
        code = code.copy()
        code[big[plain[np.searchsorted(start, big, side="right") - 1]]] |= 32
        n = held & (1 << PLACES) - 1
        at = np.flatnonzero(plain & (n > 0) & (n < end - start) & (n + (held >> PLACES) == end - start))
        middle = start + n
        at = at[upto[middle[at]] - upto[start[at]] == n[at]]
        return code, np.insert(start, at + 1, middle[at]), np.insert(end, at, middle[at])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each closed by the end mark, and where each ends."""
        data = b"\n".join([*texts, b""])
        code, start, end = self.spans(np.frombuffer(data, np.uint8))
        unit, at, back = np.unique(running(VALUE[code], start, end, self.powers), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, unit), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != unit) if len(self.keys) else np.arange(len(unit))
        if len(new):
            raw = code.tobytes()
            self.learn(unit[new], [raw[s:e] for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        row = self.rows[np.searchsorted(self.keys, unit)][back] if len(unit) else np.empty(0, np.int64)
        close = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        ends = np.searchsorted(start, close)
        row = np.insert(row, ends, 0)
        size = self.size[row]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[row] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, upto[ends + np.arange(len(texts))]


def words_of(tokenizer: str) -> Words:
    """One memory of words for all tasks of a Python worker."""
    held = worker_memory("packing")
    if (key := ("words", tokenizer)) not in held:
        held[key] = Words(tokenizer)
    return held[key]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each
    whole text, tokenised with the file ``tokenizer`` and closed by id 1.

    The tokenizer splits at white space, lower-cases, and splits letters from
    marks, so the ids of a word are looked up by its hash, and a word of letters
    before marks is the ids of the two, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            docs = b["doc_id"].to_pylist()
            for at, texts in grouped([(x.as_py() or "").encode("utf-8", "surrogatepass") for x in b["text"]], CHUNK):
                ids, ends = words(texts)
                out: list[list] = [[] for _ in types]
                begin = 0
                for doc, end in zip(docs[at : at + len(texts)], ends.tolist(), strict=True):
                    for k, s in enumerate(range(begin, end, capacity)):
                        own = ids[s : min(end, s + capacity)]
                        for col, x in zip(out, (doc, k, s - begin, len(own), zlib.crc32(own), own.tobytes() if with_ids else None), strict=True):
                            col.append(x)
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(out, types, names, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Pricer:
    """The knapsack dynamic programme over the lengths of one histogram."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity

    def solve(self, value: np.ndarray, alive: np.ndarray, most: int) -> list[dict[int, int]]:
        """Up to ``most`` configurations of the highest value, each with another
        first piece, as {index of a length: how often}."""
        index = np.flatnonzero(alive)
        length, worth = self.lengths[index], value[index]
        best, pick = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        upto = np.searchsorted(length, np.arange(self.capacity + 1), side="right")
        for c in range(int(length[0]), self.capacity + 1):
            k = upto[c]
            gain = best[c - length[:k]] + worth[:k]
            j = gain.argmax()
            best[c], pick[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
        whole = worth + best[self.capacity - length]
        out = []
        for j in np.argsort(-whole, kind="stable")[:most].tolist():
            config, room = {int(index[j]): 1}, self.capacity - int(length[j])
            while room > 0:
                if (i := pick[room]) < 0:
                    room -= 1
                    continue
                config[int(index[i])] = config.get(int(index[i]), 0) + 1
                room -= int(length[i])
            out.append(config)
        return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eps: float, most: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with fractional uses, and a lower bound on the number of
    sequences (from the best weights seen, by weak duality)."""
    pricer, weight = Pricer(lengths, capacity), lengths / capacity
    alive, used, bound = counts > 0, [], float(np.ceil((lengths * counts).sum() / capacity))
    for _ in range(rounds):
        configs = pricer.solve(weight, alive, most)
        top = sum(n * weight[i] for i, n in configs[0].items())
        bound = max(bound, float((weight * counts).sum() / top))
        for config in configs:
            step = min(counts[i] / n for i, n in config.items()) / most
            used.append((config, step))
            for i, n in config.items():
                weight[i] *= np.exp(-eps * n * step / counts[i] * most / 4)
    return used, bound


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 30, eps: float = 0.1, most: int = 32) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(configuration, whole uses) that hold each length exactly as often as it
    is counted, and a lower bound on the sequences. ``lengths`` is ascending."""
    if not len(lengths):
        return [], 0.0
    left, out = counts.astype(np.int64).copy(), []
    used, bound = fractional(lengths, counts.astype(float), capacity, rounds, eps, most)
    size = lambda c: sum(int(lengths[i]) * n for i, n in c.items())

    def take(config: dict[int, int], uses: int) -> None:
        out.append((config, uses))
        for i, n in config.items():
            left[i] -= n * uses

    cover = np.zeros(len(lengths))
    for config, x in used:
        for i, n in config.items():
            cover[i] += n * x / counts[i]
    scale = 1 / max(cover.max(), 1e-9)
    for config, x in sorted(used, key=lambda u: -size(u[0])):
        if uses := min(int(x * scale), *(int(left[i]) // n for i, n in config.items())):
            take(config, uses)
    pricer, value = Pricer(lengths, capacity), lengths.astype(float)
    while left.any():
        share = left / np.maximum(counts, 1)
        for config in pricer.solve(value * (1 + 0.01 * share), left > 0, 8 * most):
            if any(left[i] < n for i, n in config.items()):
                config = top_up({i: k for i, n in config.items() if (k := min(n, int(left[i])))}, left, lengths, capacity)
            if config:
                uses = min(int(left[i]) // n for i, n in config.items())
                take(config, max(1, uses // 2))
    return out, bound


def top_up(config: dict[int, int], left: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Add the longest piece that is left and fits, until none fits."""
    room = capacity - sum(int(lengths[i]) * n for i, n in config.items())
    alive = np.flatnonzero(left > 0)
    at = int(np.searchsorted(lengths[alive], room, side="right")) - 1
    while at >= 0:
        i = int(alive[at])
        if lengths[i] <= room and left[i] > config.get(i, 0):
            config[i] = config.get(i, 0) + 1
            room -= int(lengths[i])
        else:
            at = min(at - 1, int(np.searchsorted(lengths[alive], room, side="right")) - 1)
    return config


def ranges(lengths: np.ndarray, configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, copies per sequence, first sequence, offset)
    by which a numbered piece finds its place, ordered by the first two."""
    rows, taken, sequence = [], {}, 0
    for config, uses in configs:
        offset = 0
        for i, n in config.items():
            rows.append((int(lengths[i]), taken.get(i, 0), n, sequence, offset))
            taken[i] = taken.get(i, 0) + n * uses
            offset += int(lengths[i]) * n
        sequence += uses
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, gapless from 0 among the pieces of a length."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece), {salts})"))
    own = Window.partitionBy("length", "salt")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("doc_id", "piece", "start", "ids_crc32")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = first.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(first, ["length", "salt"]).withColumn("number", F.col("first") + F.col("rank") - 1).drop("salt", "rank", "first")


def placed(rows: DataFrame, capacity: int = 4096, **options) -> DataFrame:
    """Adds sequence_id and offset to the pieces of ``pieces``."""
    spark = rows.sparkSession
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).toPandas().sort_values("length")
    lengths = histogram["length"].to_numpy(np.int64)
    configs, _ = plan(lengths, histogram["n"].to_numpy(np.int64), capacity, **options)
    given = spark.sparkContext.broadcast(ranges(lengths, configs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = given.value
        key = place[:, 0] << 48 | place[:, 1] if len(place) else None
        for b in batches:
            length = b["length"].to_numpy(zero_copy_only=False)
            number = b["number"].to_numpy(zero_copy_only=False)
            if not len(length):
                continue
            _, first, copies, sequence, offset = place[np.searchsorted(key, length << 48 | number, side="right") - 1].T
            own = number - first
            cols = [*b.columns, pa.array(sequence + own // copies), pa.array(offset + own % copies * length)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "sequence_id", "offset"])

    rows = numbered(rows)
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long").drop("number")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False, **options) -> DataFrame:
    """All documents as pieces, each with its sequence and its offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``with_ids`` the ids of the piece as little-endian 32-bit numbers."""
    scratch = Scratch(docs.sparkSession, "packing")
    out = placed(scratch.keep(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity, **options)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
