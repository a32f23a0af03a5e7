"""Alignment of two tokenizers' tokens over a corpus.

A space and the text are encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B). Offsets where tokens of both end cut the tokens into groups, and
the two tokens that end there are linked. How often each pair of ids is linked
in the whole corpus is counted in dense vectors:

1. every task aligns its texts and keeps (pair, number) lists, one per shard of
   pairs (by the B id, so that all pairs of a B id share a shard);
2. each shard's distinct pairs get a minimal perfect hash;
3. the lists become dense vectors indexed by the hash and are summed in a tree
   of sixteen vectors a group, as deep as the number of tasks asks for;
4. a shard's file keeps its hash, the pair at each slot (a key is verified there
   before its count is used), the count, and whether it is the B id's highest;
5. a second pass aligns the texts again and looks the counts up.

Texts are cut at safe places first: before a run of spaces, tabs and line ends
that follows other characters than white space, and between a word of Latin
letters and a mark. A's rule for words cuts there, too, and no piece of B goes
on over such a place (which is checked when the file is loaded), so a unit's
tokens are the same alone and in its text, and a worker encodes a unit once for
all its occurrences.

Only pairs and counts travel, never texts: a hot source or a group of copies
adds nothing beyond its tasks' own lists. The files hold about 17 bytes for each
distinct pair of ids; they lie in the shared folder and are memory-mapped where
the store allows.

Defined cases: a null or empty text has no tokens, nor has one whose joined
token bytes differ from a space and the text (a U+2581 in it, bytes beyond UTF-8):
zeros and an empty column; repeated rows count each; an empty table gives an
empty result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph
from .common import Scratch, worker_memory
from .files import mapped, packed, put
from .hashing import grouped

#: Shards of pairs; a shard's distinct pairs are hashed in one task.
SHARDS = 64
#: Vectors that one node of the tree adds up.
FAN = 16
#: Units that a worker remembers before it starts anew, and what is encoded at a time.
REMEMBER = 500_000
CHUNK = 1 << 19
#: White space that A knows, beside the space, tab and line end where texts are cut.
ODD = r"\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of these letters is cut off before these marks, too.
LETTER, MARK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r".,;:!?"
PLAIN = re.compile(rf"[ \t\n]*(?:[{LETTER}]++(?=[ \t\n{MARK}]|\Z)|[^ \t\n]+)|[ \t\n]+")
UNIT = re.compile(rf"[ \t\n]*(?:[{LETTER}]++(?=[ \t\n{MARK}]|\Z)|[^ \t\n]+(?:(?<=[{ODD}])[ \t\n]+[^ \t\n]*)*)|[ \t\n]+")
SOME_ODD = re.compile(rf"[{ODD}]")
U = np.uint64
LOST = -1


def bytes_of_byte_level() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable
    ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores busy
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        byte = bytes_of_byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        ordinary = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if crossing := [p for p in ordinary if re.search(rf"[^▁ \t\n][▁ \t\n]|[\t\n].|.[\t\n]|[{LETTER}][{MARK}]", p)]:
            raise ValueError(f"pieces go on over a cut: {crossing[:5]}")
        self.lead = self.b.encode("\n")  # what stands before a unit that begins without a space
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each unit; none where either's bytes differ."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        n = len(self.lead)
        for i, u in enumerate(units):
            if u[0] != " ":
                b[i] = b[i][n:] if b[i][:n] == self.lead else []
            elif len(u) == 1:
                b[i] = self.lead[:1]  # encoding nothing gives nothing
        data = [u.encode() for u in units]
        if not (self.same(a, self.a_bytes, self.a_size, data) and self.same(b, self.b_bytes, self.b_size, data)):
            for i, d in enumerate(data):
                if b"".join([self.b_bytes[x] for x in b[i]]) != d or b"".join([self.a_bytes[x] for x in a[i]]) != d:
                    a[i] = b[i] = []
        return a, b

    @staticmethod
    def same(ids: list[list[int]], token: list[bytes], size: np.ndarray, data: list[bytes]) -> bool:
        """Whether the tokens of all units are the units' bytes."""
        flat = list(chain.from_iterable(ids))
        if b"".join(map(token.__getitem__, flat)) != b"".join(data):
            return False
        ends = np.pad(np.cumsum(size[flat]), (1, 0))[np.cumsum(list(map(len, ids)))] if flat else np.zeros(len(ids), np.int64)
        return np.array_equal(ends, np.cumsum(list(map(len, data))))


class Aligned:
    """Units with their tokens and links, remembered by a worker."""

    def __init__(self, pair: Pair, with_groups: bool):
        self.pair, self.with_groups, self.age = pair, with_groups, 0
        self.forget()

    def forget(self) -> None:
        self.age += 1
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_links = (np.empty(0, np.int64) for _ in range(3))
        self.good = np.empty(0, bool)
        self.keys = np.empty(0, U)  # of the links, unit after unit
        self.groups: list[str] = []

    def learn(self, units: list[str]) -> None:
        first = len(self.number)
        self.number.update(zip(units, range(first, first + len(units)), strict=True))
        a, b = self.pair.encode(units)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.pair.a_size[flat_a]), np.cumsum(self.pair.b_size[flat_b])
        # No token is empty, so each offset is one token's end at most.
        at = np.searchsorted(end_b, end_a)
        meet = np.flatnonzero(end_b[np.minimum(at, max(len(end_b) - 1, 0))] == end_a) if len(end_b) else np.empty(0, np.int64)
        last_a, last_b = meet, at[meet]
        close = np.cumsum(n_a)
        n_links = np.diff(np.searchsorted(last_a, close), prepend=0)
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_links, self.good = np.concatenate([self.n_links, n_links]), np.concatenate([self.good, n_b > 0])
        self.keys = np.concatenate([self.keys, (flat_a[last_a] * self.pair.width + flat_b[last_b]).astype(U)])
        if self.with_groups:
            name_a, name_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
            cuts, s, t = [], 0, 0
            for e, f in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
                cuts.append(f"{name_a[s] if e - s == 1 else ','.join(name_a[s:e])}|{name_b[t] if f - t == 1 else ','.join(name_b[t:f])}")
                s, t = e, f
            stop = np.cumsum(n_links).tolist()
            self.groups += [";".join(cuts[e - n : e]) for e, n in zip(stop, n_links.tolist(), strict=True)]

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of each text's units; None for a text without tokens."""
        cut = [(PLAIN if not SOME_ODD.search(t) else UNIT).findall(" " + t) if t else [] for t in texts]
        if len(self.number) > REMEMBER:
            self.forget()
        known = self.number
        if new := set(chain.from_iterable(cut)).difference(known):
            gc.disable()  # many small lists, none in a cycle
            try:
                self.learn(list(new))
            finally:
                gc.enable()
        out: list[np.ndarray | None] = []
        for own in cut:
            at = np.fromiter(map(known.__getitem__, own), np.int64, len(own)) if own else None
            out.append(at if at is not None and self.good[at].all() else None)
        return out


def pair_of(a_file: str, b_file: str) -> Pair:
    held = worker_memory("alignment")
    if (key := ("pair", a_file, b_file)) not in held:
        held[key] = Pair(a_file, b_file)
    return held[key]


def text_of(data: bytes) -> str:
    """The text, or none where the bytes are not UTF-8: no tokens give these."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return ""


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(number of the first row, texts) of about CHUNK bytes."""
    for at, own in grouped([x or b"" for x in batch["text"].to_pylist()], CHUNK):
        yield at, list(map(text_of, own))


def links(docs: DataFrame, a_file: str, b_file: str, shards: int = SHARDS) -> DataFrame:
    """(shard, part, keys, n): how often the texts of a task link each pair of
    ids, the pair (a, b) written as a * (size of B) + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_file, b_file)
        part = TaskContext.get().partitionId()
        held = Aligned(pair, False)
        uses = np.empty(0, np.int64)
        keys, counts = np.empty(0, U), np.empty(0, np.int64)

        def settled() -> tuple[np.ndarray, np.ndarray]:
            """What is counted so far, by pair."""
            n = np.repeat(np.pad(uses, (0, len(held.n_links) - len(uses))), held.n_links)
            own, back = np.unique(np.concatenate([keys, held.keys[n > 0]]), return_inverse=True)
            return own, np.bincount(back, np.concatenate([counts, n[n > 0]]), len(own)).astype(np.int64)

        for b in batches:
            for _, texts in decoded(b):
                if len(held.number) > REMEMBER:
                    keys, counts = settled()
                    held.forget()
                    uses = np.empty(0, np.int64)
                found = [x for x in held.texts(texts) if x is not None]
                own = np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=len(held.number))
                uses = np.pad(uses, (0, len(own) - len(uses))) + own
        keys, counts = settled()
        shard = (keys % U(pair.width) % U(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[by], np.arange(shards + 1))
        rows = [k for k in range(shards) if ends[k] < ends[k + 1]]
        cols = [pa.array(rows, pa.int32()), pa.array([part] * len(rows), pa.int32())]
        for x in (keys.astype(np.int64), counts):
            cols.append(pa.array([x[by[ends[k] : ends[k + 1]]] for k in rows], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(cols, ["shard", "part", "keys", "n"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "shard int, part int, keys array<long>, n array<long>")


def hashed(parts: DataFrame, root: str) -> None:
    """Write each shard's minimal perfect hash of its distinct pairs."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys = rows["key"].to_numpy().astype(U)
        f = mph.build(keys)
        kept = np.empty(len(keys), U)
        kept[mph.slots(f, keys)] = keys
        put(f"{root}/hash-{shard}", packed(f | {"keys": kept}))
        return pa.table({"shard": pa.array([shard], pa.int32()), "pairs": pa.array([len(keys)], pa.int64())})

    keys = parts.select("shard", F.explode("keys").alias("key")).distinct()
    keys.groupBy("shard").applyInArrow(build, "shard int, pairs long").agg(F.sum("pairs")).collect()


def counted(parts: DataFrame, scratch: Scratch, root: str, width: int) -> frozenset[int]:
    """Sum the tasks' lists as dense vectors in a tree, and write each shard's
    file of pairs, counts and highest counts; returns the shards there are."""

    def dense(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        f = mapped(f"{root}/hash-{shard}")
        out = np.zeros(len(f["keys"]), np.int64)
        for keys, n in zip(rows["keys"], rows["n"], strict=True):
            out[mph.slots(f, keys.values.to_numpy().astype(U))] += n.values.to_numpy()
        return vector(key, out)

    def vector(key: tuple, out: np.ndarray) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "vector": pa.array([out.tobytes()], pa.binary())})

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        return vector(key, sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["vector"]))

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        f = mapped(f"{root}/hash-{shard}")
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["vector"])
        own, back = np.unique(f["keys"] % U(width), return_inverse=True)
        most = np.zeros(len(own), np.int64)
        np.maximum.at(most, back, total)
        put(f"{root}/count-{shard}", packed(f | {"count": total, "best": (total == most[back]).astype(np.uint8)}))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    schema = "shard int, part int, vector binary"
    last = parts.agg(F.max("part")).first()[0] or 0
    up = lambda df: df.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("shard", "part")
    now, last = up(parts).applyInArrow(dense, schema), last // FAN
    while last >= FAN:
        now, last = up(scratch.keep(now, "vectors")).applyInArrow(added, schema), last // FAN
    done = scratch.keep(now, "vectors").groupBy("shard").applyInArrow(finish, "shard int").collect()
    return frozenset(r.shard for r in done)


class Counts:
    """The corpus counts in the shards' files."""

    def __init__(self, root: str, there: frozenset[int], shards: int, width: int):
        self.root, self.there, self.shards, self.width = root, there, shards, width
        self.files: dict[int, dict[str, np.ndarray]] = {}

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, 0 for one that was not counted, and whether it
        is its B id's highest."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        shard = (keys % U(self.width) % U(self.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[by], np.arange(self.shards + 1)).tolist()
        for k in range(self.shards):
            if ends[k] == ends[k + 1]:
                continue
            if k not in self.files:
                if k not in self.there:
                    continue
                self.files[k] = mapped(f"{self.root}/count-{k}")
            f, at = self.files[k], by[ends[k] : ends[k + 1]]
            slot = mph.slots(f, keys[at])
            known = (slot >= 0) & (f["keys"][slot] == keys[at])
            count[at[known]], best[at[known]] = f["count"][slot[known]], f["best"][slot[known]]
        return count, best


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs: DataFrame, a_file: str, b_file: str, shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    groups) of each whole text; ``groups`` reads ``a1,a2|b1;a3|b2,b3``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    root = scratch.path("pairs")
    parts = scratch.keep(links(docs, a_file, b_file, shards), "links")
    width = pair_of(a_file, b_file).width
    hashed(parts, root)
    there = counted(parts, scratch, root, width)
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = Aligned(pair_of(a_file, b_file), True), Counts(root, there, shards, width)
        sums, highs, upto, age = np.empty(0, np.int64), np.empty(0, np.int64), 0, held.age
        for b in batches:
            ids = b["doc_id"].to_pylist()
            for first, texts in decoded(b):
                found = held.texts(texts)
                if held.age > age:  # it has started anew
                    sums, highs, upto, age = sums[:0], highs[:0], 0, held.age
                count, best = counts(held.keys[upto:])
                upto, unit = len(held.keys), np.repeat(np.arange(len(sums), len(held.number)), held.n_links[len(sums) :]) - len(sums)
                new = len(held.number) - len(sums)
                own = np.zeros(new, np.int64)
                np.add.at(own, unit, count)
                own[unit[count == 0]] = LOST  # stands in texts without tokens alone
                sums, highs = np.concatenate([sums, own]), np.concatenate([highs, np.bincount(unit[best], minlength=new)])
                out: list[list] = [[] for _ in types]
                for doc, at in zip(ids[first : first + len(texts)], found, strict=True):
                    if at is None:
                        row = (doc, 0, 0, 0, 0, 0, 0, "", "")
                    else:
                        if np.any(sums[at] == LOST):
                            raise ValueError("a pair of the second pass is not among the counted ones")
                        n = int(held.n_links[at].sum())
                        groups = ";".join([held.groups[i] for i in at.tolist()])
                        row = (doc, int(held.n_a[at].sum()), int(held.n_b[at].sum()), n, n, int(highs[at].sum()), int(sums[at].sum()), hashlib.sha256(groups.encode()).hexdigest(), groups)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*COLUMNS, "groups"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = ", ".join(f"{c} long" for c in COLUMNS[:7]) + ", groups_sha256 string, groups string"
    return rows.mapInArrow(run, schema)
