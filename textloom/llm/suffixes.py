"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, most significant digit
first: after the last digit the groups of equal suffixes are exactly the
repeated windows of that length. Each pass deals the suffixes that are left by
one more digit and drops groups that one document has alone.

One suffix per byte would be shuffled 50 times over, so windows travel together.
In every window the k-gram with the least hash is its anchor: equal windows have
equal anchors at equal places, so comparing windows under one anchor loses none,
and neighbouring windows mostly share theirs (some six anchors per hundred
bytes). The digits are

1. the anchor's k-gram: grams of one document go;
2. the context, all bytes of the windows that share the anchor: where a smaller
   document has the same context, all its windows repeat; contexts that are
   alone under their gram go, and only of those that are left, once each, the
   bytes are taken from the texts;
3. the gram with half of the missing bytes to the left or to the right, one of
   which is inside each window: halves of one document go;
4. the window itself, for the few contexts that are left (edges of passages).

Whole copies of a smaller document are set aside first: all their windows
repeat. Grams, contexts and windows are compared by 64-bit hashes, whole texts by
SHA-256. Digits are judged by grouped minima and maxima of the documents, so a gram
of very many documents is no large group; from the third on they are counted for
distinct contexts, not for each copy. Windows of different grams never meet, so all
digits go by parts of the grams, one after the other, which bounds what lies on
disk even where all texts are shared.

Defined cases: null and empty texts, and texts shorter than a window, keep all
their bytes; texts of any length are taken ``CHUNK`` bytes at a time; a null doc_id is compared with nothing; rows that repeat a doc_id
are the same document and remove nothing from each other; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up
from .hashing import BASE, VALUE, Powers, U, grouped, mixed

#: Bytes of texts that are taken together.
CHUNK = 1 << 19
#: Scans of the texts, each for its own grams, and rounds in which the grams of a
#: scan are judged: no step holds or shuffles rows of all grams.
SCANS, PARTS = 2, 2
#: Open contexts whose bytes are taken together.
OPEN = 1 << 12
#: Low bits of an ordering value that hold the place of the gram.
PLACE = U((1 << 24) - 1)


class Bytes:
    """Bytes whose substrings are hashed by differences of one running sum."""

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(data) + 1)
        self.run = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * up[:-1], dtype=U, out=self.run[1:])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes at each place."""
        n = max(0, len(self.run) - k)
        return mixed((self.run[k:] - self.run[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The hash of the bytes from start to end, with a number."""
        return mixed(mixed((self.run[end] - self.run[start]) * self.down[start]) + salt.astype(U) * U(BASE))


class Piece:
    """Texts of one group laid end to end; ``doc`` is the number of each part's
    text, ``first`` its first byte there and ``begin`` its place here."""

    def __init__(self, parts: list[tuple[int, int, bytes]], depth: int, k: int, powers: Powers):
        self.raw = b"".join(p[2] for p in parts)
        self.doc, self.first = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
        size = np.array([len(p[2]) for p in parts], np.int64)
        self.begin = np.cumsum(size) - size
        self.bytes = Bytes(np.frombuffer(self.raw, np.uint8), powers)
        x = self.bytes.grams(k)
        value, width, done = (x & ~PLACE) | np.arange(len(x), dtype=U), depth - k + 1, 1
        while done < width:
            step = min(done, width - done)
            value = np.minimum(value[: len(value) - step], value[step:])
            done += step
        anchor = (value & PLACE).astype(np.int64)
        edge = np.zeros(len(value) + 1, np.int8)
        long = size >= depth
        edge[self.begin[long]] += 1
        edge[(self.begin + size - depth + 1)[long]] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        same = (anchor[1:] == anchor[:-1]) & valid[1:] & valid[:-1]
        here = np.concatenate([[True], ~same])[: len(value)]
        after = np.concatenate([~same, [True]])[: len(value)]
        # runs of windows with one anchor
        self.start, self.end = np.flatnonzero(valid & here), np.flatnonzero(valid & after) + 1
        self.anchor = anchor[self.start]
        self.gram = x[self.anchor]
        self.part = np.searchsorted(self.begin, self.start, side="right") - 1


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def laid(texts: pa.Array, depth: int, k: int, powers: Powers) -> Iterator[Piece]:
    """The texts in groups of about CHUNK bytes; a longer text in several parts
    that overlap by a window."""
    own, size = [], 0
    for i, x in enumerate(texts):
        data = raw(x.as_py())
        for at in range(0, len(data) - depth + 1, CHUNK):
            part = data[at : at + CHUNK + depth - 1]
            if own and size + len(part) > CHUNK:
                yield Piece(own, depth, k, powers)
                own, size = [], 0
            own.append((i, at, part))
            size += len(part)
    if own:
        yield Piece(own, depth, k, powers)


def run_rows(docs: DataFrame, depth: int, k: int, scan: int) -> DataFrame:
    """(gram, context, doc, place) for each run of windows whose anchor's gram is
    of this scan; the place holds where the run starts in the text, how many
    windows it has and where its anchor lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            (ids,) = numbers(b, "doc")
            for p in laid(b["text"], depth, k, powers):
                hit = np.flatnonzero(p.gram.view(np.int64) % SCANS == scan)
                start, end, anchor, part = p.start[hit], p.end[hit], p.anchor[hit], p.part[hit]
                context = p.bytes.spans(start, end + depth - 1, anchor - start)
                place = (p.first[part] + start - p.begin[part]) << 12 | (end - start) << 6 | (anchor - start)
                cols = [p.gram[hit].view(np.int64), context.view(np.int64), ids[p.doc[part]], place]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["gram", "context", "doc", "place"])

    return docs.mapInArrow(run, "gram long, context long, doc long, place long")


def taken(data: bytes, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of pieces of ``data``."""
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
    body = np.frombuffer(data, np.uint8)[at]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins and the last
    ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8)[: offsets[-1]] if body else np.empty(0, np.uint8), offsets


def numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b[n].to_numpy(zero_copy_only=False) for n in names]


def open_rows(docs: DataFrame, depth: int) -> DataFrame:
    """(context, least, n, at, part, bytes) for the contexts in a document's
    lists ``contexts``, ``places`` and ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            (ids,) = numbers(b, "doc")
            contexts, places, parts = (b[c].flatten().to_numpy(zero_copy_only=False) for c in ("contexts", "places", "parts"))
            upto = np.concatenate([[0], np.cumsum(b["places"].value_lengths().to_numpy(zero_copy_only=False))])
            for first, own in grouped([raw(x.as_py()) for x in b["text"]], CHUNK):
                data = b"".join(own)
                size = np.array([len(x) for x in own], np.int64)
                begin = np.cumsum(size) - size
                for at in range(upto[first], upto[first + len(own)], OPEN):
                    to = min(at + OPEN, upto[first + len(own)])
                    context, one = np.unique(contexts[at:to], return_index=True)
                    place, part = places[at:to][one], parts[at:to][one]
                    of = np.searchsorted(upto, at + one, side="right") - 1 - first
                    start, n, anchor = place >> 12, place >> 6 & 63, place & 63
                    stop = start + n + depth - 1
                    inside = np.flatnonzero(stop <= size[of])  # another row of the document may be shorter
                    context, part, of, start, stop, n, anchor = (x[inside] for x in (context, part, of, start, stop, n, anchor))
                    body = taken(data, begin[of] + start, stop - start)
                    flat, offset = content(body)
                    same = Bytes(flat, powers).spans(offset[:-1], offset[1:], anchor).view(np.int64) == context
                    cols = [context, ids[first + of], n.astype(np.int32), anchor.astype(np.int32), part]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), body], ["context", "least", "n", "at", "part", "bytes"]).filter(pa.array(same))

    return docs.mapInArrow(run, "context long, least long, n int, at int, part int, bytes binary")


def halves(contexts: DataFrame, depth: int, k: int) -> DataFrame:
    """(half, context, least, side): the third digit of each context."""
    more = (depth - k) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            data, offset = content(b["bytes"])
            own = Bytes(data, powers)
            context, least, at = numbers(b, "context", "least", "at")
            for side, s, e in ((0, at - more, at + k), (1, at, at + k + more)):
                ok = np.flatnonzero((s >= 0) & (e <= np.diff(offset)))
                half = own.spans(offset[ok] + s[ok], offset[ok] + e[ok], np.full(len(ok), side))
                yield pa.RecordBatch.from_arrays([pa.array(half.view(np.int64)), pa.array(context[ok]), pa.array(least[ok]), pa.array(np.full(len(ok), side, np.int8))], ["half", "context", "least", "side"])

    return contexts.select("context", "least", "at", "bytes").mapInArrow(run, "half long, context long, least long, side byte")


def windows(contexts: DataFrame, depth: int, k: int) -> DataFrame:
    """(window, context, least, i): the last digit, for the windows on the
    sides of a context that are left; i is the window's place in its context."""
    more = (depth - k) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            data, offset = content(b["bytes"])
            own = Bytes(data, powers)
            context, least, n, at, left, right = numbers(b, "context", "least", "n", "at", "left", "right")
            of = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            ok = np.where(at[of] - i >= more, left[of], right[of]).astype(bool)
            of, i = of[ok], i[ok]
            begin = offset[of] + i
            window = own.spans(begin, begin + depth, np.zeros(len(of)))
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(context[of]), pa.array(least[of]), pa.array(i.astype(np.int8))], ["window", "context", "least", "i"])

    rows = contexts.select("context", "least", "n", "at", "bytes", "left", "right")
    return rows.mapInArrow(run, "window long, context long, least long, i byte")


def shared(rows: DataFrame, digit: str) -> DataFrame:
    """The rows of a written table whose digit occurs under two least documents
    or more."""
    several = rows.groupBy(digit).agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select(digit)
    return rows.join(several, digit)


def copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc): documents whose whole text a smaller document has, too."""
    hashed = scratch.keep(docs.select("doc", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")), "digests")
    first = hashed.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    found = hashed.join(first, "sha", "left").groupBy("doc").agg(F.min(F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).alias("copy"))
    found = scratch.keep(found.where("copy").select("doc"), "copies")
    scratch.drop(hashed)
    return found


def judged(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, place, context): the runs that repeat as a whole, without a context,
    and those that are the first of their context and may repeat in part. Rows of
    a gram stand or fall by that gram's rows alone."""
    several = runs.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("gram")
    several = scratch.keep(several, "grams")  # from a table, a hot gram's part of the join can be split
    found = scratch.keep(runs.join(several, "gram"), "contexts")
    scratch.drop(several)
    least = scratch.keep(found.groupBy("context").agg(F.min("doc").alias("least"), F.min("gram").alias("gram")), "least")
    several = least.groupBy("gram").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi")
    known = least.join(several.select("gram", F.lit(True).alias("open")), "gram", "left").select("context", "least", "open")
    rows = found.join(known, "context").where("doc > least or open")
    out = scratch.keep(rows.select("doc", "place", F.expr("if(doc > least, null, context)").alias("context")), "judged")
    scratch.drop(found)
    scratch.drop(least)
    return out


def repeats(docs: DataFrame, scratch: Scratch, depth: int, k: int) -> DataFrame:
    """(doc, start, mask): bit i is set if the window at start + i also starts
    in a document with a smaller id. ``docs``: doc, text."""
    parts = []
    for scan in range(SCANS):
        runs = scratch.keep(run_rows(docs, depth, k, scan), "runs")
        for part in range(PARTS):
            parts.append(judged(runs.where(F.pmod(F.col("gram"), F.lit(SCANS * PARTS)) == scan + SCANS * part), scratch))
        scratch.drop(runs)
    rows = reduce(DataFrame.unionByName, (own.withColumn("part", F.lit(i % PARTS)) for i, own in enumerate(parts)))
    whole, rest = rows.where("context is null"), rows.where("context is not null")
    by_doc = rest.groupBy("doc").agg(*(F.collect_list(c).alias(f"{c}s") for c in ("context", "place", "part")))
    first = scratch.keep(open_rows(docs.join(by_doc, "doc"), depth), "open")

    bit = F.expr("shiftleft(1L, cast(i as int))")
    side = lambda i: F.max(F.col("side") == i)
    marks = []
    for part in range(PARTS):
        own = first.where(F.col("part") == part)
        digit = scratch.keep(halves(own, depth, k), "halves")
        sides = shared(digit, "half").groupBy("context").agg(side(0).alias("left"), side(1).alias("right"))
        edges = scratch.keep(windows(own.join(sides, "context"), depth, k), "windows")
        scratch.drop(digit)
        earlier = edges.groupBy("window").agg(F.min("least").alias("before"), F.max("least").alias("last")).where("before < last")
        found = edges.join(earlier.select("window", "before"), "window").where("before < least")
        marks.append(scratch.keep(found.groupBy("context").agg(F.bit_or(bit).alias("mark")), "marks"))
        scratch.drop(edges)
    scratch.drop(first)
    mark = reduce(DataFrame.unionByName, marks)

    start = F.expr("shiftright(place, 12)").alias("start")
    rows = whole.select("doc", start, F.expr("shiftleft(1L, cast(shiftright(place, 6) & 63 as int)) - 1").alias("mask"))
    rows = rows.unionByName(rest.join(mark, "context").select("doc", start, F.col("mark").alias("mask")))
    out = scratch.keep(rows, "repeats")
    for own in (*parts, *marks):
        scratch.drop(own)
    return out


def removed(starts: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows at these places cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > depth) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.append(cut, len(starts)) - 1] + depth).tolist(), strict=True))


def places(starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Every place start + i whose bit i is set."""
    of, i = np.nonzero(np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return starts[of] + i


def without_repeats(docs: DataFrame, depth: int = 50, k: int = 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row;
    spans: the removed runs as (start, end) in bytes."""
    if not 0 <= (depth - k) < 62:
        raise ValueError("depth - k must be from 0 to 61")
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = rows.where("doc is not null")
    whole = copies(named, scratch)
    found = repeats(looked_up(named, whole, "doc", "left_anti"), scratch, depth, k)
    marks = found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"), F.lit(False).alias("copy"))
    marks = marks.unionByName(whole.select("doc", F.lit(True).alias("copy")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts, masks, copy in zip(b["text"], b["starts"], b["masks"], b["copy"].to_pylist(), strict=True):
                data = raw(text.as_py())
                runs = [(0, len(data))] if copy and len(data) >= depth else []
                if starts.values is not None and not copy:
                    runs = removed(places(*(x.values.to_numpy(zero_copy_only=False) for x in (starts, masks))), depth)
                cuts = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
                for col, v in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs), strict=True):
                    col.append(v)
            spans = pa.array([[{"start": s, "end": e} for s, e in r] for r in out[4]], span)
            cols = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()], strict=False)]
            yield pa.RecordBatch.from_arrays([b["doc"], *cols, spans], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return rows.join(marks, "doc", "left").mapInArrow(run, schema)
