"""Line deduplication by a log-template tree.

A line is parsed at a fixed depth: its token count and its leading tokens (two,
and one more for each 25 tokens, as prose gives long lines common beginnings)
name a leaf, tokens that hold a digit being masked as variable fields. A leaf holds a
list of templates, and a line joins the one most alike that agrees with it at
``alike`` of its places or more; the places where they differ are further
variable fields.

The lists are grown in turns over the distinct lines of all leaves at once. A
line may differ from its template at m places at most, none of them leading. The
other places are cut into blocks, and as at most m blocks can differ, a line is
entered under every set of all blocks but m. The commonest template and the
commonest other line of a set's bucket stand for it, and each line is compared
with those that its buckets name. Lines alike one that is itself alike no
commoner one join the best of these, which is a template from then on; the next
turn judges what is left, until a turn joins no line. Any other line is a
template of its own. No bucket is gathered: what stands for it is a grouped
maximum.

Where a block is one place (lines of up to seven tokens at the default), all
lines of a bucket are alike, so no line that is alike one still there is missed.
In longer lines a bucket can name a line that a member is not alike; the
member is then missed only if that holds for all buckets it shares with lines
alike it.

A template recurs if it stands in documents of at least ``min_texts`` different
kinds, the kind of a document being the template of its longest other line:
copies of one document, exact or edited, are one kind, so the body of a document
that has many copies is not taken for boilerplate. Templates of ``LONG`` tokens
or more recur from two kinds on, if the second longest other lines differ too.
Recurring templates name no kind: the rest is judged again without them until
no further one recurs. Several long templates that always stand together would
name each other's kind, so a template also recurs if the longest lines that
stand in too few documents to recur are of ``min_texts`` kinds, and at least
half as many as its documents. Lines of recurring templates are dropped from
every document.

Only hashes travel: a line is the 64-bit hash of its masked tokens and its
leaf's hash; two bytes for each token, which serve the likeness test alone, go
with the distinct lines of leaves that hold several lines. Texts are shuffled
once, to meet the places of dropped lines.

Defined cases: a null text stays null and has no lines; lines without a word
are never dropped; a text of any length is parsed line by line; repeated rows
(same id, same text) are one document and are treated alike; of equally common
lines the smaller hash stands for the bucket; rows with a null doc_id are
documents like any other; an empty table gives an empty result; other columns
pass through, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, looked_up, row_key
from .hashing import Powers, U, grouped, mixed, running, word_hashes

#: Leading tokens on the path to a leaf: DEPTH, and one for each DEEPER tokens.
DEPTH, DEEPER = 2, 25
#: The code of a masked token.
MASK = 65535
#: Bytes of texts that are hashed together.
CHUNK = 1 << 20
#: Sets of places under which a line is entered, if so few can do.
KEYS = 12
#: Tokens from which a template recurs in two kinds of documents.
LONG = 50


def coded(texts: list[bytes], powers: Powers) -> dict[str, np.ndarray]:
    """text, pos, tokens, leaf, line of each line with a word of the texts, and
    the two-byte codes of all their tokens in a row (first: where a line's
    begin). leaf and line hash masked tokens in full."""
    code = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    word, start, end = word_hashes(code, powers)
    digits = np.concatenate([[0], np.cumsum((code >= 48) & (code <= 57), dtype=np.int32)])
    masked = digits[end] > digits[start]
    word = np.where(masked, U(2), word | U(1))
    breaks = np.flatnonzero(code == 10)
    number = np.searchsorted(breaks, start)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    first = np.flatnonzero(np.diff(number, prepend=-1))
    last = np.append(first[1:], len(word))
    tokens = last - first
    text = np.searchsorted(begin, start[first], side="right") - 1
    lead = running(word, first, first + np.minimum(tokens, DEPTH + tokens // DEEPER), powers)
    leaf = mixed(mixed(tokens.astype(U)) ^ lead)
    return {
        "text": text, "pos": number[first] - np.searchsorted(breaks, begin)[text], "tokens": tokens, "leaf": leaf, "line": running(word, first, last, powers),
        "first": first, "codes": np.where(masked, MASK, (word >> U(40)) % U(MASK)).astype("<u2"),
    }


def parsed(docs: DataFrame) -> DataFrame:
    """(row, pos, tokens, leaf, line, lead, fields) for each line with a word.

    fields: two bytes for each token; line, leaf: hashes of the masked tokens
    in full; lead: whether it is the first such line of its text. Texts are
    hashed ``CHUNK`` bytes at a time, a longer one in pieces of whole lines."""

    def pieces(text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > CHUNK:
            cut = text.rfind(b"\n", at, at + CHUNK)
            cut = cut if cut >= 0 else text.find(b"\n", at + CHUNK)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def whole(texts: list[bytes], powers: Powers) -> Iterator[dict[str, np.ndarray]]:
        if len(texts) > 1 or len(texts[0]) <= CHUNK:
            yield coded(texts, powers)
            return
        lines = 0
        for part in pieces(texts[0]):
            out = coded([part], powers)
            out["pos"] += lines
            lines += part.count(b"\n") + 1
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            rows = b["row"].to_numpy(zero_copy_only=False)
            for at, texts in grouped([(x.as_py() or "").encode("utf-8", "surrogatepass") for x in b["text"]], CHUNK):
                parts = list(whole(texts, powers))
                leads = first_of([(p["text"], p["line"]) for p in parts])
                for p, lead in zip(parts, leads, strict=True):
                    offsets = 2 * np.append(p["first"], len(p["codes"])).astype(np.int64)
                    fields = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p["first"]), [None, pa.py_buffer(offsets), pa.py_buffer(p["codes"])])
                    cols = [rows[at + p["text"]], p["pos"].astype(np.int32), p["tokens"].astype(np.int32), p["leaf"].view(np.int64), p["line"].view(np.int64), lead]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), fields.cast(pa.binary())], ["row", "pos", "tokens", "leaf", "line", "lead", "fields"])

    rows = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, pos int, tokens int, leaf long, line long, lead boolean, fields binary")


def first_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For parts of (text, line): whether the pair is met for the first time."""
    text, line = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((line, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(line[order].view(np.int64)) != 0)
    out = np.empty(len(order), bool)
    out[order] = new
    return np.split(out, np.cumsum([len(x) for x, _ in parts])[:-1])


def enough(min_texts: int) -> Column:
    """Whether n documents can make a template of so many tokens recur."""
    return (F.col("n") >= min_texts) | ((F.col("tokens") >= LONG) & (F.col("n") >= 2))


def crowded(lines: DataFrame, counts: DataFrame, scratch: Scratch, min_texts: int) -> DataFrame:
    """(line, leaf, n, fields, head): the distinct lines of the leaves that hold
    several of them, in documents enough. ``counts``: line, leaf, tokens, n."""
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"), F.count("*").alias("kinds"))
    leaves = scratch.keep(leaves.where("kinds > 1").where(enough(min_texts)).select("leaf"), "leaves")
    own = looked_up(lines.where("lead").select("leaf", "line", "fields"), leaves, "leaf", "left_semi").groupBy("line")
    return scratch.keep(own.agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"), F.first("fields").alias("fields"), F.lit(False).alias("head")), "crowded")


def agreeing(tokens: int, alike: float) -> list[list[slice]]:
    """Sets of places of which one is equal in any two alike lines of a leaf, as
    slices of their fields. The places behind the leading tokens are cut into
    blocks, as many as ``KEYS`` sets allow; lines alike differ in so many blocks
    at most, so a set is all blocks but so many."""
    lead = min(tokens, DEPTH + tokens // DEEPER)
    rest, differ = tokens - lead, int((1 - alike) * tokens + 1e-9)
    if differ >= rest:
        return [[]]
    parts = max((n for n in range(differ + 1, rest + 1) if comb(n, differ) <= KEYS), default=differ + 1)
    cuts = [2 * (lead + rest * i // parts) for i in range(parts + 1)]
    blocks = [slice(s, e) for s, e in pairwise(cuts)]
    return [list(own) for own in combinations(blocks, parts - differ)]


def block_keys(pool: DataFrame, alike: float) -> DataFrame:
    """(key, line, n, head): each line under every set of its ``agreeing`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[list[slice]]] = {}
        for b in batches:
            keys, times = [], []
            for leaf, fields in zip(b["leaf"].to_pylist(), b["fields"].to_pylist(), strict=True):
                if (sets := known.get(len(fields))) is None:
                    sets = known[len(fields)] = agreeing(len(fields) // 2, alike)
                lead = leaf.to_bytes(8, "little", signed=True)
                keys += [xxhash.xxh64_intdigest(b"".join([lead, i.to_bytes(4, "little"), *[fields[x] for x in own]])) - (1 << 63) for i, own in enumerate(sets)]
                times.append(len(sets))
            at = pa.array(np.repeat(np.arange(len(times)), times))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(b[c].take(at) for c in ("line", "n", "head"))], ["key", "line", "n", "head"])

    return pool.select("line", "leaf", "n", "fields", "head").mapInArrow(run, "key long, line long, n long, head boolean")


def likened(pool: DataFrame, scratch: Scratch, alike: float) -> DataFrame:
    """(line, template, same, n): lines and the templates or commonest lines of
    their buckets that they are alike; same: places that agree; n: the
    template's documents."""
    keys = scratch.keep(block_keys(pool, alike), "keys")
    rank = F.struct("n", (-F.col("line")).alias("tie"))
    best = [F.max(F.when(F.col("head") == head, rank)) for head in (True, False)]
    elected = keys.groupBy("key").agg(F.count("*").alias("members"), F.array(*best).alias("best")).where("members > 1")
    elected = scratch.keep(elected.select("key", "best"), "elected")
    pairs = keys.where("not head").join(elected, "key").select("line", F.explode("best").alias("best")).where("best is not null")
    pairs = pairs.select("line", (-F.col("best.tie")).alias("template"), F.col("best.n").alias("n")).where("line <> template").distinct()
    fields = pool.select("line", "fields")
    sides = pairs.join(fields, "line").join(fields.withColumnsRenamed({"line": "template", "fields": "model"}), "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, good = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["fields"].to_pylist(), b["model"].to_pylist(), strict=True)):
                if len(x) == len(y):
                    same[i] = np.count_nonzero(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2"))
                    good[i] = same[i] >= alike * (len(x) // 2) - 1e-9
            out = pa.RecordBatch.from_arrays([b["line"], b["template"], pa.array(same), b["n"]], ["line", "template", "same", "n"])
            yield out.filter(pa.array(good))

    found = scratch.keep(sides.mapInArrow(run, "line long, template long, same long, n long"), "likened")
    scratch.drop(keys)
    return found


def templates(pool: DataFrame, scratch: Scratch, alike: float) -> DataFrame:
    """(line, template) of the lines that join a template, and of the templates
    that lines join, themselves."""
    made = pool.sparkSession.createDataFrame([], "line long, template long")
    while True:
        found = likened(pool, scratch, alike)
        if found.isEmpty():
            return made.unionByName(made.select(F.col("template").alias("line"), "template").distinct())
        lower = scratch.keep(found.select(F.col("line").alias("template")).distinct(), "lower")
        best = F.max(F.struct("same", "n", (-F.col("template")).alias("tie"))).alias("best")
        joined = looked_up(found, lower, "template", "left_anti").groupBy("line").agg(best)
        joined = scratch.keep(joined.select("line", (-F.col("best.tie")).alias("template")), "templates")
        scratch.drop(found)
        made = made.unionByName(joined)
        heads = joined.select(F.col("template").alias("line"), F.lit(True).alias("new")).distinct()
        left = pool.join(joined.select("line"), "line", "left_anti").join(heads, "line", "left")
        left = scratch.keep(left.withColumn("head", F.col("head") | F.coalesce("new", F.lit(False))).drop("new"), "crowded")
        scratch.drop(pool)
        pool = left


def likely(lines: DataFrame, scratch: Scratch, alike: float, min_texts: int) -> DataFrame:
    """(line, template): the lines whose template stands in documents enough."""
    counts = lines.where("lead").groupBy("line").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"))
    counts = scratch.keep(counts, "counts")
    made = scratch.keep(templates(crowded(lines, counts, scratch, min_texts), scratch, alike), "made")
    own = looked_up(counts.select("line", "tokens", "n"), made, "line", "left").where(F.col("template").isNotNull() | enough(min_texts))
    own = scratch.keep(own.withColumn("template", F.coalesce("template", "line")), "own")
    scratch.drop(counts)
    often = own.groupBy("template").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens")).where(enough(min_texts))
    often = scratch.keep(often.select("template"), "often")
    return scratch.keep(looked_up(own.select("line", "template"), often, "template", "left_semi"), "likely")


def uses_of(lines: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, name, open, tokens, pos): per text the templates that may recur (open)
    and its three longest other lines, which are enough to name its kind."""
    rows = looked_up(lines.select("row", "pos", "tokens", "line"), known, "line", "left")
    rows = rows.select("row", "pos", "tokens", F.coalesce("template", "line").alias("name"), F.col("template").isNotNull().alias("open"))
    rank = F.row_number().over(Window.partitionBy("row", "open").orderBy(F.desc("tokens"), "pos"))
    rows = rows.withColumn("any", F.max("open").over(Window.partitionBy("row"))).where("any").withColumn("rank", rank).where("open or rank <= 3")
    return scratch.keep(rows.groupBy("row", "name", "open").agg(F.max("tokens").alias("tokens"), F.min("pos").alias("pos")), "uses")


def kinds(uses: DataFrame) -> DataFrame:
    """(template, tokens, kind, second) for each open use of a template in a text:
    the names of the longest and the second longest other line."""
    order = Window.partitionBy("row").orderBy(F.desc("tokens"), "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = [F.nth_value("name", i).over(whole) for i in (1, 2, 3)]
    rows = uses.select("name", "open", "tokens", F.row_number().over(order).alias("i"), *(x.alias(f"t{i}") for i, x in enumerate(nth, 1)))
    kind = F.coalesce(F.when(F.col("i") == 1, F.col("t2")).otherwise(F.col("t1")), F.lit(0))
    second = F.coalesce(F.when(F.col("i") <= 2, F.col("t3")).otherwise(F.col("t2")), kind)
    return rows.where("open").select(F.col("name").alias("template"), "tokens", kind.alias("kind"), second.alias("second"))


def beside_rare_lines(uses: DataFrame, min_texts: int) -> DataFrame:
    """(template): templates whose texts hold enough kinds of lines that are in
    too few documents to recur."""
    rare = F.min_by("name", F.when(~F.col("open"), F.struct(-F.col("tokens"), "pos"))).over(Window.partitionBy("row"))
    own = uses.withColumn("rare", rare).where("open").groupBy(F.col("name").alias("template"))
    own = own.agg(F.count("*").alias("n"), F.count_distinct("rare").alias("kinds"))
    return own.where((F.col("kinds") >= min_texts) & (2 * F.col("kinds") >= F.col("n"))).select("template")


def beside_other_kinds(uses: DataFrame, min_texts: int) -> DataFrame:
    """(template): templates whose texts are of enough kinds."""
    own = kinds(uses).groupBy("template").agg(
        F.count_distinct("kind").alias("kinds"), F.max("tokens").alias("tokens"), F.min("kind").alias("k0"), F.max("kind").alias("k1"), F.min("second").alias("s0"), F.max("second").alias("s1")
    )
    long = (F.col("tokens") >= LONG) & (F.col("k0") < F.col("k1")) & (F.col("s0") < F.col("s1"))
    return own.where((F.col("kinds") >= min_texts) | long).select("template")


def recurring(lines: DataFrame, scratch: Scratch, alike: float, min_texts: int) -> DataFrame:
    """(line): masked lines whose template stands in enough kinds of texts."""
    known = likely(lines, scratch, alike, min_texts)
    uses = uses_of(lines, known, scratch)
    gone = scratch.keep(beside_rare_lines(uses, min_texts), "often")
    while True:
        rest = looked_up(uses, gone.withColumnRenamed("template", "name"), "name", "left_anti")
        found = scratch.keep(beside_other_kinds(rest, min_texts), "often")
        if found.isEmpty():
            return looked_up(known, gone, "template", "left_semi").select("line")
        gone = gone.unionByName(found)


def without_recurring_lines(docs: DataFrame, alike: float = 0.7, min_texts: int = 10) -> DataFrame:
    """The rows of ``docs`` with the text left after recurring lines are dropped,
    and n_lines and n_dropped (long; lines with a word)."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(parsed(docs), "lines")
    gone = scratch.keep(recurring(lines, scratch, alike, min_texts), "recurring")
    hits = looked_up(lines.select("row", "pos", "line"), gone, "line", "left_semi")
    row, places = fresh(docs, "row"), fresh(docs, "places")
    hits = scratch.keep(hits.groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(places)), "hits")
    scratch.drop(lines)
    given = looked_up(docs.withColumn(row, row_key()), hits, row, "left")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(places, i)), "\n")
    worded = F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    counts = {
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(worded).cast("long"),
        "n_dropped": F.coalesce(F.size(places), F.lit(0)).cast("long"),
        "text": F.when(F.col(places).isNull(), F.col("text")).otherwise(left),
    }
    return given.withColumns(counts).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
