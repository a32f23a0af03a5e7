"""Quality rules: base counts of a text and an n-gram perplexity band.

The model is a modified Kneser-Ney model of characters, one for each language.
A symbol is a code point of sixteen bits without case (all digits are one symbol,
all white space another; code points beyond sixteen bits are named by their block
of 256; a run of one mark or of white space is one symbol, as else long runs,
which are easy to foretell, would make up for rare marks), so an n-gram of four
symbols is a 64-bit number. Spark counts the
n-grams of every whole text, the lower orders by their different predecessors,
and joins discounts, contexts and lower orders to probabilities, order by order.
Highest-order n-grams seen fewer than ``least`` times keep no entry: their mass
goes to the lower orders, so that a text can't vouch for itself; copies of a text
count once.

The model is kept as sorted hash arrays, in files by hash range in the shared
folder: the 64-bit hash of (language, order, n-gram), its log10 probability and
its back-off weight as a context. Tasks that score look up the distinct n-grams
of a piece of text by binary search in the files, of which they hold a few open;
nothing of the model passes the driver or is broadcast.

The perplexity band is set per language over all distinct texts that pass the base
rules: the lower and upper quartile of log10 perplexity, widened by ``reach``
times their distance. Texts outside are rejected.

Defined cases: a null text has no words, fails the base rules and is not kept;
a null language forms a group of its own; a null doc_id is a document like any
other; texts of any length are scored whole; an empty table gives an empty result;
repeated rows each get a row; other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, looked_up, worker_memory
from .files import mapped, packed, put
from .hashing import U, mixed

BITS, ORDER = 16, 4
SYMBOLS = 1 << BITS
SPACES = " \t\n\v\f\r"
MARKS = "#*$%&|<>"
#: Characters that are coded at a time.
CHUNK = 1 << 19
#: log10 perplexity is binned at this many steps for the quartiles.
STEPS = 1000
#: Entries of a file of the model, and files that a worker holds open.
SHARD, OPEN = 1 << 19, 32
#: log10 probability of a symbol that no text of the language holds.
UNIFORM = -float(np.log10(SYMBOLS - 1))


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point of sixteen bits (0 is the start mark), and
    which symbols are marks or white space."""
    held = worker_memory("quality")
    if "symbols" not in held:
        marks = np.array([unicodedata.category(chr(x))[0] in "PSZ" for x in range(SYMBOLS)])
        held["symbols"] = symbol_table(), marks
    return held["symbols"]


def symbol_table() -> np.ndarray:
    """The symbol of each code point of sixteen bits, without case."""
    out = np.arange(SYMBOLS, dtype=np.uint16)
    for cp in range(SYMBOLS):
        c = chr(cp)
        if c.isspace():
            out[cp] = 32
        elif unicodedata.category(c) == "Nd":
            out[cp] = 48
        elif len(low := c.lower()) == 1:
            out[cp] = ord(low)
    out[0], out[0xE000:0xF900] = 1, 0xF8FF
    return out


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code at each place of the texts, ORDER - 1 start marks before
    each text, and where each text's marks begin. Codes of marks end in 0."""
    (table, marks), parts, starts, at = symbols(), [], [], 0
    pad = np.zeros(ORDER - 1, np.uint16)
    for t in texts:
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        own = table[cp & np.uint32(SYMBOLS - 1)]
        far = np.flatnonzero(cp >= SYMBOLS)
        own[far] = 0xE000 + (cp[far] >> 8)  # private-use symbols stand for blocks
        own = own[(np.diff(own, prepend=0) != 0) | ~marks[own]]
        parts += [pad, own]
        starts.append(at)
        at += len(pad) + len(own)
    s = np.concatenate([pad, *parts]).astype(U)
    code = np.zeros(max(0, len(s) - ORDER + 1), U)
    for k in range(ORDER):
        code |= s[k : len(s) - ORDER + 1 + k] << U(BITS * (ORDER - 1 - k))
    return code, np.array(starts, np.int64)


def pieces(texts: Iterator[str]) -> Iterator[list[str]]:
    """Lists of texts of about CHUNK characters; a longer text comes alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > CHUNK:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def language() -> Column:
    """A number for the text's language."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")))


def by_language(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(language, rows, texts) of a batch, about CHUNK characters at a time."""
    g = b["g"].to_numpy(zero_copy_only=False)
    for own in np.unique(g):
        rows, at = np.flatnonzero(g == own), 0
        for texts in pieces(b["text"][i].as_py() or "" for i in rows.tolist()):
            yield int(own), rows[at : at + len(texts)], texts
            at += len(texts)


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, text): each distinct text of a language once, so that no text vouches
    for its copies. Rows are counted by two hashes of their texts; only texts
    that occur again are grouped, and one text of a group leaves each task."""
    rows = docs.select(language().alias("g"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("g", "text")).withColumn("i", F.xxhash64(F.lit(7), "text"))
    again = keyed.groupBy("h", "i").agg(F.count("*").alias("n")).where("n > 1").select("h").distinct()
    again = scratch.keep(again, "again")
    once = looked_up(keyed, again, "h", "left_anti").select("g", "text")
    copies = looked_up(keyed, again, "h", "left_semi").groupBy("g", "h", "i").agg(F.first("text").alias("text"))
    return once.unionByName(copies.select("g", "text"))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(g, code, n) over all whole texts of (g, text), g naming the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, _, texts in by_language(b):
                code, n = np.unique(coded(texts)[0], return_counts=True)
                held = code & U(SYMBOLS - 1) > 0
                code, n = code[held].view(np.int64), n[held]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), g)), pa.array(code), pa.array(n.astype(np.int64))], ["g", "code", "n"])

    rows = rows.mapInArrow(run, "g long, code long, n long")
    return rows.groupBy("g", "code").agg(F.sum("n").alias("n"))


def last_of(k: int) -> Column:
    """The last k symbols of a code."""
    return F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))


def discounts(counts: DataFrame) -> DataFrame:
    """(g, d1, d2, d3): what n-grams of one order that are counted once, twice
    and more often give away, by how many are counted one to four times."""
    n = [F.greatest(F.lit(1.0), F.sum((F.col("n") == i).cast("double"))) for i in (1, 2, 3, 4)]
    named = counts.groupBy("g").agg(*(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05)) for i in (1, 2, 3)]
    return named.select("g", *(x.alias(f"d{i}") for i, x in enumerate(d, 1)))


def fit(counts: DataFrame, scratch: Scratch, least: int = 2) -> Files:
    """Interpolated modified Kneser-Ney from a written table of ``ngram_counts``."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # of lower orders: how many symbols come before
        tables[k] = scratch.keep(tables[k + 1].groupBy("g", last_of(k).alias("code")).agg(F.count("*").alias("n")), "counts")
    lower, parts = None, []
    for k, own in tables.items():
        tables[k] = looked_up(own, scratch.keep(discounts(own), "discounts"), "g")
    for k in range(1, ORDER + 1):
        cut = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
        rows = tables[k].select("g", "code", "n", cut.alias("cut"), (F.col("n") >= (least if k == ORDER else 1)).alias("stays"), F.expr(f"shiftrightunsigned(code, {BITS})").alias("ctx"))
        free = F.sum(F.when(F.col("stays"), F.col("cut")).otherwise(F.col("n"))) / F.sum("n")
        contexts = scratch.keep(rows.groupBy("g", "ctx").agg(F.sum("n").alias("total"), free.alias("free")), "contexts")
        rows = rows.where("stays").join(contexts, ["g", "ctx"])
        if lower is None:
            below = F.lit(10**UNIFORM)
        else:
            rows, below = rows.withColumn("rest", last_of(k - 1)).join(lower.select("g", F.col("code").alias("rest"), F.col("p").alias("below")), ["g", "rest"]), F.col("below")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("free") * below
        lower = scratch.keep(rows.select("g", "code", p.alias("p")), "order")
        parts.append(lower.select("g", F.lit(k).alias("k"), "code", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("back")))
        parts.append(contexts.select("g", F.lit(k - 1).alias("k"), F.col("ctx").alias("code"), F.lit(None).cast("double").alias("logp"), F.log10("free").alias("back")))
    size = sum(x.count() for x in parts)
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return written(rows, scratch.path("model"), max(0, (size // SHARD).bit_length()))


def key_of(g: np.ndarray | int, k: np.ndarray | int, code: np.ndarray) -> np.ndarray:
    """The hash of (language, order, n-gram)."""
    lead = (np.atleast_1d(np.asarray(g, np.int64)).view(U) << U(3)) + np.asarray(k).astype(U)
    return mixed(code ^ mixed(lead))


def written(rows: DataFrame, root: str, bits: int) -> Files:
    """Write the model's entries in 2**bits files by hash range."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, k, code = (b[c].to_numpy(zero_copy_only=False) for c in ("g", "k", "code"))
            key = key_of(g, k, code.view(U))
            shard = (key >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), b["logp"], b["back"]], ["shard", "key", "logp", "back"])

    def write(name: tuple, own: pd.DataFrame) -> pd.DataFrame:
        key = own["key"].to_numpy(np.int64).view(U)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        # an n-gram that is a context, too, has one row of each kind
        logp, back = (np.fmax.reduceat(own[c].to_numpy(float)[order], first) for c in ("logp", "back"))
        put(f"{root}/{name[0]}", packed({"key": key[order][first], "logp": logp.astype(np.float32), "back": np.nan_to_num(back).astype(np.float32)}))
        return pd.DataFrame({"shard": [name[0]]})

    made = rows.mapInArrow(keyed, "shard int, key long, logp double, back double").groupBy("shard").applyInPandas(write, "shard int")
    return Files(root, bits, sorted(r.shard for r in made.collect()))


class Files:
    """The sorted hash arrays, of which ``OPEN`` files at most are held."""

    def __init__(self, root: str, bits: int, there: list[int]):
        self.root, self.bits, self.there = root, bits, frozenset(there)
        self.held: dict[int, dict[str, np.ndarray]] = {}

    def file(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.held:
            if len(self.held) >= OPEN:
                self.held.pop(next(iter(self.held)))
            self.held[i] = mapped(f"{self.root}/{i}")
        return self.held[i]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logp, back) of each key; NaN where there is no entry of the kind."""
        order = np.argsort(key)
        own = key[order]
        logp, back = np.full(len(key), np.nan), np.zeros(len(key))
        bounds = np.arange(1, 1 << self.bits).astype(U) << U(64 - self.bits) if self.bits else np.empty(0, U)
        cut = [0, *np.searchsorted(own, bounds).tolist(), len(own)]
        for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if s < e and i in self.there:
                file = self.file(i)
                at = np.minimum(np.searchsorted(file["key"], own[s:e]), len(file["key"]) - 1)
                hit = np.flatnonzero(file["key"][at] == own[s:e])
                logp[order[s + hit]], back[order[s + hit]] = file["logp"][at[hit]], file["back"][at[hit]]
        return logp, back

    def score(self, g: int, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code, in language g."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            own = codes[todo] & U((1 << BITS * k) - 1)
            logp, _ = self.find(key_of(g, k, own))
            hit = ~np.isnan(logp)
            out[todo[hit]] += logp[hit]
            todo, own = todo[~hit], own[~hit]
            out[todo] += self.find(key_of(g, k - 1, own >> U(BITS)))[1]
        out[todo] += UNIFORM
        return out


def repeat_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * len(ids) + w[2:]
    _, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = n[inverse] > 1
    if not twice.any():
        return 0
    hit = np.zeros(len(w), bool)
    for k in range(3):
        hit[k : len(w) - 2 + k] |= twice
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, MARKS)), len(lines) - len(set(lines)), repeat_words(words)


def measured(docs: DataFrame, model: Files) -> DataFrame:
    """The base counts and log10 perplexity per symbol of each whole text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, log_ppl = np.zeros((len(names), len(b)), np.int64), np.full(len(b), np.nan)
            for g, rows, texts in by_language(b):
                base[:, rows] = np.array(list(map(base_counts, texts))).T
                code, starts = coded(texts)
                kinds, back = np.unique(code, return_inverse=True)
                logp = np.zeros(len(kinds))
                there = np.flatnonzero(kinds & U(SYMBOLS - 1))
                logp[there] = model.score(g, kinds[there])
                size = np.diff(np.append(starts, len(code))) - (ORDER - 1)
                with np.errstate(invalid="ignore"):
                    log_ppl[rows] = np.round(-np.add.reduceat(logp[back], starts) / size, 6)
            cols = [*map(pa.array, base), pa.array(log_ppl, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([b["row"], b["copy"], b["doc_id"], b["lang"], *cols], ["row", "copy", "doc_id", "lang", *names, "log_ppl"])

    rows = docs.select(verdict_key().alias("row"), F.xxhash64("text").alias("copy"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), language().alias("g"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, copy long, doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", log_ppl double")


def verdict_key() -> Column:
    """Names a row by all that its verdict rests on."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("\0")), F.col("text").cast("string"))


def base_fails() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame, reach: float) -> DataFrame:
    """(lang, low, high) from an exact histogram of each language's distinct texts."""
    fits = rows.where("not base_failed and log_ppl is not null")
    texts = fits.select("lang", "copy", F.floor(F.col("log_ppl") * STEPS).alias("bin")).distinct()
    bins = texts.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    bins = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / STEPS
    q = bins.groupBy("lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01)) * reach
    return q.select(F.col("lang").alias("band_lang"), (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def judged(docs: DataFrame, reach: float = 3.0) -> DataFrame:
    """One row per text: the base counts, log_ppl, the language's band (low,
    high), base_failed and kept; row names the text, its id and language."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.keep(ngram_counts(distinct_texts(docs, scratch)), "counts"), scratch)
    rows = measured(docs, model).withColumn("base_failed", base_fails())
    rows = scratch.keep(rows, "measured")
    band = bands(rows, reach)
    out = rows.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang", "copy")
    fits = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & fits)


def kept_documents(docs: DataFrame, reach: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that pass, each judged by its own text and language."""
    name = fresh(docs, "row")
    bad = judged(docs, reach).where("not kept").select(F.col("row").alias(name)).distinct()
    bad = Scratch(docs.sparkSession, "quality").keep(bad, "rejected")
    return looked_up(docs.withColumn(name, verdict_key()), bad, name, "left_anti").select(docs.columns)
