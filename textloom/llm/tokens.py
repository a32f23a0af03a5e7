"""Token counts under a unigram model by trie-shared dynamic programming.

A text's words (pre-tokens) are segmented into the pieces of a vocabulary with
the highest total score. The forward score of a word's prefix depends on the
prefix alone, so the distinct words of a task form a trie whose nodes hold the
best score up to there and the number of pieces it takes; a node is computed
once for all words that share it, and its count is stored where a word ends.
The trie of a batch's new sorted words is built and scored level by level, all
nodes of a level at once; words of more than ``LONG`` characters walk it depth
first, where only the path to the current word is held. Tasks add up their texts
from the stored counts.

The vocabulary is given and never changed; the pieces' log probabilities are
fitted on the corpus by expectation maximisation. Its rounds need each distinct
word only once, with its count: one pass over the texts counts words, and a
round builds tries with summed forward scores of them, lets the counts flow back
from the ends of words to the root, and adds up expected uses by piece, a row
for each piece at most. Rounds start from ranks
(Zipf's law), each piece is used ``PRIOR`` times more than seen. Scores are whole
millionths, so that sums don't depend on their order. A character without a
piece falls back to its bytes, each at ``BYTE`` below the least score. Of equal
scores the fewer pieces win.

Defined cases: null and wordless texts have no tokens; words of any length are
taken whole; repeated rows each get a row, and count each in the fit; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = "▁"
#: A score of one nat.
UNIT = 1_000_000
BYTE = -10 * UNIT
ROUNDS, PRIOR = 3, 0.5
#: Texts whose new words enter the trie together.
TEXTS = 2048
#: Words whose counts a task keeps.
REMEMBER = 1_000_000
#: Words of a trie in a round of the fit.
WORDS = 1 << 15
#: Words of more characters walk the trie depth first.
LONG = 256
#: Characters of such a word whose pieces stay known for the words that follow.
SHARED = 64
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(model: str) -> dict[str, int]:
    """The ordinary pieces of a SentencePiece file with scores by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -round(UNIT * math.log(rank + 2)) for rank, i in enumerate(own)}


def byte_score(pieces: dict[str, int]) -> int:
    return min(pieces.values()) + BYTE


def common_start(a: str, b: str) -> int:
    depth, most = 0, min(len(a), len(b))
    while depth < most and a[depth] == b[depth]:
        depth += 1
    return depth


def size_in_bytes(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


def code_values(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and a hash value of each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return codes, x ^ (x >> np.uint64(29))


class Pieces:
    """The vocabulary in tables by length, looked up by the hash of characters."""

    def __init__(self, pieces: dict[str, int]):
        self.names, self.byte = list(pieces), byte_score(pieces)
        self.score = np.array(list(pieces.values()), np.int64)
        self.longest = max(map(len, self.names))
        self.tables = {}
        for size in {len(p) for p in self.names if p}:
            own = np.array([i for i, p in enumerate(self.names) if len(p) == size])
            values = code_values("".join(self.names[i] for i in own))[1].reshape(-1, size)
            key = np.zeros(len(own), np.uint64)
            for k in range(size):
                key = key * BASE + values[:, k]
            order = np.argsort(key)
            likely = np.zeros(1 << 18, bool)
            likely[(key * MIX) >> np.uint64(46)] = True
            self.tables[size] = key[order], own[order], likely

    def found(self, size: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``key``, number of the piece) of the keys that are pieces."""
        keys, own, likely = self.tables[size]
        at = np.flatnonzero(likely[(key * MIX) >> np.uint64(46)])
        k = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
        ok = keys[k] == key[at]
        return at[ok], own[k[ok]]


class Level:
    """The trie's nodes of one depth: their parents in the level before, hashes
    of their prefixes, bytes of their last characters, and the words that end."""

    def __init__(self, parent, key, size, ends, end_node):
        self.parent, self.key, self.size, self.ends, self.end_node = parent, key, size, ends, end_node


def trie(words: list[str]) -> Iterator[Level]:
    """The levels of the trie of sorted distinct words, from depth 1."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length) - length
    codes, values = code_values("".join(words))
    own, node, key, depth = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(1, np.uint64), 0
    while True:
        left = length[own] > depth
        own, node = own[left], node[left]
        if not len(own):
            return
        at = first[own] + depth
        depth += 1
        new = np.concatenate([[True], (np.diff(node) != 0) | (np.diff(codes[at].astype(np.int64)) != 0)])
        parent, c = node[new], codes[at[new]]
        key = key[parent] * BASE + values[at[new]]
        node = np.cumsum(new) - 1
        done = length[own] == depth
        yield Level(parent, key, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64), own[done], node[done])


def edges(levels: list[Level], own: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, nodes of the last level, nodes where the piece begins, piece)
    for the pieces that end in the last of ``levels``, which starts at the root."""
    last, power = levels[-1], np.ones(1, np.uint64)
    begin = np.arange(len(last.key))
    for size in range(1, min(own.longest, len(levels) - 1) + 1):
        begin, power = levels[-size].parent[begin], power * BASE
        if size in own.tables:
            at, piece = own.found(size, last.key - levels[-size - 1].key[begin] * power)
            if len(at):
                yield size, at, begin[at], piece


ROOT = Level(None, np.zeros(1, np.uint64), None, None, None)


def counts_by_level(words: list[str], own: Pieces) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    levels, score, count = [ROOT], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for level in trie(words):
        levels.append(level)
        best, n = score[-1][level.parent] + level.size * own.byte, count[-1][level.parent] + level.size
        for size, at, begin, piece in edges(levels, own):
            x, k = score[-size][begin] + own.score[piece], count[-size][begin] + 1
            ok = (x > best[at]) | ((x == best[at]) & (k < n[at]))
            if size == 1:  # a character with a piece doesn't fall back
                ok[:] = True
            best[at[ok]], n[at[ok]] = x[ok], k[ok]
        score.append(best)
        count.append(n)
        out[level.ends] = n[level.end_node]
        if len(levels) > own.longest + 1:
            del levels[0], score[0], count[0]
    return out


def uses_by_level(words: list[str], counts: np.ndarray, own: Pieces) -> np.ndarray:
    log_p, byte = own.score / UNIT, own.byte / UNIT
    levels, forward, ways, passing = [ROOT], [np.zeros(1)], [None], [np.zeros(1)]
    for level in trie(words):
        levels.append(level)
        total = forward[-1][level.parent] + level.size * byte
        found = list(edges(levels[-own.longest - 1 :], own))
        bytes_at = np.ones(len(total), bool)
        for size, at, begin, piece in found:
            x = forward[-size][begin] + log_p[piece]
            total[at] = x if size == 1 else np.logaddexp(total[at], x)
            if size == 1:
                bytes_at[at] = False
        ends = np.zeros(len(total))
        ends[level.end_node] = counts[level.ends]
        forward.append(total)
        ways.append((found, np.flatnonzero(bytes_at)))
        passing.append(ends)
    uses = np.zeros(len(own.names))
    for d in range(len(levels) - 1, 0, -1):
        found, at = ways[d]
        begin = levels[d].parent[at]
        for size, at, begin, piece in [(1, at, begin, None), *found]:
            x = levels[d].size[at] * byte if piece is None else log_p[piece]
            part = passing[d][at] * np.exp(forward[d - size][begin] + x - forward[d][at])
            passing[d - size] += np.bincount(begin, part, len(passing[d - size]))
            if piece is not None:
                uses += np.bincount(piece, part, len(uses))
    return uses


def terminal_counts(words: list[str], pieces: dict[str, int], own: Pieces) -> list[int]:
    """The number of pieces of each word; ``words`` is sorted and distinct."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
    if not len(long):
        return counts_by_level(words, own).tolist() if words else []
    found = np.zeros(len(words), np.int64)
    found[long] = walked_counts([words[i] for i in long], pieces, own.longest)
    if len(short):
        found[short] = counts_by_level([words[i] for i in short], own)
    return found.tolist()


def expected_uses(words: list[str], counts: list[int], pieces: dict[str, int], own: Pieces) -> dict[str, float]:
    """How often each piece is used in all segmentations of the words, weighted
    by their probability; ``words`` is sorted and distinct."""
    size, counts = np.fromiter(map(len, words), np.int64, len(words)), np.asarray(counts, float)
    short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
    uses = walked_uses([words[i] for i in long], counts[long].tolist(), pieces, own.longest) if len(long) else {}
    if len(short):
        total = uses_by_level([words[i] for i in short] if len(long) else words, counts[short], own)
        for i in np.flatnonzero(total).tolist():
            uses[own.names[i]] = uses.get(own.names[i], 0.0) + float(total[i])
    return uses


def walked_counts(words: list[str], pieces: dict[str, int], longest: int) -> list[int]:
    """``terminal_counts`` depth first."""
    score, count, out, last, byte = [0], [0], [], "", byte_score(pieces)
    for word in words:
        depth = common_start(last, word)
        del score[depth + 1 :], count[depth + 1 :]
        for d in range(depth + 1, len(word) + 1):
            one = word[d - 1]
            if one in pieces:
                best, n = -math.inf, 0
            else:
                size = size_in_bytes(one)
                best, n = score[d - 1] + size * byte, count[d - 1] + size
            for s in range(max(0, d - longest), d):
                if (own := pieces.get(word[s:d])) is not None:
                    own += score[s]
                    if own > best or own == best and count[s] + 1 < n:
                        best, n = own, count[s] + 1
            score.append(best)
            count.append(n)
        out.append(count[-1])
        last = word
    return out


def walked_uses(words: list[str], counts: list[int], pieces: dict[str, int], longest: int) -> dict[str, float]:
    """``expected_uses`` depth first."""
    log_p, byte = {p: x / UNIT for p, x in pieces.items()}, byte_score(pieces) / UNIT

    def ending(word: str, d: int) -> list[tuple[int, float, str | None]]:
        own = [(s, x, word[s:d]) for s in range(max(0, d - longest), d) if (x := log_p.get(word[s:d])) is not None]
        return own if word[d - 1] in log_p else [*own, (d - 1, size_in_bytes(word[d - 1]) * byte, None)]

    uses: dict[str, float] = defaultdict(float)
    forward, known, last = [0.0], [[]], ""  # known: what ends at the first places
    for word, n in zip(words, counts, strict=True):
        depth = common_start(last, word)
        del forward[depth + 1 :], known[depth + 1 :]
        for d in range(depth + 1, len(word) + 1):
            own = ending(word, d)
            parts = [forward[s] + x for s, x, _ in own]
            top = max(parts)
            forward.append(top + math.log(sum(math.exp(p - top) for p in parts)))
            if d <= SHARED:
                known.append(own)
        # the words that pass a place, from the end to the start
        passing = [0.0] * len(word) + [float(n)]
        for d in range(len(word), 0, -1):
            if here := passing[d]:
                for s, x, piece in known[d] if d <= SHARED else ending(word, d):
                    part = here * math.exp(forward[s] + x - forward[d])
                    passing[s] += part
                    if piece is not None:
                        uses[piece] += part
        last = word
    return uses


def texts_of(words: list[bytes]) -> list[str]:
    """The words as characters with the mark of a space before each. A word has
    no white space, so all are read in one go; the order of bytes is kept."""
    if not words:
        return []
    return (SPACE + b"\n".join(words).decode("utf-8", "surrogatepass").replace("\n", "\n" + SPACE)).split("\n")


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin (one place more than texts) and the words of
    all, between ASCII white space; empty ones stand at such space's outside."""
    parts = pc.ascii_split_whitespace(texts)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(parts), 0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), pc.list_flatten(parts).cast(pa.binary())


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = pc.value_counts(split(b["text"])[1])
            own = pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "n"])
            yield own.filter(pc.greater(pc.binary_length(own["word"]), 0))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fitted(words: DataFrame, pieces: dict[str, int], rounds: int = ROUNDS) -> dict[str, int]:
    """The pieces' scores after some rounds over a written table of ``words``."""
    for _ in range(rounds):
        now = pieces

        def run(batches: Iterator[pa.RecordBatch], now: dict[str, int] = now) -> Iterator[pa.RecordBatch]:
            own = Pieces(now)
            rows = (r for b in batches for r in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True))
            while some := sorted(islice(rows, WORDS)):
                words, counts = zip(*some, strict=True)
                uses = expected_uses(texts_of(words), counts, now, own)
                yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.float64())], ["piece", "uses"])

        sums = words.mapInArrow(run, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = {r.piece: r.uses for r in sums.collect()}  # pieces of the vocabulary only
        total = math.log(sum(uses.values()) + PRIOR * len(pieces))
        pieces = {p: round(UNIT * (math.log(uses.get(p, 0.0) + PRIOR) - total)) for p in pieces}
    return pieces


def counted(docs: DataFrame, model: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of each whole text."""
    scratch = Scratch(docs.sparkSession, "tokens")
    words = scratch.keep(distinct_words(docs).repartitionByRange("word").sortWithinPartitions("word"), "words")
    pieces = fitted(words, vocabulary(model), rounds)
    scratch.drop(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        own_pieces = Pieces(pieces)
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            first, words = split(b["text"])
            encoded = words.dictionary_encode()
            own = encoded.dictionary.to_pylist()
            if len(known) > REMEMBER:
                known.clear()
            known[b""] = 0
            new = sorted(set(own).difference(known))
            known.update(zip(new, terminal_counts(texts_of(new), pieces, own_pieces), strict=True))
            counts = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            real = np.fromiter(map(len, own), np.int64, len(own)) > 0
            at = np.asarray(encoded.indices)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[first]) for x in (real, counts)]
            size = pc.fill_null(pc.binary_length(b["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, sums), size], ["doc_id", "n_words", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
