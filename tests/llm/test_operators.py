"""The numbered operators against brute force on small fixtures."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import decontam, lines, lmscore, neardup, packing, quality, queries, sharding, suffixes, tokens, warc
from textloom.llm.common import Scratch, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row long"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randint(0, vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, odd texts, clashing columns."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(5, 120)) for _ in range(40)]
    texts = list(base) + base[:6] + [b.replace(" w1", " x1", 1) for b in base[6:12]]
    passage = words(rng, 30)
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}\nsame line of boilerplate {i}" for i in range(12)]
    texts += [None, "", " \n\t", "a", "é" * 60, "é" * 60, "ab" * 400, "\x00 odd � 𝄞", base[0] + " tail", words(rng, 3000, 5000)]
    rows = [(i, t, [None, "en", "de"][i % 3], "s", 0, "f", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[1], "en", "s", 0, "f", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- components ---------------------------------------------------------------


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 5), (9, 9), *((i, i + 1) for i in range(100, 160)), *((500, 501 + i) for i in range(50))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == 4 and got[160] == 100 and got[550] == 500
    assert len(got) == 3 + 2 + 61 + 51


# --- 9 ------------------------------------------------------------------------


def brute_fingerprint(text, width):
    ws = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    runs = [b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    ids = sorted(prints, key=lambda x: (x is None, x))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t, 4) for i, t in rows if i is not None}
    want = brute_components(prints, 4)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == want[1]


def test_simhash_links_planted_bits(spark):
    """All distances up to the radius are linked, larger ones are not."""
    rng = random.Random(3)
    fps = []
    for k in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), k % 7):
            b ^= 1 << bit
        fps += [a, b]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    met = neardup.met_on_projections(df, 4)
    links = {frozenset((r.a, r.b)) for p in range(3) for r in neardup.ball_links(met, 4, p, 3).collect()}
    want = {frozenset(map(signed, (a, b))) for i, a in enumerate(set(fps)) for b in list(set(fps))[:i] if (a ^ b).bit_count() <= 4}
    got = components(df.sparkSession.createDataFrame([tuple(x) for x in links], "a long, b long"), Scratch(spark, "t")).collect()
    group = {r.node: r.root for r in got}
    assert links <= want
    assert all(group[a] == group[b] for a, b in map(tuple, want))


def test_one_of_each(docs, rows):
    kept = {r.doc_id for r in neardup.one_of_each(docs, width=5).collect()}
    assert 0 in kept and not kept & set(range(40, 46)) and None in kept


def test_one_of_each_at_the_rule(spark):
    """Copies at a five-word similarity of 0.8 to 0.9 go, those below it stay."""
    rng, texts, copies, want = random.Random(11), [], [], set()
    for i in range(60):
        own = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
        texts.append(" ".join(own))
        n = 2 + i % 3 if i < 45 else 7
        for k in range(n):
            own[15 + 25 * k] += "x"
        copies.append(" ".join(own))
        a, b = (set(zip(*(t.split()[j:] for j in range(5)))) for t in (texts[-1], copies[-1]))
        near = len(a & b) / len(a | b)
        assert 0.8 <= near < 0.91 if i < 45 else near < 0.75
        want |= {i} if near >= 0.8 else {i, 1000 + i}
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(copies)], "doc_id long, text string")
    assert {r.doc_id for r in neardup.one_of_each(df, width=5).collect()} == want


# --- 1 ------------------------------------------------------------------------


def tokenizer():
    return queries.tokenizer("word_bpe_49k.json")


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    capacity = 64
    got = packing.packed(docs, tokenizer(), capacity, with_ids=True, rounds=10).collect()
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    want = Counter((i, k // (4 * capacity), ids(t)[k : k + 4 * capacity]) for i, t in rows for k in range(0, len(ids(t)), 4 * capacity))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    places = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) and r.start == r.piece * capacity
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= math.ceil(sum(r.length for r in got) / capacity) * 1.02 + 2


@pytest.mark.parametrize("n", [1, 30, 4000])
def test_plan_is_near_its_bound(n):
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.clip(rng.lognormal(5, 1, n).astype(int), 1, 1024), return_counts=True)
    configs, bound = packing.plan(lengths, counts, 1024, rounds=20)
    used = np.zeros(len(lengths), int)
    for config, uses in configs:
        assert sum(lengths[i] * k for i, k in config.items()) <= 1024
        for i, k in config.items():
            used[i] += k * uses
    assert (used == counts).all()
    assert bound <= sum(u for _, u in configs) <= bound * 1.02 + 1


def test_packing_hard_sizes():
    """Sizes that only fit in one combination."""
    configs, bound = packing.plan(np.array([26, 37, 37 + 26]), np.array([20, 20, 0 + 1]), 100, rounds=30)
    assert sum(u for _, u in configs) <= bound + 3


# --- 2 ------------------------------------------------------------------------


def brute_leaks(text, item, width, least):
    """On strings, sharing nothing with the operator."""
    split = lambda t: (t or "").encode().lower().split()
    grams = lambda ws, w: [tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)]
    a, b = split(text), split(item)
    if not b:
        return False
    w = min(width, len(b))
    target, own = Counter(grams(b, w)), grams(a, w)
    m = len(b) - w + 1
    for i in range(max(1, len(own) - m + 1)):
        window = Counter(own[i : i + m])
        both = (window & target).total()
        if both and both / (window | target).total() >= least:
            return True
    return False


def test_decontamination_recall(spark):
    """Leaks just at the threshold are met through the index alone."""
    rng = random.Random(31)
    items = [(i, words(rng, rng.choice([40, 60, 90]), 5000)) for i in range(40)]
    docs = []
    for _, item in items:
        for share in (0.0, 0.1):
            ws = item.split()
            for p in range(2, int(len(ws) * share * 0.22) + 2 if share else 2):
                ws[p * len(ws) // 12] = "edited"
            docs.append(f"{words(rng, 30, 5000)} {' '.join(ws)} {words(rng, 25, 5000)}")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, k) for r in decontam.flagged(d, b).collect() for k in r.item_ids}
    want = {(i, k) for i, t in enumerate(docs) for k, item in items if brute_leaks(t, item, 5, 0.8)}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 60


def test_multi_index_is_complete_within_its_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, 300, np.uint64)
    asked = prints[rng.integers(0, 300, 400)].copy()
    for i in range(400):
        for bit in rng.choice(64, i % 26, replace=False):
            asked[i] ^= np.uint64(1 << int(bit))
    index = decontam.Multi(list(range(1000, 1300)), prints)
    got = set(zip(*(x.tolist() for x in index.near(asked)), strict=True))
    assert got == {(i, 1000 + j) for i in range(400) for j in range(300) if (int(asked[i]) ^ int(prints[j])).bit_count() <= decontam.RADIUS}


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate((3, 8, 20, 40, 60))] + [(9, ""), (10, None)]
    docs = []
    for _, item in items[:5]:
        for edits in (0, 1, 3, 8):
            ws = item.split()
            for p in rng.sample(range(len(ws)), min(edits, len(ws))):
                ws[p] = "edited"
            docs.append(f"{words(rng, 30)} {' '.join(ws).upper() if edits == 1 else ' '.join(ws)} {words(rng, 25)}")
        docs.append(" ".join(item.split()[:-1]))
    docs += [None, "", words(rng, 200)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_items": 2}):
        got = {r.doc_id: r.item_ids for r in decontam.flagged(d, b, **options).collect()}
        want = {i: [k for k, item in items if brute_leaks(t, item, 5, 0.8)] for i, t in enumerate(docs)}
        assert got == want and any(want.values())
    clean = {r.doc_id for r in decontam.clean_documents(d, b).collect()}
    assert clean == {i for i, x in want.items() if not x}
    assert decontam.flagged(d, b.limit(0)).where("contaminated").count() == 0


def test_word_hashes_follow_the_words():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abAB é\x00\t\n\x1f") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data, begin = decontam.joined(texts)
    got, start, _ = decontam.word_hashes(data, decontam.Powers())
    words_ = [w for t in texts for w in t.encode().lower().split()]
    seen = {}
    for w, h in zip(words_, got.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and len(begin) == 300 and len(start) == len(words_)


# --- 3 ------------------------------------------------------------------------


def brute_repeats(rows, depth):
    by_doc, seen = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            if seen.setdefault(data[s : s + depth], i) < i:
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        by_doc[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return by_doc


@pytest.mark.parametrize(("depth", "k"), [(50, 20), (24, 8)])
def test_suffix_sort(docs, rows, depth, k, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    want = brute_repeats(rows, depth)
    for r in suffixes.without_repeats(docs, depth, k).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffix_sort_keeps_finished_digits_from_the_disk(docs, rows, monkeypatch):
    runs, written = [], []
    make, keep = suffixes.Scratch.__init__, suffixes.Scratch.keep
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    monkeypatch.setattr(suffixes, "SCANS", 2)
    monkeypatch.setattr(suffixes, "PARTS", 2)
    monkeypatch.setattr(suffixes.Scratch, "__init__", lambda self, *a: (make(self, *a), runs.append(self))[0])
    monkeypatch.setattr(suffixes.Scratch, "keep", lambda self, df, name: (written.append(name), keep(self, df, name))[1])
    found = {r.doc_id: r.n_removed for r in suffixes.without_repeats(docs).collect() if r.doc_id is not None}
    assert found == {i: r[1] for i, r in brute_repeats(rows, 50).items()}
    assert written.count("marks") == 2  # no shuffle holds all windows
    left = os.listdir(runs[0].root.removeprefix("file://"))
    assert sorted(name.split("-", 1)[1] for name in left) == ["copies", "repeats"]


def test_suffix_sort_of_near_copies_stays_small_on_disk(spark, monkeypatch):
    """Where nearly all is shared, neither contexts nor windows pile up."""
    rng, largest = random.Random(5), [0]
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=12_000)) for _ in range(12)]
    rows = [(1, base[0][:300]), (1, base[1][:90])]  # two rows of one document
    for i in range(60):
        t = list(base[i % 12])
        for at in rng.sample(range(len(t)), 20):
            t[at] = "#"
        rows.append((i + 2, "".join(t)))
    keep = suffixes.Scratch.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        at = Path(self.root.removeprefix("file://"))
        largest[0] = max(largest[0], sum(f.stat().st_size for f in at.rglob("*.parquet")))
        return out

    monkeypatch.setattr(suffixes.Scratch, "keep", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows, 50)
    for r in suffixes.without_repeats(docs).collect():
        assert r.doc_id == 1 or (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    size = sum(len(t) for _, t in rows)
    assert largest[0] < 1.5 * size, largest[0] / size


# --- 4 ------------------------------------------------------------------------


def brute_base(text):
    ws = (text or "").encode().split()
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    own = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(hit)


def test_quality(docs, rows):
    got = quality.judged(docs).collect()
    want = Counter((i, *brute_base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)


def brute_kneser_ney(texts, least):
    """A function (context, symbol) -> probability, from strings and dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        padded = (None, None, None, *t)
        counts[4].update(tuple(padded[i : i + 4]) for i in range(len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, follow = {}, defaultdict(Counter)
    for k, own in counts.items():
        n = [max(1, sum(c == i for c in own.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        for g, c in own.items():
            follow[k, g[:-1]][g[-1]] = c

    def p(context, x):
        k = len(context) + 1
        below = p(context[1:], x) if k > 1 else 1 / 65535
        if not (own := follow.get((k, context))):
            return below
        cut = {s: cuts[k][min(c, 3) - 1] if k < 4 or c >= least else c for s, c in own.items()}
        total = sum(own.values())
        return (own[x] - cut.get(x, 0)) / total + sum(cut.values()) / total * below

    return p


def test_quality_model_against_brute_force(spark, monkeypatch):
    """Perplexity, band and verdict of each text, in several files of the model."""
    monkeypatch.setattr(quality, "SHARD", 2000)
    rng = random.Random(8)
    scripts = {"en": "abcdeé", "el": "αβγδε", "zh": "\u4e00\u4e8c\u4e09\u56db", None: "xyz\U0001d11e"}
    prose = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(55, 70)))
    given = [(lang, prose(s)) for lang, s in scripts.items() for _ in range(12)] + [("en", ""), ("el", None), ("zh", prose("\u4e00\u5341\u767e\u5343\u842c\u5104")), ("xx", "b")]
    given += [("en", "\n ".join(prose("abcde").split(" ")) + " &&& ||  ?!!\ta")]
    given += [("el", " ".join("".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(9)) for _ in range(60)))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(given)
    fold = lambda t: re.sub(r"([ &|?!])\1+", r"\1", re.sub(r"\s", " ", (t or "").replace("\U0001d11e", "\ue1d1")))
    want = {}
    for lang in {x for x, _ in given}:
        p = brute_kneser_ney([fold(t) for x, t in given if x == lang], 2)
        for i, (x, t) in enumerate(given):
            if x == lang and t:
                s = (None, None, None, *fold(t))
                want[i] = -sum(math.log10(p(s[j - 3 : j], s[j])) for j in range(3, len(s))) / (len(s) - 3)
        good = sorted(math.floor(got[i].log_ppl * 1000) for i, (x, t) in enumerate(given) if x == lang and t and not got[i].base_failed)
        if good:
            q1, q3 = (good[math.ceil(q * len(good)) - 1] / 1000 for q in (0.25, 0.75))
            wide = 3 * max(q3 - q1, 0.01)
            for i, (x, _) in enumerate(given):
                if x == lang:
                    assert got[i].kept == (not got[i].base_failed and i in want and q1 - wide <= got[i].log_ppl <= q3 + wide)
    for i, r in got.items():
        assert (r.log_ppl is None) == (i not in want)
        assert r.log_ppl is None or abs(r.log_ppl - want[i]) < 1e-4, (i, r.log_ppl, want[i])
    assert not got[len(given) - 1].kept and got[len(given) - 1].log_ppl > got[len(given) - 1].high  # Greek letters at random


def test_quality_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice(["an", "th", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200))) for _ in range(200)]
    junk = ["".join(chr(rng.randint(33, 126)) + (" " if i % 6 == 5 else "") for i in range(600)) for _ in range(4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.kept_documents(df).collect()}
    assert not kept & set(range(200, 204)) and len(kept) >= 196


# --- 5 ------------------------------------------------------------------------


def test_line_templates(spark):
    rng = random.Random(4)
    prose = lambda rng, n: words(rng, n).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  no variable fields
    texts = [f"{prose(rng, 12)}\nPage 7 of 1{i} printed\n\n{prose(rng, 9)}" for i in range(15)]
    texts += [f"{prose(random.Random(99), 30)}\nbody line of the copied text"] * 20
    texts += [f"{prose(rng, 8)}\nrare line here"] * 1 + [None, "", "\n"]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, pos int, row string")
    got = {r.doc_id: r for r in lines.without_recurring_lines(df).collect()}
    assert len(got) == len(texts)
    for i in range(15):
        assert "printed" not in got[i].text and got[i].n_dropped == 1 and got[i].n_lines == 3
        assert got[i].text == "\n".join(x for x in texts[i].split("\n") if "printed" not in x)
    for i in range(15, len(texts)):
        assert got[i].text == texts[i] and got[i].n_dropped == 0 and got[i].pos == 0


def test_long_lines_recur(spark):
    """The longest line of all its documents, long ones in few documents, and
    what stands beside them; the body of an edited copy stays."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    notice, passage, source, body = prose(40), prose(60), "read more of this on our pages", [prose(70), prose(60), prose(55)]
    texts = [f"{prose(20)}\n{notice}\n{source}" for _ in range(12)]
    texts += [f"{prose(80)}\n{prose(70)}\n{passage}" for _ in range(2)]
    texts += ["\n".join(body), "\n".join([body[0] + " more", *body[1:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(df).collect()}
    assert got == {i: 2 if i < 12 else 1 if i < 14 else 0 for i in range(16)}


def test_lines_of_one_code_stay_apart(spark):
    """Words whose two-byte codes are the same are different lines."""
    own = [str(n).translate(str.maketrans("0123456789", "abcdefghij")) for n in range(100_000)]
    codes = lines.coded(["\n".join(own).encode()], lines.Powers())["codes"]
    seen = {}
    for word, code in zip(own, codes.tolist(), strict=True):
        if (other := seen.setdefault(code, word)) != word:
            break
    df = spark.createDataFrame([(0, other), (1, word)], "doc_id long, text string")
    got = lines.parsed(df).collect()
    assert len({r.fields for r in got}) == 1 and len({r.line for r in got}) == len({r.leaf for r in got}) == 2


def test_parsed_lines_against_plain_loops(spark, monkeypatch):
    """Places, counts, masks and equality of lines, also of texts in pieces."""
    monkeypatch.setattr(lines, "CHUNK", 40)
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a", "b", "7", " ", " ", "\n", "é", "\t", "\r", "\x1f"]) for _ in range(rng.randint(0, 150))) for _ in range(80)] + [None, "", "\n\n", "a" * 200]
    want, names, leaves = {}, {}, {}
    for i, t in enumerate(texts):
        met = set()
        for pos, line in enumerate((t or "").encode().split(b"\n")):
            if own := tuple(b"0" if any(48 <= x <= 57 for x in w) else w for w in line.split()):
                want[i, pos] = (len(own), own, own not in met)
                met.add(own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lines.parsed(df).collect()
    ids = {r.k: r.doc_id for r in df.withColumn("k", lines.row_key()).collect()}
    assert len(rows) == len(want)
    for r in rows:
        tokens, own, lead = want[ids[r.row], r.pos]
        assert (r.tokens, r.lead, len(r.fields)) == (tokens, lead, 2 * tokens)
        assert [r.fields[2 * k : 2 * k + 2] == b"\xff\xff" for k in range(tokens)] == [w == b"0" for w in own]
        assert names.setdefault(own, r.line) == r.line and leaves.setdefault((tokens, own[:2]), r.leaf) == r.leaf
    assert len(set(names.values())) == len(names) and len(set(leaves.values())) == len(leaves)


def test_many_templates_in_a_leaf(spark):
    """Families of lines with a word for a field, and loners, in one leaf."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    prose = lambda n: " ".join(word() for _ in range(n))
    forms = ["we thank our reader {} for this kind letter", "we thank every friend who gave to {} today"]
    texts = [f"{prose(15)}\n{forms[i % 2].format(word())}" for i in range(30)]
    texts += [f"{prose(15)}\nwe thank {prose(7)}\nwe thank {prose(7)}" for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(df).collect()}
    assert got == {i: int(i < 30) for i in range(60)}


def test_two_families_with_the_same_lead(spark):
    """Names for fields, and two templates under one leaf."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = [f"{name()} {name()} {name()} {name()}\nUser name {name()} has logged into the portal now\nUser name {name()} was banned by an admin today" for _ in range(12)]
    df = spark.createDataFrame([(i, t, i, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, row__ int, places string, row int")
    out = lines.without_recurring_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].text == t.split("\n")[0] and (got[i].n_lines, got[i].n_dropped, got[i].row__, got[i].places) == (3, 2, i, "x")


def brute_templates(counts, alike, name):
    """The tree on strings: {masked line: template}, by turns over all leaves."""
    rank = lambda line: (counts[line], -name[line])
    leaf = lambda line: (len(line), *line[:2])
    pool, heads, made = set(counts), set(), {}
    while True:
        buckets, mine = {}, {}
        for x in pool:
            sets = lines.agreeing(len(x), alike)
            mine[x] = [(leaf(x), i, *(x[s.start // 2 : s.stop // 2] for s in own)) for i, own in enumerate(sets)]
            for k in mine[x]:
                buckets.setdefault(k, []).append(x)
        found = {}
        for x in pool - heads:
            for k in mine[x]:
                for side in (heads, pool - heads):
                    own = [y for y in buckets[k] if y in side]
                    if own and (best := max(own, key=rank)) != x:
                        same = sum(a == b for a, b in zip(x, best))
                        if same >= alike * len(x) - 1e-9:
                            found.setdefault(x, {})[best] = same
        joined = {x: max(ok, key=lambda y: (ok[y], rank(y))) for x, near in found.items() if (ok := {y: s for y, s in near.items() if y not in found})}
        if not joined:
            return made | {t: t for t in made.values()}
        made |= joined
        pool -= set(joined)
        heads |= set(joined.values())


def test_template_tree_against_brute_force(spark):
    rng = random.Random(21)
    forms = [[rng.choice("abcdefgh") * 3 for _ in range(rng.randint(4, 14))] for _ in range(6)]
    texts, counts = [], Counter()
    for _ in range(60):
        own = set()
        for _ in range(4):
            line = list(rng.choice(forms))
            for p in rng.sample(range(len(line)), rng.randint(0, len(line) // 2)):
                line[p] = rng.choice("pqrstuvw")
            own.add(tuple(line))
        counts.update(own)
        texts.append("\n".join(" ".join(x) for x in own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    parsed = scratch.keep(lines.parsed(df), "lines")
    n = parsed.where("lead").groupBy("line").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"))
    got = {r.line: r.template for r in lines.templates(lines.crowded(parsed, n, scratch, 1), scratch, 0.7).collect()}
    hashes = lines.coded(["\n".join(map(" ".join, counts)).encode()], lines.Powers())["line"].view(np.int64).tolist()
    name = dict(zip(counts, hashes, strict=True))
    want = brute_templates(counts, 0.7, name)
    assert got == {name[a]: name[b] for a, b in want.items()} and len(set(want.values())) > 6


def test_one_set_of_places_agrees_in_alike_lines():
    rng = random.Random(3)
    for tokens in range(1, 90):
        sets, lead = lines.agreeing(tokens, 0.7), lines.DEPTH + tokens // lines.DEEPER
        assert len(sets) <= max(lines.KEYS, int(0.3 * tokens + 1e-9) + 1)
        for _ in range(40):
            differ = {2 * p for p in rng.sample(range(lead, tokens), min(int(0.3 * tokens + 1e-9), max(0, tokens - lead)))} if tokens > lead else set()
            assert any(not differ & {p for s in own for p in range(s.start, s.stop, 2)} for own in sets)


def test_no_line_alike_another_is_lost(spark):
    """All pairs of a leaf: up to seven tokens every line that is alike another
    has a template, of longer ones nine in ten; joined lines are alike."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    forms = [["we", "say", *[word(3) for _ in range(rng.randint(2, 16))]] for _ in range(25)]
    texts, counts = [], Counter()
    for _ in range(150):
        own = set()
        for _ in range(5):
            line = list(rng.choice(forms))
            for p in rng.sample(range(2, len(line)), rng.randint(0, (len(line) - 2) // 2)):
                line[p] = rng.choice(["x", "y", word(6)])
            own.add(tuple(line))
        counts.update(own)
        texts.append("\n".join(" ".join(x) for x in own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    parsed = scratch.keep(lines.parsed(df), "lines")
    n = parsed.where("lead").groupBy("line").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"))
    got = {r.line: r.template for r in lines.templates(lines.crowded(parsed, n, scratch, 1), scratch, 0.7).collect()}
    hashes = lines.coded(["\n".join(map(" ".join, counts)).encode()], lines.Powers())["line"].view(np.int64).tolist()
    line = dict(zip(hashes, counts, strict=True))
    near = lambda a, b: len(a) == len(b) and a[:2] == b[:2] and sum(x == y for x, y in zip(a, b)) >= 0.7 * len(a) - 1e-9
    assert all(near(line[a], line[b]) and counts[line[b]] >= counts[line[a]] for a, b in got.items())
    paired = {h for h, a in line.items() if any(a != b and near(a, b) for b in counts)}
    short = {h for h in paired if len(line[h]) <= 7}
    # a line whose every alike line went to other templates is a template of its own
    alone = {h for h in paired - got.keys() if not any(near(line[h], line[t]) for t in set(got.values()))}
    assert len(short) > 40 and short <= got.keys() | alone and len(paired - got.keys() - alone) <= 0.1 * len(paired)


def test_a_commoner_line_does_not_hide_a_template(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    prose = lambda: " ".join(word() for _ in range(12))
    texts = [f"{prose()}\nplease read the {word()}\n{prose()}" for _ in range(30)] + [f"{prose()}\nplease read our terms\n{prose()}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_dropped for r in lines.without_recurring_lines(df).collect()} == {1}


def test_joins_are_alike_beyond_the_bound(spark):
    from textloom.llm.common import looked_up

    left = spark.range(300).selectExpr("id", "if(id % 3 = 0, id, 7) AS k", "id AS salt")
    right = spark.createDataFrame([(7, "a"), (9, "b"), (1000, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = (Counter(tuple(r.asDict().items()) for r in looked_up(left, right, "k", how, few=few).collect()) for few in (10, 0))
        assert got == want


# --- 6 ------------------------------------------------------------------------


def segmentations(word, pieces):
    """All ways to write a word: (score, pieces used, how many)."""
    if not word:
        return [(0, [], 0)]
    heads = [(pieces[word[:k]], [word[:k]], 1, k) for k in range(1, len(word) + 1) if word[:k] in pieces]
    if word[0] not in pieces:
        n = len(word[0].encode())
        heads.append((n * (min(pieces.values()) + tokens.BYTE), [], n, 1))
    return [(x + y, own + more, n + m) for x, own, n, k in heads for y, more, m in segmentations(word[k:], pieces)]


def brute_count(word, pieces):
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        found = []
        for s in range(d):
            if word[s:d] in pieces:
                found.append((best[s][0] + pieces[word[s:d]], -(best[s][1] + 1)))
        if word[d - 1] not in pieces:
            n = len(word[d - 1].encode())
            found.append((best[d - 1][0] + n * (min(pieces.values()) + tokens.BYTE), -(best[d - 1][1] + n)))
        score, n = max(found)
        best.append((score, -n))
    return best[-1][1]


@pytest.mark.parametrize("rounds,shared,long", [(0, 64, 3), (1, 64, 256), (3, 2, 4)])
def test_unigram_scores_against_all_segmentations(spark, rounds, shared, long, monkeypatch):
    rng = random.Random(rounds)
    monkeypatch.setattr(tokens, "SHARED", shared)
    monkeypatch.setattr(tokens, "LONG", long)
    pieces = {p: -tokens.UNIT * (i + 1) // 3 for i, p in enumerate([tokens.SPACE, "a", "b", "ab", "ba", tokens.SPACE + "a", "aba", "bb", "never"])}
    counts = Counter("".join(rng.choice("aabbé") for _ in range(rng.randint(1, 7))) for _ in range(150))
    rows = [(w.encode(), n) for w, n in counts.items()]
    got = tokens.fitted(spark.createDataFrame(rows, "word binary, n long").repartition(3), pieces, rounds)
    for _ in range(rounds):
        uses = Counter()
        for w, n in counts.items():
            ways = segmentations(tokens.SPACE + w, pieces)
            share = [math.exp(x / tokens.UNIT) for x, _, _ in ways]
            for p, (_, own, _) in zip(share, ways, strict=True):
                for piece in own:
                    uses[piece] += n * p / sum(share)
        total = sum(uses.values()) + tokens.PRIOR * len(pieces)
        pieces = {p: tokens.UNIT * math.log((uses[p] + tokens.PRIOR) / total) for p in pieces}
    assert got.keys() == pieces.keys() and all(abs(got[p] - x) < 9 for p, x in pieces.items())
    if rounds:
        assert sum(math.exp(x / tokens.UNIT) for x in got.values()) == pytest.approx(1, abs=1e-5)
    words = sorted(tokens.SPACE + w for w in counts)
    best = [min((-x, n) for x, _, n in segmentations(w, got))[1] for w in words]
    assert tokens.terminal_counts(words, got, tokens.Pieces(got)) == best


def test_token_counts(docs, rows, monkeypatch):
    path = queries.tokenizer("piece_bpe_32k.model")
    count = lambda t: [w.decode() for w in (t or "").encode().split()]
    words = Counter(w for _, t in rows for w in count(t))
    assert {(bytes(r.word).decode(), r.n) for r in tokens.distinct_words(docs).collect()} == set(words.items())
    pieces = tokens.fitted(tokens.distinct_words(docs), tokens.vocabulary(path))
    monkeypatch.setattr(tokens, "TEXTS", 9)
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in tokens.counted(docs, path).collect())
    assert got == Counter((i, len(count(t)), sum(brute_count(tokens.SPACE + w, pieces) for w in count(t))) for i, t in rows)


def test_a_word_of_a_megabyte_is_counted_whole(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "ab" * 500_000), (2, "ab ab"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens > 0, r.n_bytes) for r in tokens.counted(df, path, rounds=1).collect()}
    assert got == {1: (1, True, 1_000_000), 2: (2, True, 5), 3: (0, False, 0)}


# --- 7 ------------------------------------------------------------------------


@pytest.mark.parametrize("split", [8 << 20, 900])
def test_warc(spark, split):
    import glob
    import gzip

    rng = random.Random(6)
    page = lambda n: "".join(rng.choice("abcé<>") for _ in range(n))
    big = page(3000)
    html = [page(200)] * 3 + [big] * 4 + [page(1500) for _ in range(5)] + [None, "", "\x1f\x8b\x08" * 400]
    data = [(i, f"http://x.org/é {i}\n", h) for i, h in enumerate(html)] + [(None, None, big)]
    at = Scratch(spark, "t").path("warc")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), at)
    got = {r.page_id: r for r in warc.read(spark, at, split, with_payload=True).collect()}
    assert len(got) == len(data)
    for i, _, h in data:
        raw = (h or "").encode()
        same = [j for j, _, g in data if j is not None and (g or "").encode() == raw]
        last = max(same) if len(raw) >= 1000 and i is not None else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if last == i else ("revisit", last))
        assert r.payload is None if last != i else bytes(r.payload) == raw
    n = sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in glob.glob(at.removeprefix("file://") + "/part-*"))
    assert n == len(data)


# --- 8 ------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 7])
def test_sharding(docs, rows, shards):
    got = sharding.sharded(docs, shards).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sums = {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r.size for r in got) or shards == 1


def test_sharding_cuts_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.concat(F.lit("t"), "id", F.lit("x" * 90))).alias("text"))
    sums = sharding.sharded(df, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in sums]
    assert len(b) == 10 and max(b) - min(b) <= 400


def test_written_shards_keep_every_row(spark):
    data = [(1, "a", 5, "x"), (1, "a", 5, "x"), (1, "a", 6, "y"), (None, "b", 1, "z"), (None, None, 2, "z"), (2, "", 3, None)] + [(i, f"t{i} " * (i % 9), i, "k") for i in range(3, 40)]
    df = spark.createDataFrame(data, "doc_id long, text string, key int, slot string")
    at = Scratch(spark, "t").path("shards")
    sharding.write_shards(df, at, 4)
    back = spark.read.parquet(at)
    assert Counter((r.doc_id, r.text, r.key) for r in back.collect()) == Counter(r[:3] for r in data)
    slots = {}
    for r in back.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_rows_without_an_id_are_judged_by_their_text(spark):
    long = " ".join(f"word{i % 97}x{i}" for i in range(80))
    df = spark.createDataFrame([(None, long, "en", 1), (None, "short", "en", 2), (3, long + " more", "en", 3), (3, "bad", "en", 4)], "doc_id long, text string, lang string, row int")
    assert {r.row for r in quality.kept_documents(df, reach=50.0).collect()} == {1, 3}
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert {r.row for r in decontam.clean_documents(df, items).collect()} == {2, 4}


# --- 10 -----------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 100), (1, 5), (900, 10**6), (5000, 6000), (3000, 2**62), (10, 1 << 64)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = lmscore.EliasFano(lmscore.EliasFano.coded(v, top))
        q = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64)])
        at, hit = e.rank(q)
        assert (at == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()
        assert (e.at(np.arange(len(v))) == v).all()


def test_successors_lie_within_their_context():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 40 * 1000, 3000))
    context, word = np.divmod(code, 1000)
    context *= 3
    contexts, first, kinds = np.unique(context, return_index=True, return_counts=True)
    s = lmscore.Successors(lmscore.level(contexts, first, word, 1000) | {"share": np.zeros(len(word))})
    start, end, base = s.ranges(np.arange(130))
    for c in range(130):
        own = word[context == c]
        assert end[c] - start[c] == len(own)
        at, hit = s.find(*(np.full(1000, x[c]) for x in (start, end, base)), np.arange(1000))
        assert (hit == np.isin(np.arange(1000), own)).all() and (word[at[hit]] == own).all()


@pytest.mark.parametrize("size", [(1 << 20, 1 << 21), (50, 200)])
def test_lm_scores(docs, rows, size):
    got = lmscore.scored(docs, *size).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    toks = lambda t: [*lmscore.tokens(t), b"\n"]
    train = [toks(t) for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs, contexts, after = Counter(), Counter(), {}
    for t in train:
        for a, b in zip([None, *t], t, strict=False):
            pairs[a, b] += 1
            contexts[a] += 1
            after.setdefault(a, set()).add(b)
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def given(a, w):
        if a not in contexts:
            return base(w)
        return max(pairs[a, w] - 0.75, 0) / contexts[a] + 0.75 * len(after[a]) / contexts[a] * base(w)

    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    assert len(got) == len(rows)
    for r in got:
        t = toks(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, held(r.doc_id))
        assert abs(r.base_score - sum(math.log10(base(w)) for w in t)) < 1e-6
        want = sum(math.log10(given(a, w)) for a, w in zip([None, *t], t, strict=False))
        assert want - 2e-4 * len(t) <= r.score <= want + 1e-6


def test_lm_beats_the_unigram_held_out(spark, sf_dir):
    got = lmscore.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got.s > got.b


# --- all ----------------------------------------------------------------------


def test_empty_tables(spark):
    e = empty(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    path = Scratch(spark, "t").path("warc")
    warc.write(pages, path)
    results = [
        packing.packed(e, tokenizer()), decontam.flagged(e, items), suffixes.without_repeats(e), quality.judged(e), lines.without_recurring_lines(e),
        tokens.counted(e, queries.tokenizer("piece_bpe_32k.model")), sharding.sharded(e), neardup.near_duplicates(e), lmscore.scored(e),
    ]
    assert [df.count() for df in results] == [0] * 9
    assert warc.read(spark, path).count() == 0
