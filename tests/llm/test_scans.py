"""Licence scans, tokenizer alignment and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from textloom.llm import alignment, licenses, mph, search
from textloom.llm.license_texts import TEMPLATES
from textloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, shard long, n_words long, score double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def table_of(spark, texts, parts=3):
    """Texts as documents, with repeated rows, null ids and clashing columns."""
    rows = [(i, t, 1, 2, 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], 1, 2, 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts), [(r[0], r[1]) for r in rows]


# --- 11 -----------------------------------------------------------------------


def plain(markup):
    """A text of the template with every optional region left out."""
    s, before = markup, None
    while s != before:
        before, s = s, re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", "", s, flags=re.S)
    s = re.sub(r"<<var (\d+) \d+>>", lambda m: "thing " * int(m[1]), s)
    return re.sub(r"<<either ([^|>]*)\|[^>]*>>", r"\1", s)


LICENSE_TEXTS = [
    *[plain(t) for _, t in TEMPLATES],
    *["before " * 50 + plain(t).upper() + "\n after" for _, t in TEMPLATES],
    plain(TEMPLATES[0][1]).replace("free of charge", "for a charge"),
    "Released under the MIT\nLicense. Apache-License? general   public license, mit license",
    "Licensed under a CC BY-NC 4.0 text and a Mit. License!", "mit", "license mit", "é mit license é", None, "", " \n", "x" * 5_000_000,
    "permission is hereby " * 2000, "mit license " * 3000, ("word " * 900_000) + "mit license",
]


def test_licenses_against_regular_expressions(spark):
    docs, rows = table_of(spark, LICENSE_TEXTS)
    patterns = [(label, re.compile(" " + licenses.as_regex(t)), licenses.mandatory(t)) for label, t in ((x, licenses.parsed(m)) for x, m in TEMPLATES)]
    want = []
    for doc, text in rows:
        words = folded(text)
        joined = " " + " ".join(words) + " "
        base = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        found = [(label, n) for label, p, n in patterns if p.search(joined)]
        names = {label for _, label in base}
        m = max([n for _, n in found] + [1] * bool(base), default=0)
        places = (base[0][0], base[-1][0]) if base else (None, None)
        want.append((doc, len(words), len(base), *places, ",".join(sorted(names)), ",".join(sorted(names | {x for x, _ in found})), m / (m + 1.0), m))
    got = [tuple(r) for r in licenses.scanned(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {r[0]: r[6] for r in got}
    assert all(label in labels[i].split(",") for i, (label, _) in enumerate(TEMPLATES))
    assert labels[2 * len(TEMPLATES)] == ""  # one mandatory word differs


def test_licenses_sql(spark):
    docs, _ = table_of(spark, [t for t in LICENSE_TEXTS if not t or len(t) < 100_000])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(licenses.sql()).fetchall()
    assert sorted(map(str, map(tuple, licenses.scanned(docs).collect()))) == sorted(map(str, want))


def test_license_table_starts_anew(spark, monkeypatch):
    docs, _ = table_of(spark, LICENSE_TEXTS[:20])
    want = sorted(map(str, licenses.scanned(docs).collect()))
    monkeypatch.setattr(licenses, "STATES", 3)
    assert sorted(map(str, licenses.scanned(docs).collect())) == want


@pytest.mark.parametrize("markup", ["<<optional>> a", "a <<end>>", "<<either a|b", "one"])
def test_license_markup_is_checked(markup):
    with pytest.raises(ValueError):
        licenses.Automaton([("x", markup)], {})


# --- 12 -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 50_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
    f = mph.build(keys)
    assert sorted(mph.slots(f, keys).tolist()) == list(range(len(keys)))
    assert np.all(mph.slots(f, keys + np.uint64(1 << 50)) < max(len(keys), 1))


def test_minimal_perfect_hash_keeps_a_rest(monkeypatch):
    monkeypatch.setattr(mph, "LEVELS", 1)
    keys = np.arange(1000, dtype=np.uint64)
    f = mph.build(keys)
    assert len(f["rest"]) and sorted(mph.slots(f, keys).tolist()) == list(range(1000))


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.bytes_of_byte_level()

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    kept, counts = [], Counter()
    for _, text in rows:
        if not text:
            kept.append(None)
            continue
        data, e, ids_b = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False), sp.encode(text)
        bytes_a, bytes_b = [bytes(byte[c] for c in t) for t in e.tokens], [piece(i) for i in ids_b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            kept.append(None)
            continue
        ends_b = {int(x): j for j, x in enumerate(np.cumsum(list(map(len, bytes_b))))}
        own = [(i, ends_b[int(x)]) for i, x in enumerate(np.cumsum(list(map(len, bytes_a)))) if int(x) in ends_b]
        kept.append((e.ids, ids_b, own))
        counts.update((e.ids[i], ids_b[j]) for i, j in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for (doc, _), x in zip(rows, kept, strict=True):
        if x is None:
            yield (doc, 0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, own = x
        groups, s, t = [], 0, 0
        for i, j in own:
            groups.append(",".join(map(str, ids_a[s : i + 1])) + "|" + ",".join(map(str, ids_b[t : j + 1])))
            s, t = i + 1, j + 1
        n = [counts[ids_a[i], ids_b[j]] for i, j in own]
        high = sum(c == best[ids_b[j]] for c, (_, j) in zip(n, own, strict=True))
        yield (doc, len(ids_a), len(ids_b), len(own), len(own), high, sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest())


def odd_texts():
    rng = random.Random(3)
    spaces = [" ", "  ", "\n", "\t", "\r", "\r\n", " ", "　", " ", "\x0b", "", "\n\n"]
    parts = ["it's", "don't", "12,345", "été", "𝄞", "naïve", "中文", "x" * 30, "<s>", "<|endoftext|>", "\x00", "ab", "foo_bar", "'s", "...", "!?"]
    mixed = ["".join(rng.choice(spaces) + rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    return [None, "", " ", "\n", " \n", "a", "▁ foo", "a ▁ b foo", "foo " * 3000, "y" * 20_000, "foo bar", "foo bar", *mixed]


def test_alignment_against_whole_texts(spark, monkeypatch):
    docs, rows = table_of(spark, odd_texts(), parts=20)
    want = sorted(brute_alignment(rows), key=str)
    got = [tuple(r)[:8] for r in alignment.aligned(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), shards=5).collect()]
    assert sorted(got, key=str) == want
    monkeypatch.setattr(alignment, "REMEMBER", 10)  # memories that start anew, deeper trees
    monkeypatch.setattr(alignment, "CHUNK", 300)
    monkeypatch.setattr(alignment, "FAN", 2)
    got = [tuple(r)[:8] for r in alignment.aligned(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), shards=3).collect()]
    assert sorted(got, key=str) == want


# --- 13 -----------------------------------------------------------------------


def brute_ranks(rows, items, k):
    docs = [(math.inf if d is None else d, i, folded(t)) for i, (d, t) in enumerate(rows)]
    docs = [x for x in docs if x[2]]
    n_docs, n_words = len(docs), sum(len(w) for _, _, w in docs)
    tf = [Counter(w) for _, _, w in docs]
    df = Counter(t for c in tf for t in c)
    for item, text in items:
        scores = []
        for (d, i, words), c in zip(docs, tf, strict=True):
            m = 100 - 25 + 25 * len(words) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in folded(text) if c[t])
            if s > 0:
                scores.append((-s, d, i))
        for rank, (s, d, _) in enumerate(sorted(scores)[:k], 1):
            yield (item, rank, None if d == math.inf else d, -s)


@pytest.mark.parametrize(("docs_a_shard", "window", "k"), [(1 << 14, 16, 20), (300, 1, 3), (128, 2, 1)])
def test_search_against_brute_force(spark, monkeypatch, docs_a_shard, window, k):
    rng = random.Random(5)
    zipf = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(zipf, k=rng.randint(1, 60))) for _ in range(900)]
    texts += [None, "", " .,;", "W1 É w1", texts[5], texts[5], "w7 " * 70_000, "w2 " * 300]
    docs, rows = table_of(spark, texts, parts=4)
    items = [(i, " ".join(rng.choices(zipf, k=rng.randint(1, 25)))) for i in range(30)] + [(77, None), (78, "unknownword"), (3, "w7 w7 É"), (None, "w2")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank long")
    monkeypatch.setattr(search, "DOCS", docs_a_shard)
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "ITEMS", 13)
    got = [tuple(r) for r in search.ranked(docs, asked, k).collect()]
    assert sorted(got, key=str) == sorted(brute_ranks(rows, items, k), key=str)


def test_search_leaves_blocks_coded(spark):
    """Block maxima keep most blocks of common terms from being decoded."""
    rng = random.Random(1)
    texts = ["common " * rng.randint(1, 3) + "filler " * rng.randint(5, 40) + ("rare " * rng.randint(3, 9) if i < 30 else "") for i in range(5000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    known = {b"common": 1, b"rare": 2}
    lists = search.postings(docs, known)
    n, words = lists.selectExpr("sum(docs)", "sum(words)").first()
    index = search.sealed(lists, n, words).collect()
    assert len(index) == 1
    shard = search.Shard(np.frombuffer(index[0].data, np.uint8))
    tops = dict(zip(index[0].terms, index[0].tops, strict=True))
    got = shard.top([(1, 1, tops[1]), (2, 5000, 5000 * tops[2])], 5)
    assert len(got) == 5 and all(d < 30 for _, d in got)
    assert shard.decoded < 0.6 * len(shard.block)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", 0, 0, 0.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert licenses.scanned(none).count() == 0
    assert alignment.aligned(none, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).count() == 0
    assert search.ranked(none, items).count() == 0 and search.ranked(docs, items.limit(0)).count() == 0
