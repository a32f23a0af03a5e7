"""Licence scans by matching templates with markup.

A template is a licence's wording with optional regions, replaceable regions
(so many words of any kind) and choices. All templates compile into one token
automaton: a nondeterministic one whose state sets are made deterministic as
texts ask for them, in a table that starts anew when it has grown large. A run
begins wherever the first two words of a template stand, and ends when no
template can go on, so its length is bounded by the longest template. A
template accepts when all its mandatory words have matched exactly and in order.

Each whole text is judged in the task that reads it; nothing is shuffled, and
texts of one hot group cost what others cost. A long text is split in pieces at
word ends and held as its bytes and a few numbers a word.

Defined cases: a null, empty or wordless text has no words, no labels and score
0; repeated rows are each judged; matches may overlap; an empty table gives an
empty result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .hashing import grouped
from .license_texts import TEMPLATES
from .words import FOLD, word_ids

#: Phrases that alone give a label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: State sets that the table holds before it starts anew.
STATES = 20_000
CHUNK = 1 << 20

MARKUP = regex.compile(r"<<(optional|end|var \d+ \d+|either |)|(\|)|(>>)|([^<>|]+)")


def split_words(text: str) -> list[str]:
    return text.encode().translate(FOLD).decode().split()


def parsed(markup: str) -> list:
    """A sequence of words, ("optional", seq), ("var", least, most) and
    ("either", [seq, ...])."""
    stack: list[list] = [[]]
    choices: list[list[list]] = []
    open_tags: list[str] = []
    for tag, bar, close, text in MARKUP.findall(markup):
        if text:
            stack[-1].extend(split_words(text))
        elif tag == "optional":
            open_tags += ["optional", "tag"]
            stack.append([])
        elif tag == "end":
            if not open_tags or open_tags.pop() != "optional":
                raise ValueError("<<end>> without <<optional>>")
            open_tags.append("tag")
            own = stack.pop()
            stack[-1].append(("optional", own))
        elif tag.startswith("var"):
            least, most = map(int, tag.split()[1:])
            stack[-1].append(("var", least, most))
            open_tags.append("tag")
        elif tag == "either ":
            open_tags.append("either")
            choices.append([])
            stack.append([])
        elif bar:
            if not open_tags or open_tags[-1] != "either":
                raise ValueError("| outside of a choice")
            choices[-1].append(stack.pop())
            stack.append([])
        elif close:
            if not open_tags:
                raise ValueError(">> without <<")
            if open_tags.pop() == "either":
                choices[-1].append(stack.pop())
                stack[-1].append(("either", choices.pop()))
    if open_tags or len(stack) != 1:
        raise ValueError("markup that is not closed")
    return stack[0]


def mandatory(seq: list) -> int:
    """The fewest words that the sequence takes, replaceable ones not counted."""
    return sum(1 if isinstance(x, str) else min(map(mandatory, x[1])) if x[0] == "either" else 0 for x in seq)


class Automaton:
    """The union of templates over word numbers; 0 is any word that no template
    names. Plain data, so that it travels to tasks."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        trees = [parsed(text) for _, text in templates]
        self.weight = [mandatory(t) for t in trees]
        if short := [label for label, n in zip(self.labels, self.weight, strict=True) if n < 2]:
            raise ValueError(f"a template needs two mandatory words: {short}")
        self.known: dict[bytes, int] = {}
        self.words: list[list[tuple[int, int]]] = []
        self.skips: list[list[int]] = []
        self.anys: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        roots = []
        for k, tree in enumerate(trees):
            first = self.state()
            roots.append(first)
            self.accepts[self.add(tree, first)] = k
        self.phrases = [([self.number(w) for w in p.split()], label) for p, label in phrases.items()]
        self.begin = frozenset(self.leading(roots))
        self.forget()

    def number(self, word: str) -> int:
        return self.known.setdefault(word.encode(), len(self.known) + 1)

    def state(self) -> int:
        self.words.append([])
        self.skips.append([])
        self.anys.append([])
        return len(self.words) - 1

    def add(self, seq: list, at: int) -> int:
        """Append a sequence behind state ``at``; returns its last state."""
        for x in seq:
            if isinstance(x, str):
                to = self.state()
                self.words[at].append((self.number(x), to))
            elif x[0] == "optional":
                to = self.add(x[1], at)
                end = self.state()
                self.skips[to].append(end)
                self.skips[at].append(end)
                to = end
            elif x[0] == "either":
                to = self.state()
                for own in x[1]:
                    first = self.state()
                    self.skips[at].append(first)
                    self.skips[self.add(own, first)].append(to)
            else:
                to = self.state()
                now = at
                for i in range(x[2]):
                    if i >= x[1]:
                        self.skips[now].append(to)
                    after = self.state()
                    self.anys[now].append(after)
                    now = after
                self.skips[now].append(to)
            at = to
        return at

    def closed(self, states, over_any: bool = False) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            for t in [*self.skips[s], *(self.anys[s] if over_any else ())]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def leading(self, roots: list[int]) -> set[int]:
        """Where runs begin: leading replaceable regions are passed over."""
        return {s for s in self.closed(roots, over_any=True) if self.words[s]}

    def pairs(self) -> np.ndarray:
        """Codes of the first two words of a run."""
        n, out = len(self.known) + 1, set()
        for s in self.begin:
            for word, t in self.words[s]:
                after = self.closed([t])
                if any(self.anys[a] for a in after):
                    out |= {word * n + w for w in range(n)}
                out |= {word * n + w for a in after for w, _ in self.words[a]}
        return np.array(sorted(out), np.int64)

    def forget(self) -> None:
        self.sets: list[frozenset] = [self.begin]
        self.numbers = {self.begin: 0}
        self.table: list[dict[int, int]] = [{}]
        self.finals: list[tuple[int, ...]] = [()]

    def step(self, state: int, word: int) -> int:
        """The state set behind a word, -1 if no template goes on."""
        to: set[int] = set()
        for s in self.sets[state]:
            to.update(t for w, t in self.words[s] if w == word)
            to.update(self.anys[s])
        if not to:
            self.table[state][word] = -1
            return -1
        own = frozenset(self.closed(to))
        n = self.numbers.get(own)
        if n is None:
            n = self.numbers[own] = len(self.sets)
            self.sets.append(own)
            self.table.append({})
            self.finals.append(tuple(sorted({self.accepts[s] for s in own if s in self.accepts})))
        self.table[state][word] = n
        return n

    def run(self, ids: list[int], found: set[int]) -> None:
        """Add the templates that accept from the first word of ``ids`` on."""
        if len(self.sets) > STATES:
            self.forget()
        state = 0
        for word in ids:
            after = self.table[state].get(word)
            if after is None:
                after = self.step(state, word)
            if after < 0:
                return
            state = after
            found.update(self.finals[state])

    def longest(self) -> int:
        """Words of the longest run: every state can be passed once at most."""
        return len(self.words)


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_mandatory) of each whole text.

    ``n_mandatory`` counts the mandatory words of the longest accepted wording
    (a bare phrase is a wording of one), and the score is its share in itself
    and one more word: 0 without any, 1/2 for a phrase, near 1 for a full text."""
    short_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_mandatory"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    given = Automaton(templates, PHRASES)

    def judge(auto: Automaton, starts: np.ndarray, size: int, texts: list[bytes]) -> Iterator[tuple]:
        own = [word_ids(t, auto.known) for t in texts]
        counts = np.array([len(x) for x in own])
        ends = np.cumsum(counts + 1)  # a stop between texts
        ids = np.zeros(int(ends[-1]) + 3, np.int64)
        for x, end in zip(own, ends.tolist(), strict=True):
            ids[end - 1 - len(x) : end - 1] = x
        stop = np.zeros(len(ids), bool)
        stop[ends - 1] = True
        firsts = ends - 1 - counts
        where: list[tuple[np.ndarray, str]] = []
        for numbers, label in auto.phrases:
            at = np.flatnonzero(ids[: -len(numbers)] == numbers[0])
            for k, w in enumerate(numbers[1:], 1):
                at = at[ids[at + k] == w]
            where.append((at, label))
        runs = np.flatnonzero(np.isin(ids[:-1] * size + ids[1:], starts))
        reach, judged = auto.longest(), {}
        for i, d in zip(runs.tolist(), np.searchsorted(ends, runs, side="right").tolist(), strict=True):
            auto.run(ids[i : min(i + reach, int(ends[d]) - 1)].tolist(), judged.setdefault(d, set()))
        places: dict[int, list] = {}
        for at, label in where:
            for i, d in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
                places.setdefault(d, []).append((i - int(firsts[d]), label))
        for d, n in enumerate(counts.tolist()):
            base, found = sorted(places.get(d, ())), judged.get(d, ())
            labels = {label for _, label in base}
            most = max([auto.weight[k] for k in found] + [1] * bool(base), default=0)
            yield (
                n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                ",".join(sorted(labels | {auto.labels[k] for k in found})), most / (most + 1.0), most,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = given
        starts, size = auto.pairs(), len(auto.known) + 1
        for b in batches:
            out: list[list] = [[] for _ in names]
            ids = b["doc_id"].to_pylist()
            for at, texts in grouped([x or b"" for x in b["text"].to_pylist()], CHUNK):
                for doc, row in zip(ids[at : at + len(texts)], judge(auto, starts, size, texts), strict=True):
                    for col, x in zip(out, (doc, *row), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_mandatory long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)


# --- the same in SQL -----------------------------------------------------------


def as_regex(seq: list) -> str:
    """The sequence over words that each end in one space."""
    out = []
    for x in seq:
        if isinstance(x, str):
            out.append(f"{x} ")
        elif x[0] == "optional":
            out.append(f"(?:{as_regex(x[1])})?")
        elif x[0] == "either":
            out.append(f"(?:{'|'.join(map(as_regex, x[1]))})")
        else:
            out.append(f"(?:[^ ]+ ){{{x[1]},{x[2]}}}")
    return "".join(out)


def sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for ``scanned`` over the table documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    body = [parsed(t) for _, t in templates]
    hits = [f"regexp_matches(j, ' {as_regex(t)}')" for t in body]
    places = ", ".join(
        "list_transform(list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"coalesce(w[i + {k}], '') = '{word}'" for k, word in enumerate(p.split()))
        + f"), lambda i: {{'at': i - 1, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    found = ", ".join(f"CASE WHEN {h} THEN {{'label': '{label}', 'n': {mandatory(t)}}} END" for h, (label, _), t in zip(hits, templates, body, strict=True))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, flatten([{places}]) AS p FROM t),
        v AS (SELECT doc_id, w, p, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM u),
        z AS (SELECT doc_id, w, p, f, greatest(coalesce(list_max(list_transform(f, lambda x: x.n)), 0), CASE WHEN len(p) > 0 THEN 1 ELSE 0 END) AS m FROM v)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
        CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
        array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), list_transform(f, lambda x: x.label)))), ',') AS labels,
        m / (m + 1.0::DOUBLE) AS score, CAST(m AS BIGINT) AS n_mandatory FROM z"""
