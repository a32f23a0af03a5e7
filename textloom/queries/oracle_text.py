"""DuckDB expressions for the text steps (RE2 patterns, list functions)."""

from __future__ import annotations

from ..adapters import quoted as q
from ..functions import text as T
from ..functions import tokens as K


def rr(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def emoticons(x: str) -> str:
    return rr(rr(x, T.HAPPY, " positive_emoticon "), T.SAD, " negative_emoticon ")


def contractions(x: str) -> str:
    for pattern, word in T.contraction_rules():
        x = rr(x, rf"(?i)\b{pattern}\b", word.replace("$1", r"\1"))
    return x


ANY_CONTRACTION = r"(?i)\b(?:" + "|".join(sorted(T.contraction_dictionary(), key=lambda w: (-len(w), w))) + r")\b"
REPEATABLE = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíáú0123456789.,!?|*#$%&- "


def squeeze(x: str) -> str:
    for c in REPEATABLE:
        x = rr(x, rf"\x{{{ord(c):x}}}{{4,}}", c * 2)
    return x


def clean_raw(x: str) -> str:
    x = rr(x, T.URL, " url_token ")
    x = rr(x, rf"\b{T.EMAIL}\b", " email_token ")
    x = rr(x, T.MENTION, " mention_token ")
    x = rr(x, T.HASHTAG, r" hashtag_\1 ")
    x = rr(emoticons(x), T.HTML, " ")
    return x


#: Steps as chained SELECTs; each view has (doc_id, text) or (doc_id, tokens).
CLEAN = f"""a1 AS (SELECT doc_id, {clean_raw("text")} AS text FROM decorated),
a2 AS (SELECT doc_id, lower({contractions("text")}) AS text FROM a1),
cleaned AS (SELECT doc_id, trim({rr(squeeze("text"), r"\s+", " ")}) AS text FROM a2)"""


def words(alternatives) -> str:
    return "(" + ", ".join(q(w) for w in alternatives) + ")"


def valid(c: str) -> str:
    first, last = "|".join(K.COMPOUND_FIRST), "|".join(K.COMPOUND_LAST)
    return (
        f"(regexp_full_match(lower({c}), '[a-z]{{2,}}(-[a-z]{{2,}})+') AND (regexp_matches(lower({c}), '^({first})-')"
        f" OR regexp_matches(lower({c}), '-({last})$') OR regexp_matches({c}, '-.*-')))"
    )


def reason(t: str, keep_numbers: bool = True, least: int = 2) -> str:
    number = "number_kept" if keep_numbers else "number"
    return (
        f"CASE WHEN regexp_full_match({t}, {q(K.NUMBER)}) THEN '{number}' WHEN length({t}) = 1 THEN CASE WHEN {t} IN {words(K.SINGLE)} THEN 'single_kept' ELSE 'single' END"
        f" WHEN length({t}) < {least} THEN 'short' WHEN regexp_full_match({t}, '[^a-zA-Z0-9]+') THEN"
        f" CASE WHEN regexp_full_match({t}, '[!?]+|\\.\\.\\.') THEN 'punctuation_kept' ELSE 'punctuation' END ELSE 'kept' END"
    )


def split_steps(source: str, prefix: str) -> str:
    """Views ``{prefix}_first`` (chunks, first) and ``{prefix}_split`` (tokens)."""
    padded = rr("text", rf"\b{K.COMPOUND}\b", r" \0 ")
    cut = f"CASE WHEN regexp_full_match(c, {q(K.COMPOUND)}) AND NOT {valid('c')} THEN string_split(c, '-') ELSE [c] END"
    return f"""{prefix}_chunks AS (SELECT doc_id, list_filter(flatten(list_transform(string_split_regex({padded}, '\\s+'), lambda c: {cut})), lambda c: c <> '') AS chunks FROM {source}),
{prefix}_first AS (SELECT doc_id, chunks, flatten(list_transform(chunks, lambda c: CASE WHEN {valid("c")} THEN [c] ELSE regexp_extract_all(c, {q("(" + K.TOKEN + ")")}, 1) END)) AS first FROM {prefix}_chunks),
{prefix}_split AS (SELECT doc_id, list_concat(first, list_filter(chunks, lambda c, i: regexp_matches(c, '\\w') AND NOT list_contains(first, c) AND list_position(chunks, c) = i)) AS tokens FROM {prefix}_first)"""


def filtered_step(source: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, list_transform(list_filter(tokens, lambda t: {reason("t")} LIKE '%kept'),
    lambda t: CASE WHEN regexp_full_match(t, {q(K.NUMBER)}) THEN 'NUMBER_TOKEN' ELSE t END) AS tokens FROM {source})"""


def negation_steps(source: str, name: str) -> str:
    code = f"CASE WHEN lower(t) IN {words(K.BOUNDARIES)} THEN 'B' WHEN lower(t) IN {words(K.TRIGGERS)} THEN 'T' ELSE '-' END"
    return f"""{name}_codes AS (SELECT doc_id, tokens, list_transform(tokens, lambda t: {code}) AS codes FROM {source}),
{name} AS (SELECT doc_id, list_transform(tokens, lambda t, i: CASE WHEN codes[i] = '-' AND i > 1 AND
    regexp_matches(array_to_string(codes[greatest(i - {K.SCOPE}, 1):i - 1], ''), 'T-*$') THEN 'NOT_' || t ELSE t END) AS tokens FROM {name}_codes)"""


def phrase(ts: str, i: str) -> str:
    pairs = words(f"{a} {b}" for a, ends in K.PHRASES.items() for b in ends)
    return (
        f"(coalesce(lower({ts}[{i}]) || ' ' || lower({ts}[{i} + 1]) IN {pairs}, false)"
        f" OR ({i} > 1 AND coalesce(lower({ts}[{i} - 1]) || ' ' || lower({ts}[{i}]) IN {pairs}, false)))"
    )


def stopword(t: str, strategy: str) -> str:
    if strategy == "basic":
        return f"lower({t}) IN {words(K.BASIC)}"
    if strategy == "minimal":
        return f"lower({t}) IN {words(K.MINIMAL)}"
    if strategy == "extended":
        return f"(lower({t}) IN {words(K.EXTENDED)} AND lower({t}) NOT IN {words(K.BEARING)})"
    return (
        f"({t} IN {words(K.EXTENDED)} AND {t} NOT IN {words(K.NEGATIONS)} AND {t} NOT IN {words(K.INTENSIFIERS)}"
        f" AND NOT regexp_matches({t}, {q(K.KEPT_PREFIX)}) AND NOT contains({t}, '-'))"
    )


def kept_step(source: str, name: str, strategy: str) -> str:
    return f"{name} AS (SELECT doc_id, list_filter(tokens, lambda t, i: {phrase('tokens', 'i')} OR NOT {stopword('t', strategy)}) AS tokens FROM {source})"


#: The whole pipeline from ``decorated`` to ``kept`` (tokens).
TOKENS = f"{CLEAN}, {split_steps('cleaned', 's')}, {filtered_step('s_split', 'tokenized')}"
PIPELINE = f"{TOKENS}, {negation_steps('tokenized', 'negated')}, {kept_step('negated', 'kept', 'sentiment_aware')}"
#: Lower-cased white-space words of the samples, one row each.
SAMPLE_WORDS = "sample_words AS (SELECT id, label, domain, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM samples), terms AS (SELECT DISTINCT id, label, domain, term FROM sample_words WHERE term <> '')"
