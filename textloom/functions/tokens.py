"""Token lists as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import among, let
from .text import clean_text

# Tokens and compounds.
COMPOUND = r"[a-zA-Z]+(?:-[a-zA-Z]+)+"
COMPOUND_FIRST = ("self", "well", "multi", "non", "pre", "post", "anti", "pro", "co")
COMPOUND_LAST = ("like", "based", "free", "proof", "ready", "aware", "wise")
TOKEN = r"\w+|[.!?]+|[,;:]+"
#: A chunk that is one token as it stands.
PLAIN = r"^\w+\z"
NUMBER = r"\d+(?:\.\d+)?|\d{1,3}(?:,\d{3})*(?:\.\d+)?"
SINGLE = ("i", "!", "?", ".", ":", ";")

# Negation scope.
TRIGGERS = ("not", "no", "never", "neither", "nobody", "nothing", "nowhere", "none", "cannot", "without", "lack", "lacking")
BOUNDARIES = ("but", "however", "although", "though", "yet", "except", ".", "!", "?", ",", ";", ":")
SCOPE = 4

# Stopword lists.
BASIC = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with would could should this these they them there their than then been have had".split())
EXTENDED = BASIC + tuple("do does did can cannot i me my myself we our ours ourselves you your yours yourself yourselves him his himself she her hers herself us theirs themselves what which who whom whose where when why how all any both each few more most other some such no nor only own same so up very just now".split())
MINIMAL = tuple("the a an and or but in on at to for of with by".split())
NEGATIONS = tuple("not no never none nothing nobody nowhere neither nor cannot".split())
BEARING = tuple("not no never none nothing nobody nowhere very really quite extremely incredibly absolutely totally completely utterly highly particularly rather somewhat fairly pretty much too so".split())
INTENSIFIERS = tuple("very really quite extremely incredibly absolutely totally completely utterly highly particularly rather somewhat fairly pretty much too so super ultra mega hyper exceptionally remarkably".split())
PHRASES = {"at": ("best", "worst", "least", "most", "all"), "by": ("far", "no", "any"), "no": ("way", "means", "doubt"), "so": ("far", "much"), "as": ("well", "good", "bad", "expected")}
KEPT_PREFIX = r"^(?:positive_emoticon|negative_emoticon|url_token|email_token|mention_token|hashtag_)|^number_token$"


def valid_compound(word: Column) -> Column:
    """All parts of two letters or more, and a known first or last part or
    three parts."""
    low = F.lower(word)
    shape = low.rlike(r"^[a-z]{2,}(-[a-z]{2,})+$")
    return word.contains("-") & shape & (low.rlike(f"^({'|'.join(COMPOUND_FIRST)})-") | low.rlike(f"-({'|'.join(COMPOUND_LAST)})$") | low.rlike("-.*-"))


def compounds(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_])({COMPOUND})(?![A-Za-z0-9_])"), F.lit(1))
    return F.filter(found, valid_compound)


def chunks(text: Column) -> Column:
    """Words by white space, compounds that are not kept split at hyphens; a text
    without hyphens is split alone."""

    def cut(text: Column) -> Column:
        padded = F.regexp_replace(text, f"(?<![A-Za-z0-9_]){COMPOUND}(?![A-Za-z0-9_])", " $0 ")
        parts = lambda c: F.when(c.contains("-") & c.rlike(f"^{COMPOUND}$") & ~valid_compound(c), F.split(c, "-")).otherwise(F.array(c))
        return F.when(text.contains("-"), F.flatten(F.transform(F.split(padded, r"\s+"), parts))).otherwise(F.split(text, r"\s+"))

    return F.filter(let(text, cut), lambda c: c != "")


def split_tokens(text: Column, append_chunks: bool = True) -> Column:
    """Words and punctuation in order; with ``append_chunks`` also each chunk
    that is no token yet (a word with its punctuation), at the end."""

    def body(words: Column) -> Column:
        cut = lambda c: F.when(c.rlike(PLAIN) | valid_compound(c), F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1)))
        first = F.flatten(F.transform(words, cut))
        if not append_chunks:
            return first
        more = F.filter(words, lambda c: ~c.rlike(PLAIN) & c.rlike(r"\w"))  # a plain word is a token already
        return let(first, lambda own: F.concat(own, F.array_except(more, own)))

    return let(chunks(F.coalesce(text, F.lit(""))), body)


def drop_reason(token: Column, keep_numbers: bool, min_length: int) -> Column:
    """Why the final filter drops a token, or how it keeps it."""
    return (
        F.when(token.rlike(f"^(?:{NUMBER})$"), "number_kept" if keep_numbers else "number")
        .when(F.length(token) == 1, F.when(among(token, SINGLE), "single_kept").otherwise("single"))
        .when(F.length(token) < min_length, "short")
        .when(token.rlike("^[^a-zA-Z0-9]+$"), F.when(token.rlike(r"^[!?]+$|^\.\.\.$"), "punctuation_kept").otherwise("punctuation"))
        .otherwise("kept")
    )


def filter_tokens(tokens: Column, keep_numbers: bool = True, min_length: int = 2) -> Column:
    plain = lambda t: (F.length(t) >= max(min_length, 2)) & t.rlike("^[a-zA-Z]")  # noqa: E731  kept by every rule, and no number
    kept = F.filter(tokens, lambda t: plain(t) | drop_reason(t, keep_numbers, min_length).endswith("kept"))
    return F.transform(kept, lambda t: F.when(t.rlike(f"^(?:{NUMBER})$"), "NUMBER_TOKEN").otherwise(t))


def tokenize(text: Column, keep_numbers: bool = True, min_length: int = 2, append_chunks: bool = True) -> Column:
    return filter_tokens(split_tokens(text, append_chunks), keep_numbers, min_length)


def token_type(token: Column) -> Column:
    return (
        F.when((F.length(token) > 1) & token.rlike(r"^[a-zA-Z]+\z"), "word")  # the commonest first, no other rule takes it
        .when(token.contains("-") & token.rlike(f"^{COMPOUND}$"), "hyphenated")
        .when(token.contains("'") & token.rlike(r"^\w+'\w+$"), "contraction")
        .when(token.rlike(f"^(?:{NUMBER})$"), "number")
        .when(token.rlike(r"^[^a-zA-Z0-9]+$"), "punctuation")
        .when(F.length(token) == 1, "single_char")
        .when(token.rlike(r"^\w+$"), "word")
        .otherwise("other")
    )


def negation_scope(tokens: Column) -> Column:
    """``NOT_`` before up to four tokens after a trigger. A token is inside if it
    is neither trigger nor boundary itself and, of the four tokens before, the
    last that is one of both is a trigger."""

    def code(t: Column) -> Column:
        low = F.lower(t)
        return F.when(among(low, BOUNDARIES), "B").when(among(low, TRIGGERS), "T").otherwise("-")

    def tagged(own: Column) -> Column:
        def mark(codes: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                before = F.array_join(F.slice(codes, F.greatest(i - SCOPE + 1, F.lit(1)), F.least(i, F.lit(SCOPE))), "")
                return F.when((F.get(codes, i) == "-") & before.rlike("T-*$"), F.concat(F.lit("NOT_"), t)).otherwise(t)

            return F.when(F.array_contains(codes, "T"), F.transform(own, one)).otherwise(own)

        return let(F.transform(own, code), mark)

    return let(tokens, tagged)


def in_phrase(tokens: Column, i: Column) -> Column:
    """Whether the token at i starts or ends a protected pair."""
    pairs = [f"{a} {b}" for a, ends in PHRASES.items() for b in ends]
    here = F.lower(F.get(tokens, i))
    after = F.concat_ws(" ", here, F.lower(F.get(tokens, i + 1)))
    before = F.concat_ws(" ", F.lower(F.get(tokens, i - 1)), here)
    return among(after, pairs) | F.coalesce((i > 0) & among(before, pairs), F.lit(False))


def is_stopword(token: Column, strategy: str = "sentiment_aware", keep_negations: bool = True, keep_intensifiers: bool = True) -> Column:
    low = F.lower(token)
    if strategy == "basic":
        return among(low, BASIC)
    if strategy == "minimal":
        return among(low, MINIMAL)
    if strategy == "extended":
        return among(low, EXTENDED) & ~among(low, BEARING)
    if strategy != "sentiment_aware":
        raise ValueError(f"no such stopword strategy: {strategy}")
    out = among(token, EXTENDED) & ~token.rlike(KEPT_PREFIX) & ~token.contains("-")
    if keep_negations:
        out &= ~among(token, NEGATIONS)
    if keep_intensifiers:
        out &= ~among(token, INTENSIFIERS)
    return out


def remove_stopwords(tokens: Column, strategy: str = "sentiment_aware", **keep: bool) -> Column:
    """Tokens that are no stopwords, or part of a protected pair (looked at for
    stopwords alone)."""
    return let(tokens, lambda own: F.filter(own, lambda t, i: ~is_stopword(t, strategy, **keep) | in_phrase(own, i)))


def removable(tokens: Column) -> Column:
    """The tokens, lower-cased, that some list of ``is_stopword`` holds and no
    protected pair keeps: neighbours are looked at for these alone."""
    ends = sorted({w for a, b in PHRASES.items() for w in (a, *b)})

    def gone(own: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            low = F.lower(t)
            return among(low, sorted({*BASIC, *EXTENDED, *MINIMAL})) & ~(among(low, ends) & in_phrase(own, i))

        return F.filter(own, one)

    return let(tokens, gone)


def preprocess_clean(text: Column, strategy: str = "sentiment_aware", **options) -> Column:
    """Tokenise a cleaned text, mark negation, drop stopwords."""
    return remove_stopwords(negation_scope(tokenize(text, **options)), strategy)


def preprocess(text: Column, strategy: str = "sentiment_aware", **options) -> Column:
    """Clean, tokenise, mark negation, drop stopwords."""
    return preprocess_clean(clean_text(text), strategy, **options)


def pairs(tokens: Column) -> Column:
    """Neighbours as structs (first, second)."""
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.filter(F.zip_with(tokens, rest, lambda a, b: F.struct(a.alias("first"), b.alias("second"))), lambda p: p["second"].isNotNull())


def ngrams(tokens: Column) -> Column:
    """Lower-cased words, then pairs of neighbours."""

    def both(own: Column) -> Column:
        pairs = F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.concat(own, F.filter(pairs, lambda p: p.isNotNull()))

    return let(F.transform(tokens, lambda t: F.lower(t)), both)
