"""Text fixtures: cleaning, tokens, negation, stopwords, labels."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import labels as L
from textloom.functions import text as T
from textloom.functions import tokens as K


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, *values, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_labels(apply):
    given = ["positive", "POS", " 1 ", "4", "good", "liked", "negative", "neg", "0", "-1", "bad", "disliked", "neutral", "neut", "2", "mixed", "1.0", "2.0", "4.0", "3", "5", "", None, "nan", "NaN", "what"]
    want = ["positive"] * 6 + ["negative"] * 6 + ["neutral"] * 4 + ["negative", "negative", "positive", "neutral", "positive", None, None, None, None, None]
    assert apply(L.normalize, *given) == want
    assert apply(L.number, "positive", "negative", "neutral", None) == [1, -1, 0, None]


def test_cleaning(apply):
    got = apply(
        T.clean_text,
        "Check this link https://example.com for more info", "Contact us at support@example.com for help", "Great post @username! Really enjoyed it", "Check out #MachineLearning #8D trends",
        "This is great :) I'm so happy :D", "This is terrible :( So disappointing", "This is <b>bold</b> and <a href='test'>linked</a> text", "Sooooo goooood!!!!", "Multiple    spaces \t here", "UPPERCASE And", None, "", "   ",
    )
    assert "url_token" in got[0] and "example" not in got[0] and "email_token" in got[1] and "mention_token" in got[2]
    assert "hashtag_machinelearning" in got[3] and "hashtag_8d" in got[3]
    assert "positive_emoticon" in got[4] and "i am so happy" in got[4] and "negative_emoticon" in got[5] and "<" not in got[6]
    assert got[7] == "soo good!!" and got[8] == "multiple spaces here" and got[9] == "uppercase and" and got[10:] == ["", "", ""]


def test_repeats_of_a_raw_text_as_in_sql(apply):
    import duckdb

    from textloom.queries import oracle_text as O

    texts = ["AAAA", "aaaa", "aAaA", "====", "----", "|||| x", "****", "1111", "ññññ", "ÑÑÑÑ", "no  run", "    ", "~~~~ bbbb", "a\n\n\n\n", "[[[[", "\\\\\\\\"]
    found = duckdb.sql(f"SELECT {O.squeeze('text')} <> text FROM (SELECT unnest(?) AS text)", params=[texts]).fetchall()
    assert apply(lambda x: T.cleaning_counts(x)["has_repeats"], *texts) == [int(x) for (x,) in found]


def test_contractions(apply):
    got = apply(T.expand_contractions, "don't", "won't", "can't", "it's", "ain't", "let's", "Don't worry", "candy", "cant dont im youre", "o'clock", None)
    assert got == ["do not", "will not", "cannot", "it is", "am not", "let us", "Do not worry", "candy", "cannot do not i am you are", "of the clock", None]
    assert apply(T.count_contractions, "none here", "don't", "don't can't", "don't can't it's", None) == [0, 1, 2, 3, 0]
    known = T.contraction_dictionary()
    assert len(known) == 111 and sum("not" in v for v in known.values()) == 43


def test_tokens(apply):
    split = lambda **o: lambda x: K.tokenize(x, **o)
    assert apply(split(), "This is a test") == [["This", "is", "test"]]
    assert apply(split(keep_numbers=False), "There are 123 items") == [["There", "are", "items"]]
    assert apply(split(), "Price is 19.99 dollars")[0].count("NUMBER_TOKEN") >= 1
    assert apply(split(min_length=3), "The cat is on the mat") == [["The", "cat", "the", "mat"]]
    got = apply(split(), "state-of-the-art well-known a-b x-y random-stuff")[0]
    assert {"state-of-the-art", "well-known", "random", "stuff"} <= set(got) and "a-b" not in got and "x-y" not in got
    assert apply(K.split_tokens, "well done, ok!! done!") == [["well", "done", ",", "ok", "!!", "done", "!", "done,", "ok!!", "done!"]]
    assert apply(lambda x: K.split_tokens(x, False), "done! done!") == [["done", "!", "done", "!"]]
    assert apply(split(), "test test test", None, "") == [["test"] * 3, [], []]


def test_negation_and_stopwords(apply):
    got = apply(
        K.preprocess, "not bad", "never again", "not bad but good", "not one two three four five six", "don't like", "dont like this",
        "average at best", "this is at worst mediocre", "not good at all", "this is by far the best",
    )
    assert "NOT_bad" in got[0] and "NOT_again" in got[1] and "NOT_bad" in got[2] and "NOT_good" not in got[2]
    assert [t for t in got[3] if t.startswith("NOT_")] == ["NOT_one", "NOT_two", "NOT_three", "NOT_four"]
    assert "NOT_like" in got[4] and "NOT_like" in got[5] and ["at", "best"] == got[6][-2:] and "at" in got[7]
    assert "by" in got[9] and "far" in got[9] and "this" not in got[9]


def test_negation_matches_a_fold(apply, spark):
    import random

    rng = random.Random(1)
    lists = [[rng.choice(["not", "but", ",", "good", "bad", "No", "x"]) for _ in range(rng.randint(0, 25))] for _ in range(300)]

    def fold(tokens):
        out, left = [], 0
        for t in tokens:
            if t.lower() in K.BOUNDARIES:
                left = 0
            elif t.lower() in K.TRIGGERS:
                left = 4
            elif left:
                t, left = "NOT_" + t, left - 1
            out.append(t)
        return out

    assert apply(K.negation_scope, *lists, type_="array<string>") == [fold(x) for x in lists]


def test_small_functions(apply):
    assert apply(T.sanitize_features, "a-b, c!", " ", None, "!!") == ["a b c", "empty_content_placeholder", "empty_content_placeholder", "empty_content_placeholder"]
    assert apply(lambda x: T.truncate(x, 3), "abcdef", "abc", None) == ["abc...", "abc", None]
    assert apply(T.text_hash, None)[0] == "null" and len(apply(T.text_hash, "x")[0]) == 16
    assert apply(T.dataset_name, "/data/raw/yelp/train.csv", "imdb.csv") == ["yelp", "imdb"]
    assert apply(K.ngrams, ["A", "b", "C"], ["x"], [], type_="array<string>") == [["a", "b", "c", "a b", "b c"], ["x"], []]
    assert apply(L.direction, 1.0, -1.0, 0.0, type_="double") == ["positive", "negative", "neutral"]


def test_stopwords_alone_are_looked_up_in_phrases(spark):
    """Costly steps of a token or a text are guarded: phrases behind stopwords,
    scopes behind a trigger; the statistics clean a text once."""
    from textloom.queries import QUERIES

    df = spark.createDataFrame([(["x"],)], "x array<string>")
    plan = df.select(K.remove_stopwords(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("yourselves") < plan.index("at best")
    plan = df.select(K.negation_scope(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert "array_contains" in plan
    plan = QUERIES["op_preprocessing_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" url_token ") == 1


def test_contractions_beside_cuts(apply):
    texts = ["I don't.  thats, x'cause!\tYoure?", "don't", ". ", "a. ", "no. i'm\n; we'll. end", None, "it's.it's, it's"]
    want = ["I do not.  that is, xbecause!\tYou are?", "do not", ". ", "a. ", "no. i am\n; we will. end", None, "it is.it is, it is"]
    assert apply(T.expand_contractions, *texts) == want


def test_short_ways_of_tokens_and_types(apply):
    """Plain words and texts without hyphens skip patterns; nothing else changes."""
    import re

    texts = ["plain words alone", "well-known x-y self-made-thing a-b, (c-d)", "it's 1,250 at 19.99 x_1 \u2028 wörd naïve-like", "word\u2028 w w. w", "a--b -- - non-stop non-stop.", "", None, "!!! ... A I"]

    def valid(c):
        low = c.lower()
        return bool(re.fullmatch("[a-z]{2,}(-[a-z]{2,})+", low)) and (low.split("-")[0] in K.COMPOUND_FIRST or low.split("-")[-1] in K.COMPOUND_LAST or low.count("-") > 1)

    def split(x):
        words = []
        for c in re.split(r"\s+", re.sub(rf"(?<![A-Za-z0-9_]){K.COMPOUND}(?![A-Za-z0-9_])", r" \g<0> ", x or ""), flags=re.A):
            words += c.split("-") if re.fullmatch(K.COMPOUND, c) and not valid(c) else [c]
        words = [w for w in words if w]
        first = [t for w in words for t in ([w] if valid(w) else re.findall(K.TOKEN, w, re.A))]
        return first + list(dict.fromkeys(w for w in words if re.search(r"\w", w, re.A) and w not in first))

    assert apply(K.split_tokens, *texts) == [split(x) for x in texts]
    given = ["word", "Wo_rd", "w", "7", "1,250", "it's", "''", "a-b", "a-b'", "--", "wörd", "x1", "x.", "_", "word\u2028"]
    want = ["word", "word", "single_char", "number", "number", "contraction", "punctuation", "hyphenated", "other", "punctuation", "other", "word", "other", "punctuation", "other"]
    got = apply(K.token_type, *given)
    assert got[:-1] == want[:-1] and got[-1] in ("word", "other")


def test_removable_words_give_the_lengths_of_all_lists(apply):
    texts = ["at best the end", "so far as well as The so", "by the far", "not no doubt", "at", "", None, "no way by no means a an", "very so much so"]
    names = ("basic", "extended", "minimal", "sentiment_aware")
    tokens = lambda x: F.filter(F.split(F.lower(x), " "), lambda w: w != "")
    for s in names:
        want = apply(lambda x: F.size(K.remove_stopwords(tokens(x), s)), *texts)  # noqa: B023
        got = apply(lambda x: F.size(tokens(x)) - F.size(F.filter(K.removable(tokens(x)), lambda w: K.is_stopword(w, s))), *texts)  # noqa: B023
        assert got == want, s


def test_texts_without_a_mark_skip_its_pattern(spark):
    """What lets a text or a place be passed over changes no result."""
    words = [x for x in T.contraction_dictionary() if x not in T.AFTER_WORD]
    tree = re.compile(T.one_of(words))
    near = {w[:i] + c + w[i + 1 :] for w in words for i in range(len(w)) for c in ("", "x", "'")} | {w + "s" for w in words}
    assert {w for w in near | set(words) if tree.fullmatch(w)} == set(words)
    assert "(" not in T.one_of(["a", "b"]) and T.GUARD.count("|") < 120
    marks = ":;=8)]}>D({<[P^_3/"
    for n in (1, 2, 3):
        for own in map("".join, itertools.product(marks, repeat=n)):
            for every, first in ((T.HAPPY, T.HAPPY_FIRST), (T.SAD, T.SAD_FIRST)):
                assert not re.match(every, own) or re.match(first, own), own
    for step, mark in ((T.url_token, "://"), (T.email_token, "@"), (T.mention_token, "@"), (T.hashtag_token, "#"), (T.strip_html, "<")):
        plan = spark.createDataFrame([("a",)], "t string").select(step(F.col("t")))._jdf.queryExecution().analyzed().toString()
        assert f"contains(lambda x_, {mark})" in re.sub(r"lambda x_?[\w#]*(?:[ ]*#\d+)?", "lambda x_", plan.lower()), (mark, plan)
