"""Sentiment labels and the rules of a labelled sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import among, blank, trim

# Label spellings, limits and cut-offs.
POSITIVE = ("positive", "pos", "1", "4", "good", "liked")
NEGATIVE = ("negative", "neg", "0", "-1", "bad", "disliked")
NEUTRAL = ("neutral", "neut", "2", "mixed")
TEXT_COLUMNS = ("text", "review", "comment", "content", "message", "body")
LABEL_COLUMNS = ("sentiment", "label", "polarity", "class", "rating")
MAX_TEXT = 10_000
HIGH_CONFIDENCE = 0.8
WARNING_CONFIDENCE = 0.75


def normalize(raw: Column) -> Column:
    """Label of a raw spelling: a known word, else a rating (up to 2 negative,
    from 4 positive), else null."""
    key = F.lower(trim(raw))
    number = F.when(~key.contains("nan"), key.try_cast("double"))
    return (
        F.when(among(key, POSITIVE), "positive")
        .when(among(key, NEGATIVE), "negative")
        .when(among(key, NEUTRAL), "neutral")
        .when(number <= 2, "negative")
        .when(number >= 4, "positive")
        .when(number.isNotNull(), "neutral")
    )


def number(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).when(label == "neutral", 0)


def reject_reason(text: Column, raw_label: Column) -> Column:
    """Why a loaded row is dropped; null for a good row."""
    label = normalize(raw_label)
    return (
        F.when(blank(text), "empty_text")
        .when(blank(raw_label), "empty_label")
        .when(label.isNull(), "unknown_label")
        .when(label == "neutral", "neutral_label")
        .when(F.length(trim(text)) > MAX_TEXT, "text_too_long")
    )


def invalid_reason(text: Column, confidence: Column) -> Column:
    return (
        F.when(blank(text), "blank_text")
        .when(F.length(text) > MAX_TEXT, "text_too_long")
        .when(confidence.isNull() | ~confidence.between(0, 1), "confidence_out_of_range")
    )


def with_threshold(label: Column, confidence: Column, threshold: Column) -> Column:
    """``uncertain`` where the caller's threshold is not met."""
    return F.when(confidence < threshold, "uncertain").otherwise(label)


def confidence_warning(confidence: Column) -> Column:
    return F.when(confidence < WARNING_CONFIDENCE, "low confidence")


def direction(weight: Column) -> Column:
    return F.when(weight > 0, "positive").when(weight < 0, "negative").otherwise("neutral")
