"""Label mapping and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodwire.functions.binding import let
from moodwire.functions.text import ascii_lower, utrim

# Label words and what they mean.
BULLISH_WORDS = ["positive", "bullish"]
BEARISH_WORDS = ["negative", "bearish"]
DEFAULT_LABELS = ["bullish", "bearish", "neutral"]


def _mapped(word: Column, otherwise: Column) -> Column:
    return (
        F.when(word.isin(BULLISH_WORDS), F.lit("bullish"))
        .when(word.isin(BEARISH_WORDS), F.lit("bearish"))
        .otherwise(otherwise)
    )


def answer_label(c: Column) -> Column:
    """Label of a model answer; anything unknown counts as neutral."""
    return _mapped(ascii_lower(utrim(c)), F.lit("neutral"))


def model_label(c: Column) -> Column:
    """Label of an exported classifier; unknown labels pass through lower-cased."""
    word = F.lower(utrim(c))
    return _mapped(word, word)


def keyword_sentiment(text: Column) -> Column:
    """Rule scorer: any ``bear`` in the text is bearish, all else neutral."""
    bear = F.contains(ascii_lower(text), F.lit("bear"))
    return F.struct(
        F.when(bear, F.lit(-0.5)).otherwise(F.lit(0.0)).alias("sentiment_score"),
        F.when(bear, F.lit("bearish")).otherwise(F.lit("neutral")).alias("label"),
        F.lit(0.5).alias("confidence"),
    )


def softmax(logits: Column) -> Column:
    """Softmax with the maximum taken off first: same value, no overflow."""
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return let(
        exps,
        lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
            lambda total: F.transform(e, lambda v: v / total),
        ),
    )


def sentiment_of_probabilities(probs: Column, labels: Column) -> Column:
    """(score, label, confidence) from class probabilities; equal maxima take the last class."""

    def p_of(probs: Column, name: str) -> Column:
        at = F.array_position(labels, F.lit(name)).cast("int")
        return F.when(at > 0, F.coalesce(F.get(probs, at - 1), F.lit(0.0))).otherwise(F.lit(0.0))

    def result(probs: Column, top: Column) -> Column:
        return F.struct(
            (p_of(probs, "bullish") - p_of(probs, "bearish")).alias("sentiment_score"),
            F.coalesce(F.get(labels, top["at"]), F.lit("neutral")).alias("label"),
            top["p"].alias("confidence"),
        )

    return let(
        probs,
        lambda p: let(
            F.array_max(F.transform(p, lambda v, i: F.struct(v.alias("p"), i.alias("at")))),
            lambda top: result(p, top),
        ),
    )


def score_logits(logits: Column, labels: Column) -> Column:
    return sentiment_of_probabilities(softmax(logits), labels)
