"""Scorers: from text to (sentiment_score, label, confidence)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodwire.functions.labels import DEFAULT_LABELS, keyword_sentiment, score_logits

Scorer = Callable[[DataFrame], DataFrame]
"""Takes ``text``-bearing rows, gives them sentiment_score, label and confidence."""

BATCH_TEXTS = 64


def keyword_scorer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", keyword_sentiment(F.col("text"))).select(
        *rows.columns, "_s.sentiment_score", "_s.label", "_s.confidence"
    )


def load_labels(path: str | None) -> list[str]:
    """Class names of a model, in logit order; the default three when there is no file."""
    if path is None or not os.path.exists(path):
        return list(DEFAULT_LABELS)
    with open(path, encoding="utf-8") as handle:
        labels = json.load(handle)["labels"]
    if not labels:
        raise ValueError("the label list must not be empty")
    return labels


def logits_scorer(labels: list[str]) -> Scorer:
    """For rows that already carry ``logits``."""

    def score(rows: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in labels])
        return rows.withColumn("_s", score_logits(F.col("logits"), names)).select(
            *rows.columns, "_s.sentiment_score", "_s.label", "_s.confidence"
        )

    return score


def model_scorer(load: Callable, labels: list[str], batch: int = BATCH_TEXTS) -> Scorer:
    """Classifier scorer. ``load()`` gives texts → logits and is called once per task.

    The score is a pure function of the text, so each distinct text is classified once. Rows and
    scores meet on the text's SHA-256, so the text itself is shuffled a single time.
    """

    def logits_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                logits = run(part["text"].tolist())
                yield pd.DataFrame({"_digest": part["_digest"], "logits": logits})

    def score(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_digest", F.sha2("text", 256))
        texts = keyed.groupBy("_digest").agg(F.any_value("text").alias("text"))
        logits = texts.mapInPandas(logits_of, "_digest string, logits array<double>")
        scored = logits_scorer(labels)(logits).drop("logits")
        return keyed.join(scored, "_digest").select(
            *rows.columns, "sentiment_score", "label", "confidence"
        )

    return score


def drift(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Confusion counts and, on every row, the accuracy of its expected class.

    ``predicted`` is (key, label), ``expected`` is (key, label).
    """
    pairs = predicted.withColumnRenamed("label", "predicted").join(
        expected.withColumnRenamed("label", "expected"), "key"
    )
    cells = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    totals = cells.groupBy("expected").agg(
        F.sum("n").alias("class_total"),
        F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias(
            "class_right"
        ),
    )
    return cells.join(totals, "expected").select(
        "expected",
        "predicted",
        "n",
        (F.col("class_right") / F.col("class_total")).alias("class_accuracy"),
    )
