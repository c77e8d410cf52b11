"""Combining models: scores, tail trimming, votes, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize

SCORE_RANGES = 4096


def is_right(prediction: str = "prediction", label: str = "label") -> Column:
    return (F.col(prediction).cast("int") == F.col(label)).cast("int")


def accuracy(predicted: DataFrame, *keys: str) -> DataFrame:
    """Share of right predictions, per ``keys`` if given: (keys, n_test, accuracy)."""
    right = is_right().cast("double")
    return predicted.groupBy(*keys).agg(F.count("*").alias("n_test"), F.avg(right).alias("accuracy"))


def score_at(scores: DataFrame, place: int) -> float:
    """The accuracy at ``place`` (from 1) in ascending order, of (accuracy, n). Counts per score range find
    the range that holds the place; it is cut again until it holds one score, so no task ranks all of them."""
    inside = scores
    low, high = scores.agg(F.min("accuracy"), F.max("accuracy")).first()
    while low < high:
        part = F.floor((F.col("accuracy") - F.lit(low)) / F.lit(high - low) * F.lit(SCORE_RANGES))
        ranges = (
            inside.groupBy(F.least(part, F.lit(SCORE_RANGES - 1)).alias("range"))
            .agg(F.sum("n").alias("n"), F.min("accuracy").alias("low"), F.max("accuracy").alias("high"))
            .orderBy("range")
            .collect()
        )
        for held in ranges:
            if place <= held.n:
                break
            place -= held.n
        low, high = held.low, held.high
        inside = scores.filter(F.col("accuracy").between(low, high))
    return low


def trim_tails(models: DataFrame, tail: float) -> DataFrame:
    """Drop the models with the lowest and highest accuracy.

    With m models, ``t = max(1, int(m * tail))`` are meant to go at each end; models tied with
    the outermost kept score stay. Too few models for that: all stay. Models without accuracy go.
    """
    known = models.filter(F.col("accuracy").isNotNull())
    scores = materialize(known.groupBy("accuracy").agg(F.count("*").alias("n")), "scores")
    m = scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    t = max(1, int(m * tail))
    if t > m - t - 1:
        return known
    return known.filter(F.col("accuracy").between(score_at(scores, t + 1), score_at(scores, m - t)))


def majority_vote(predictions: DataFrame, key: str = "row_key") -> DataFrame:
    """Unweighted vote per row, the smallest label on ties: (key, prediction)."""
    return predictions.groupBy(key).agg(F.mode("prediction", True).alias("prediction"))


def weighted_vote(predictions: DataFrame, key: str = "row_key", score: str = "score") -> DataFrame:
    """Score-weighted mean label per row, rounded half up: (key, prediction)."""
    mean = F.sum(F.col(score) * F.col("prediction")) / F.sum(score)
    return predictions.groupBy(key).agg(F.floor(mean + F.lit(0.5)).cast("int").alias("prediction"))


def pooled_accuracy(per_block: DataFrame) -> DataFrame:
    """Mean of block accuracies weighted by their rows."""
    weighted = F.sum(F.col("accuracy") * F.col("n_test")) / F.sum("n_test")
    return per_block.agg(F.sum("n_test").alias("n_test"), weighted.alias("accuracy"))
