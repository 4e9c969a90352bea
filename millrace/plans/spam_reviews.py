"""Use case 04: spam reviews with naive Bayes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import tokens
from millrace.functions.stemming import stem_tokens
from millrace.operators import metrics, naive_bayes


def preprocess(review: DataFrame, stem: bool = True, drop_numeric: bool = False) -> DataFrame:
    """(id, [spam,] text as tokens); the label is kept when the table has one."""
    words = tokens(F.col("text"), drop_numeric)
    label = ["spam"] if "spam" in review.columns else []
    return review.select("id", *label, (stem_tokens(words) if stem else words).alias("text"))


def train(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token model, class priors)."""
    return naive_bayes.fit(prepared), naive_bayes.priors(prepared)


def predict(prepared: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    return naive_bayes.predict(prepared, model, priors)


def compare(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.join(labels.select("id", "spam"), "id")


def score(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return metrics.f1(compare(predicted, labels), "predicted_spam", "spam")
