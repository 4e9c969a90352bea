"""Multinomial naive Bayes on token lists, as joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import each_token

# The probabilities of a class sum to 1, so at most 1/_COMMON tokens per class can
# reach this value: the broadcast part of the model has at most 2/_COMMON rows.
_COMMON = 2e-5


def fit(documents: DataFrame, label: str = "spam", words: str = "text") -> DataFrame:
    """(token, spam_prob, non_spam_prob) with add-one smoothing over the joint vocabulary."""
    counts = (
        each_token(documents, [label], words)
        .groupBy("token")
        .agg(F.count_if(F.col(label) == 1).alias("spam"), F.count_if(F.col(label) == 0).alias("non_spam"))
    )
    totals = counts.agg(
        F.struct(
            F.sum("spam").alias("spam"), F.sum("non_spam").alias("non_spam"), F.count("token").alias("vocabulary")
        )
    ).scalar()

    def smoothed(c: str) -> Column:
        return (F.col(c) + 1).cast("double") / (totals[c] + totals["vocabulary"])

    return counts.select("token", smoothed("spam").alias("spam_prob"), smoothed("non_spam").alias("non_spam_prob"))


def priors(documents: DataFrame, label: str = "spam") -> DataFrame:
    """One row: log share of each class among the training documents."""
    y = F.col(label)
    n = F.count(F.lit(1))
    # log is NULL for an absent class, which leaves its score NULL
    return documents.agg(
        F.log(F.count_if(y == 1) / n).alias("log_spam"), F.log(F.count_if(y == 0) / n).alias("log_non_spam")
    )


def predict(documents: DataFrame, model: DataFrame, log_priors: DataFrame, id_column: str = "id",
            words: str = "text") -> DataFrame:
    """(id, log_spam_score, log_non_spam_score, predicted_spam) for documents with a token.

    Common tokens carry most occurrences. They meet a small broadcast model where
    the text is read and are summed up per document at once; only the rare
    remainder is shuffled by token to the full-size model.
    """
    weights = model.select(
        "token",
        F.log("spam_prob").alias("s"),
        F.log("non_spam_prob").alias("h"),
        (F.greatest("spam_prob", "non_spam_prob") >= _COMMON).alias("common"),
    )
    common = F.broadcast(weights.filter("common").drop("common"))
    rare = weights.filter("NOT common").drop("common")
    occurrences = each_token(documents.withColumn("id", F.col(id_column)), ["id"], words)

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))

    near = sums(occurrences.join(common, "token", "left"))
    far = sums(occurrences.join(common, "token", "left_anti").join(rare, "token"))
    scores = sums(near.unionByName(far)).select(
        "id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("h", F.lit(0.0)).alias("h")
    )
    prior = log_priors.select(F.struct("log_spam", "log_non_spam")).scalar()
    spam, ham = F.col("s") + prior["log_spam"], F.col("h") + prior["log_non_spam"]
    return scores.select(
        F.col("id").alias(id_column),
        spam.alias("log_spam_score"),
        ham.alias("log_non_spam_score"),
        F.when(spam > ham, 1).otherwise(0).alias("predicted_spam"),
    )
