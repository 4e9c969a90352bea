"""Logistic regression on a few columns plus an intercept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(
    df: DataFrame, columns: Sequence[str], label: str, optimizer: str = "irls", max_iter: int = 100
) -> DataFrame:
    """One-row model table: ``coef`` = [intercept, one coefficient per column].

    ``irls``: iteratively reweighted least squares, which needs only a small
    moment matrix per pass. ``cg``: the gradient method of ``LogisticRegression``.
    Both reach the same optimum.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias(label))
    points = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(
        data.dropna()
    )
    if optimizer == "irls":
        estimator = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol=label, maxIter=max_iter, tol=1e-8, regParam=0.0
        )
    elif optimizer == "cg":
        estimator = LogisticRegression(labelCol=label, maxIter=max_iter, tol=1e-9, regParam=0.0)
    else:
        raise ValueError("optimizer must be 'irls' or 'cg'")
    model = estimator.fit(points.select("features", label))
    coef = [float(model.intercept), *[float(x) for x in model.coefficients]]
    summary = model.summary
    iterations = summary.numIterations if optimizer == "irls" else summary.totalIterations
    schema = "coef array<double>, num_iterations int"
    return df.sparkSession.createDataFrame([(coef, int(iterations))], schema)


def linear_score(columns: Sequence[str], coef):
    """intercept + coefficients * columns, as a column."""
    terms = [coef[i + 1] * F.col(c).cast("double") for i, c in enumerate(columns)]
    return coef[0] + sum(terms[1:], terms[0])


def predict(df: DataFrame, model: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """(id, prediction): true where the modelled probability exceeds one half."""
    coef = model.select("coef").scalar()
    return df.select(id_column, (linear_score(columns, coef) > 0).alias("prediction"))


def probability(df: DataFrame, model: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    coef = model.select("coef").scalar()
    return df.select(id_column, (1 / (1 + F.exp(-linear_score(columns, coef)))).alias("probability"))
