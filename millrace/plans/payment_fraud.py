"""Use case 10: fraudulent payments with logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import logistic, metrics

FEATURES = ["business_hour_norm", "amount_norm"]


def preprocess(tables: dict[str, DataFrame]) -> DataFrame:
    """(transactionid, business_hour_norm, amount_norm, [isfraud]) of payments with a known sender."""
    payments = tables["financial_transactions"]
    accounts = tables["financial_account"].select("fa_customer_sk", "transaction_limit")
    label = [F.col("isfraud").cast("int").alias("isfraud")] if "isfraud" in payments.columns else []
    hour = F.hour("time") / 23
    amount = F.col("amount") / F.col("transaction_limit").cast("double")
    joined = payments.join(accounts, payments["senderid"] == accounts["fa_customer_sk"])
    return joined.select(
        "transactionid", hour.alias("business_hour_norm"), amount.alias("amount_norm"), *label
    )


def train(prepared: DataFrame, adjust_params: bool = False) -> DataFrame:
    """Model table; the default is the second-order method, ``adjust_params`` takes the gradient method."""
    return logistic.fit(prepared, FEATURES, "isfraud", optimizer="cg" if adjust_params else "irls", max_iter=100)


def predict(prepared: DataFrame, model: DataFrame) -> DataFrame:
    return logistic.predict(prepared, model, FEATURES, "transactionid")


def compare(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Every prediction, with the label where there is one."""
    truth = labels.select("transactionid", F.col("isfraud").cast("boolean").alias("true_value"))
    return predicted.join(truth, "transactionid", "left")


def score(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return metrics.accuracy(compare(predicted, labels), "prediction", "true_value")
