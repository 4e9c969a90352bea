"""Use case 06: failing devices with a balanced kernel classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import kernel_svm, metrics, neighbours, sampling, scaling
from millrace.session import materialise

FEATURES = [
    "smart_5_raw", "smart_10_raw", "smart_184_raw", "smart_187_raw", "smart_188_raw", "smart_197_raw", "smart_198_raw",
]
DEVICE = ["serial_number", "model"]


def preprocess(failures: DataFrame, split: str) -> DataFrame:
    """Training: devices that fail at least once, with days to the last failure.

    The day before the last failure is relabelled as a failure. The one join on
    the devices' last failure both keeps the failing devices and brings the date.
    """
    if split in ("score", "serve"):
        return failures
    if split != "train":
        raise ValueError("split must be 'train', 'score' or 'serve'")
    last = failures.filter("failure = 1").groupBy(*DEVICE).agg(F.max("date").alias("_last"))
    days = F.datediff("_last", "date")
    label = F.when(F.col("ttf_int") == 1, F.lit(1)).otherwise(F.col("failure")).cast("int")
    return (
        failures.join(last, DEVICE)
        .withColumn("ttf_int", days)
        .withColumn("failure", label)
        .select(*failures.columns, "ttf_int")
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def balance_and_scale(
    prepared: DataFrame, features: Sequence[str] = tuple(FEATURES), label: str = "failure",
    method: str = "balance", id_column: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(balanced and standardised rows, scaler fitted on the balanced rows)."""
    require_columns(prepared, [*features, label])
    if method == "balance":
        balanced = sampling.balance_sample(prepared.select(id_column, *features, label), id_column, label)
    elif method == "adasyn":
        balanced = neighbours.adasyn(prepared, id_column, features, label)
    else:
        raise ValueError("method must be 'balance' or 'adasyn'")
    balanced = materialise(balanced)  # read by the scaler and again to apply it
    scaler = scaling.standard_fit(balanced, features)
    return materialise(scaling.standard_apply(balanced, scaler, features)), scaler


def train(
    prepared: DataFrame, adjust_params: bool = True, method: str = "balance", **svm
) -> tuple[kernel_svm.KernelSvm, DataFrame]:
    """(classifier, scaler). ``adjust_params`` switches the full parameter set on.

    Iteration limits are for quasi-Newton steps; the 100 000 row-by-row passes
    that an incremental gradient method is allowed have no counterpart here.
    """
    rows, scaler = balance_and_scale(prepared, method=method)
    full = {"reg_param": 1.0, "tol": 1e-3, "max_iter": 200, "balanced": True}
    plain = {"reg_param": 0.01, "tol": 1e-10, "max_iter": 100, "balanced": False}
    settings = {**(full if adjust_params else plain), **svm}
    return kernel_svm.fit(rows, FEATURES, "failure", **settings), scaler


def predict(prepared: DataFrame, model: kernel_svm.KernelSvm, scaler: DataFrame) -> DataFrame:
    return kernel_svm.predict(scaling.standard_apply(prepared, scaler, FEATURES), model, "id")


def compare(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.join(labels.select("id", "failure"), "id")


def score(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return metrics.mcc(compare(predicted, labels), "prediction", "failure")
