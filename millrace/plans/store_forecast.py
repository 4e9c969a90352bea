"""Use case 03: weekly sales per store and department, forecast per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.expressions import normalise_department, sales_year
from millrace.operators import arima, metrics

KEYS = ["store_id", "department_id"]
SCORE_STEPS = 52


def weekly_sales(tables: dict[str, DataFrame], iso_year: bool = False) -> DataFrame:
    """(week_index, store_id, department_id, total_sales): dense week numbers per series.

    The window orders weekly sums, not sales rows, so its partitions are as long
    as the calendar.
    """
    products = tables["product"].select(
        F.col("p_product_id").alias("li_product_id"), normalise_department(F.col("department")).alias("department_id")
    )
    orders = tables["order"].select(
        F.col("o_order_id").alias("li_order_id"),
        F.col("store").alias("store_id"),
        sales_year(F.col("date"), iso_year).alias("year"),
        F.weekofyear("date").alias("week"),
    )
    amount = F.col("quantity") * F.col("price")
    sums = (
        tables["lineitem"].select("li_order_id", "li_product_id", amount.alias("amount"))
        .join(products, "li_product_id")
        .join(orders, "li_order_id")
        .groupBy("store_id", "department_id", "year", "week")
        .agg(F.sum("amount").alias("total_sales"))
    )
    in_order = Window.partitionBy(*KEYS).orderBy("year", "week")
    return sums.select(
        F.row_number().over(in_order).cast("long").alias("week_index"),
        *KEYS,
        F.col("total_sales").cast("double").alias("total_sales"),
    )


def score_input(labels: DataFrame) -> DataFrame:
    """Observed weekly sales with the calendar week as week index."""
    return labels.select(
        F.col("store").cast("string").alias("store_id"),
        normalise_department(F.col("department")).alias("department_id"),
        F.col("weekly_sales").cast("double").alias("sales"),
        F.weekofyear("date").alias("week_index"),
    )


def train(weekly: DataFrame) -> DataFrame:
    return arima.fit(weekly, KEYS, "week_index", "total_sales")


def predict(model: DataFrame, steps: int = SCORE_STEPS) -> DataFrame:
    made = arima.forecast(model, KEYS, steps)
    return made.withColumn("store_id", F.col("store_id").cast("string"))


def compare(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Observed next to forecast, on store, department and week."""
    return observed.join(predicted, [*KEYS, "week_index"]).select(*KEYS, "sales", "forecast", "week_index")


def score(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    return metrics.log_error(compare(observed, predicted), "forecast", "sales")


def _requests(store_dept: DataFrame) -> DataFrame:
    return store_dept.select(
        F.col("store").cast("string").alias("store_id"),
        normalise_department(F.col("department")).alias("department_id"),
        "periods",
    )


def _by_text_key(model: DataFrame) -> DataFrame:
    return model.withColumn("store_id", F.col("store_id").cast("string"))


def serve(store_dept: DataFrame, model: DataFrame) -> DataFrame:
    """Forecast each requested series for its own number of periods."""
    asked = _requests(store_dept).join(_by_text_key(model), KEYS)
    return arima.forecast(asked, KEYS, F.col("periods"))


def unmatched(store_dept: DataFrame, model: DataFrame) -> DataFrame:
    """Requested series that have no model."""
    return _requests(store_dept).join(_by_text_key(model), KEYS, "left_anti").select(*KEYS)
