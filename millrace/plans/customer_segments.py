"""Use case 01: customer segments from return ratio and order frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import clustering, scaling
from millrace.session import materialise

SCALED = ["returnratio", "frequency"]
COORDINATES = ["frequency", "returnratio"]


def order_values(lineitem: DataFrame, order_returns: DataFrame) -> DataFrame:
    """Per order: value of its lines and value of what came back.

    Lines and returns meet on (order, product), and every line of a pair meets
    every return of that pair. Both sides are summed per pair first, so a pair
    with many lines and many returns stays one row and the products are exact.
    """
    pair = ["order_id", "product_id"]
    lines = (
        lineitem.select(
            F.col("li_order_id").alias("order_id"), F.col("li_product_id").alias("product_id"), "quantity", "price"
        )
        .groupBy(*pair)
        .agg(F.sum(F.col("quantity") * F.col("price")).alias("amount"), F.sum("price").alias("prices"))
    )
    returns = (
        order_returns.groupBy(F.col("or_order_id").alias("order_id"), F.col("or_product_id").alias("product_id"))
        .agg(F.count(F.lit(1)).alias("matches"), F.sum(F.coalesce("or_return_quantity", F.lit(0))).alias("returned"))
    )
    met = lines.join(returns, pair, "left")
    return met.groupBy("order_id").agg(
        F.sum(F.col("amount") * F.coalesce("matches", F.lit(1))).alias("row_price"),
        F.sum(F.col("prices") * F.coalesce("returned", F.lit(0))).alias("return_row_price"),
    )


def features(tables: dict[str, DataFrame], zero_price: str = "raise") -> DataFrame:
    """(customerid, returnratio, frequency) before scaling.

    returnratio is the mean over orders of returned / bought value, frequency the
    mean over years of the number of orders. ``zero_price="null"`` skips orders
    worth nothing instead of failing on the division.
    """
    orders = tables["order"].filter(F.col("o_customer_sk").isNotNull())
    orders = orders.select(F.col("o_order_id").alias("order_id"), "o_customer_sk", F.year("date").alias("year"))
    bought, returned = F.col("row_price").cast("double"), F.col("return_row_price").cast("double")
    ratio = returned / bought if zero_price == "raise" else F.try_divide(returned, bought)
    per_order = order_values(tables["lineitem"], tables["order_returns"]).join(orders, "order_id")
    per_year = per_order.groupBy("o_customer_sk", "year").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(ratio).alias("ratios"), F.count(ratio).alias("rated")
    )
    return per_year.groupBy(F.col("o_customer_sk").alias("customerid")).agg(
        F.try_divide(F.sum("ratios"), F.sum("rated")).alias("returnratio"), F.avg("orders").alias("frequency")
    )


def preprocess(tables: dict[str, DataFrame], scaler: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scaled features, scaler); the scaler is fitted only when none is given.

    Fitting reads the features once more, so they are stored first: one row per
    customer, against a second pass over all sales lines.
    """
    raw = features(tables)
    if scaler is None:
        raw = materialise(raw)
        scaler = scaling.minmax_fit(raw, SCALED)
    return scaling.minmax_apply(raw, scaler, SCALED), scaler


def train(prepared: DataFrame, seed: int = 1, **settings) -> DataFrame:
    """One row with the centroids."""
    return clustering.fit(prepared, "customerid", COORDINATES, **{"k": 4, "max_iter": 300, "seed": seed, **settings})


def score(prepared: DataFrame, centroids: DataFrame) -> DataFrame:
    return clustering.simplified_silhouette(prepared, centroids, COORDINATES)


def serve(prepared: DataFrame, centroids: DataFrame) -> DataFrame:
    return clustering.assign(prepared, centroids, COORDINATES)
