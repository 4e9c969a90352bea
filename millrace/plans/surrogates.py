"""The provided tables seen as the tables the use cases expect.

Sales come from orders and lineitem (returns are the lines flagged ``R``), devices
are the users of the event log by day, reviews are the documents with a toxicity
label, payments are events, ratings are (customer, part) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import size_shuffles, stored_size


class Source:
    """Provided tables of one folder. Opening a table makes sure the shuffles fit it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.sizes: dict[str, int] = {}

    def __getitem__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in self.sizes:
            self.sizes[name] = stored_size(table)
            size_shuffles(self.spark, sum(self.sizes.values()))
        return table


def lineitem(src: Source) -> DataFrame:
    return src["lineitem"].select(
        F.col("l_orderkey").alias("li_order_id"),
        F.col("l_partkey").alias("li_product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )


def order_returns(src: Source) -> DataFrame:
    return src["lineitem"].filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("or_order_id"),
        F.col("l_partkey").alias("or_product_id"),
        F.col("l_quantity").cast("int").alias("or_return_quantity"),
    )


def orders(src: Source) -> DataFrame:
    """Orders with the first character of the priority as trip type."""
    return src["orders"].select(
        F.col("o_orderkey").alias("o_order_id"),
        F.col("o_custkey").alias("o_customer_sk"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("trip_type"),
    )


def store_orders(src: Source) -> DataFrame:
    """Orders with the customer's region as store."""
    regions = src["customer"].join(src["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    regions = regions.select(F.col("c_custkey").alias("o_customer_sk"), F.col("n_regionkey").alias("store"))
    return orders(src).join(regions, "o_customer_sk")


def products(src: Source, department: str = "p_type") -> DataFrame:
    return src["part"].select(
        F.col("p_partkey").alias("p_product_id"), F.col("p_name").alias("name"), F.col(department).alias("department")
    )


def retail(src: Source) -> dict[str, DataFrame]:
    return {"lineitem": lineitem(src), "order_returns": order_returns(src), "order": orders(src)}


def stores(src: Source) -> dict[str, DataFrame]:
    return {"lineitem": lineitem(src), "order": store_orders(src), "product": products(src)}


def baskets(src: Source) -> dict[str, DataFrame]:
    tables = {"lineitem": lineitem(src), "order": orders(src), "product": products(src, "p_brand")}
    return {**tables, "store_dept": tables["product"].select("department").distinct()}


def store_dept_labels(src: Source) -> DataFrame:
    """Observed sales per store, department and week (dated by its Monday)."""
    t = stores(src)
    return (
        t["lineitem"].join(t["product"], F.col("li_product_id") == F.col("p_product_id"))
        .join(t["order"], F.col("li_order_id") == F.col("o_order_id"))
        .groupBy("store", "department", F.trunc("date", "week").alias("date"))
        .agg(F.sum(F.col("quantity") * F.col("price")).cast("double").alias("weekly_sales"))
    )


def store_requests(src: Source, department: str) -> DataFrame:
    """Every (store, department) with sales, with a horizon of 1 + store weeks."""
    t = stores(src)
    listed = products(src, department)
    return (
        t["lineitem"].join(listed, F.col("li_product_id") == F.col("p_product_id"))
        .join(t["order"], F.col("li_order_id") == F.col("o_order_id"))
        .select("store", "department").distinct()
        .withColumn("periods", F.col("store") + 1)
    )


def reviews(src: Source) -> DataFrame:
    """All documents, as unlabelled reviews."""
    return src["documents"].select(F.col("doc_id").alias("id"), "text")


def review_labels(src: Source) -> DataFrame:
    return src["labels"].select(F.col("doc_id").alias("id"), F.col("toxic").alias("spam"))


def labelled_reviews(src: Source) -> DataFrame:
    return reviews(src).join(review_labels(src), "id").select("id", "spam", "text")


def device_days(src: Source) -> DataFrame:
    """One row per user and day; a day with an error event is a failure."""
    day = F.col("ts").cast("date")
    counted = src["events"].groupBy("user_id", day.alias("date")).agg(
        F.max((F.col("event_type") == "error").cast("int")).alias("failure"),
        F.count(F.lit(1)).cast("double").alias("smart_5_raw"),
        F.avg("value").alias("smart_10_raw"),
        F.min("value").alias("smart_184_raw"),
        F.max("value").alias("smart_187_raw"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("smart_188_raw"),
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("smart_197_raw"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("smart_198_raw"),
    )
    return counted.select(
        (F.col("user_id") * 100_000 + F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("id"),
        "date",
        F.col("user_id").cast("string").alias("serial_number"),
        F.concat(F.lit("M"), F.col("user_id") % 3).alias("model"),
        *[c for c in counted.columns if c not in ("user_id", "date")],
    )


def ratings(src: Source) -> DataFrame:
    """One rating of 1..5 per (customer, part) that met in an order."""
    bought = src["lineitem"].join(src["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return bought.groupBy(F.col("o_custkey").alias("userid"), F.col("l_partkey").alias("productid")).agg(
        (1 + F.sum("l_quantity").cast("int") % 5).alias("rating")
    )


def customer_factors(src: Source, all_known: bool = False) -> DataFrame:
    """Three fixed numbers per customer; those in debt stay unknown unless ``all_known``."""
    vector = F.array(
        F.col("c_custkey") % 7 / F.lit(7.0), F.col("c_nationkey") / F.lit(25.0), F.col("c_acctbal") / F.lit(10000.0)
    )
    known = src["customer"] if all_known else src["customer"].filter("c_acctbal >= 0")
    return known.select(F.col("c_custkey").alias("id"), vector.alias("features"))


def part_factors(src: Source) -> DataFrame:
    vector = F.array(
        F.col("p_size") / F.lit(10.0), F.col("p_retailprice") / F.lit(1000.0), F.col("p_partkey") % 11 / F.lit(3.0)
    )
    return src["part"].select(F.col("p_partkey").alias("id"), vector.alias("features"))


def brand_factors(src: Source) -> DataFrame:
    """Mean size and price per brand number: an item matrix of fixed size."""
    price = F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))
    return src["part"].groupBy(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("row_id")).agg(
        F.array(F.avg("p_size") / F.lit(10.0), price / F.lit(1000.0), F.lit(1.0)).alias("vals")
    )


def label_means(src: Source) -> DataFrame:
    """Mean vector of each embedding label: (id, vec)."""
    parts = src["embeddings"].select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(ordered, lambda p: p["x"]).alias("vec"))


def payments(src: Source) -> dict[str, DataFrame]:
    transactions = src["events"].select(
        F.col("event_id").alias("transactionid"),
        F.col("value").alias("amount"),
        F.col("user_id").alias("senderid"),
        F.col("ts").alias("time"),
        (F.col("event_type") == "error").alias("isfraud"),
    )
    accounts = src["customer"].select(
        F.col("c_custkey").alias("fa_customer_sk"), (F.abs("c_acctbal") + 1).cast("decimal(8,2)").alias("transaction_limit")
    )
    return {"financial_transactions": transactions, "financial_account": accounts}


def timings(src: Source) -> DataFrame:
    """The event log as a timing log: type = query, user = stream, value = seconds."""
    return src["events"].select(
        F.col("event_type").alias("query"), F.col("user_id").alias("stream"), F.col("value").alias("seconds"), "ts"
    )


def run_steps(src: Source) -> DataFrame:
    """Four runs (eight days each) with seconds per (use_case, step)."""
    return src["events"].groupBy(
        F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("run"),
        F.col("event_type").alias("use_case"),
        F.hour("ts").alias("step"),
    ).agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("seconds"))
