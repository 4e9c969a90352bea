"""Writing results: replace, append, partition by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a result table, replacing an older one, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a stored table; only file names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def size_text(size: int) -> str:
    """Bytes in the largest unit that leaves at least ten of it, rounded to whole units."""
    units = ("bytes", "kB", "MB", "GB", "TB", "PB")
    step = 0
    while step < len(units) - 1 and size >= 10 * 1024 ** (step + 1):
        step += 1
    return f"{(size + 1024**step // 2) // 1024**step} {units[step]}"


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_by_day(df: DataFrame, ts: str, path: str) -> None:
    """Metric rows in one folder per day, so a time range reads only its days."""
    day = df.withColumn("day", F.to_date(ts))
    # ranges are cut by a sample of the rows, so a busy day spreads over as many tasks as its share of them
    day.repartitionByRange("day", F.xxhash64(*df.columns)).write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
