"""Change of a metric per local calendar day, in batch and as a stream.

The value of a bucket is its last reading minus its first one in time order,
rounded to two digits. ``ts`` is a UTC timestamp without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.expressions import local_day_start, round_half_even


def _change(ts: str, value: str, tie: str) -> Column:
    """last - first by (ts, tie); both aggregates combine before the shuffle.

    Time and tie-breaker make one number, as a struct would need sorted input to aggregate.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)).cast("decimal(17,0)")
    behind = F.coalesce(F.col(tie).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)") + 1, F.lit(0))
    at = micros * F.lit("100000000000000000000").cast("decimal(21,0)") + behind
    gap = F.max_by(value, at) - F.min_by(value, at)
    return round_half_even(gap * 100.0) / 100.0


def daily_change(
    df: DataFrame, keys: list[str], ts: str, value: str, tie: str, zone: str = "Europe/Berlin"
) -> DataFrame:
    """(time = UTC start of the local day, keys, value); ``tie`` orders equal timestamps."""
    day = local_day_start(F.col(ts), zone).alias("time")
    return df.groupBy(day, *keys).agg(_change(ts, value, tie).alias("value"))


def daily_change_stream(
    df: DataFrame, keys: list[str], ts: str, value: str, tie: str,
    zone: str = "Europe/Berlin", delay: str = "1 hour",
) -> DataFrame:
    """The same aggregate over a stream; a day is emitted once the watermark passed it.

    The event time is the local time, so that a window of one day is a local day.
    Local time repeats one hour in autumn, hence a delay of at least one hour.
    State is one row per open day and key.
    """
    # windows and watermarks want an instant: local wall-clock time counted as if it were UTC
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    local = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))
    midnight = F.timestamp_add("MICROSECOND", F.unix_micros("_day.start"), epoch)
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)
    return (
        df.withColumn("_local", local)
        .withWatermark("_local", delay)
        .groupBy(F.window("_local", "1 day").alias("_day"), *keys)
        .agg(_change(ts, value, tie).alias("value"))
        .select(start.alias("time"), *keys, "value")
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into a Parquet folder; restart-safe and exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, outside the executor heap."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
