"""Bookkeeping of runs: timings, scores, artefacts, and comparisons between runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.quantiles import grouped_quantiles
from millrace.sources.numbering import row_ids
from millrace.sources.tables import size_text, stored_bytes

TIMINGS = "use_case string, step string, start_time timestamp, end_time timestamp, execution_time string"
SCORES = "usecase int, date_time timestamp, evaluation_score double"
ARTEFACTS = "item_name string, columns array<string>, n_rows long, n_bytes long, size string"
# what a snapshot numbers its rows by
ORDER = {"timeit": ["start_time", "use_case", "step"], "score_results": ["date_time", "usecase"], "table_properties": ["item_name"]}


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.ffffff; hours are not cut at a day."""
    micros = F.round(seconds * 1_000_000).cast("long")  # rounded before it is split, so a second can be carried
    whole = F.floor(micros / 1_000_000)
    return F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, micros % 1_000_000)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def percent_change(value: Column, base: Column) -> Column:
    return (value - base) / base * 100


class RunLog:
    """Three append-only tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    @contextmanager
    def step(self, use_case: str, step: str) -> Iterator[None]:
        """Time a block; it must contain the action, since plans alone cost nothing."""
        start = datetime.now(timezone.utc)
        yield
        end = datetime.now(timezone.utc)
        s = (end - start).total_seconds()
        text = f"{int(s // 3600):02d}:{int(s // 60) % 60:02d}:{int(s % 60):02d}.{int(s * 1e6) % 1_000_000:06d}"
        self._append("timeit", [(use_case, step, start, end, text)], TIMINGS)

    def score(self, usecase: int, value: float | None) -> None:
        self._append("score_results", [(usecase, datetime.now(timezone.utc), value)], SCORES)

    def artefact(self, name: str, path: str) -> None:
        """Columns, rows and size of a stored result. A keyed model table counts its models."""
        df = self.spark.read.parquet(path)
        size = stored_bytes(self.spark, path)
        self._append("table_properties", [(name, df.columns, df.count(), size, size_text(size))], ARTEFACTS)

    def artefacts(self, like: str | None = None, not_like: str | None = None) -> DataFrame:
        """Listed results by LIKE pattern; a backslash escapes a wildcard."""
        listed = self.read("table_properties")
        if like is not None:
            listed = listed.filter(F.col("item_name").like(like))
        if not_like is not None:
            listed = listed.filter(~F.col("item_name").like(not_like))
        return listed

    def snapshot(self, prefix: str, folder: str) -> DataFrame:
        """Copy the three tables, with row numbers, to ``<folder>/<prefix>_*``; returns the total run time."""
        for table, order in ORDER.items():
            numbered = row_ids(self.read(table), order, "id")
            numbered.write.mode("overwrite").parquet(f"{folder}/{prefix}_{table}")
        return total_time(self.spark.read.parquet(f"{folder}/{prefix}_timeit"))


def total_time(timings: DataFrame) -> DataFrame:
    seconds = elapsed_seconds(F.col("start_time"), F.col("end_time"))
    return timings.agg(F.sum(seconds).alias("seconds")).withColumn("total", clock(F.col("seconds")))


def _side_by_side(runs: dict[str, DataFrame], keys: Sequence[str], value: str, suffix: str) -> DataFrame:
    joined = None
    for name, run in runs.items():
        part = run.select(*keys, F.col(value).alias(f"{name}_{suffix}"))
        joined = part if joined is None else joined.join(part, [*keys])
    return joined


def compare_durations(runs: dict[str, DataFrame], keys: Sequence[str] = ("use_case", "step")) -> DataFrame:
    """Duration of each step in every run, with ratio and percentage change to the first run.

    ``runs`` maps a run name to (keys, seconds), one row per step, first run first.
    """
    names = list(runs)
    base = F.col(f"{names[0]}_seconds")
    joined = _side_by_side(runs, keys, "seconds", "seconds")
    for name in names[1:]:
        here = F.col(f"{name}_seconds")
        joined = joined.withColumn(f"{name}_{names[0]}_ratio", here / base)
        joined = joined.withColumn(f"{name}_{names[0]}_percentage_change", percent_change(here, base))
    return joined.withColumns({f"{n}_duration": clock(F.col(f"{n}_seconds")) for n in names})


def compare_scores(runs: dict[str, DataFrame], key: str = "usecase") -> DataFrame:
    """Score of each use case in every run, with the percentage change to the first run as text."""
    names = list(runs)
    joined = _side_by_side(runs, [key], "evaluation_score", "score")
    base = F.col(f"{names[0]}_score")
    for name in names[1:]:
        change = percent_change(F.col(f"{name}_score"), base)
        joined = joined.withColumn(f"{name}_to_{names[0]}_percentage", F.format_string("%.2f%%", change))
    return joined


def compare_sizes(runs: dict[str, DataFrame]) -> DataFrame:
    """Size of each artefact in every run, in bytes and as text."""
    wide = _side_by_side(runs, ["item_name"], "n_bytes", "n_bytes")
    return wide.join(_side_by_side(runs, ["item_name"], "size", "size"), "item_name")


def statistics(timings: DataFrame, query: str = "query", seconds: str = "seconds") -> DataFrame:
    """Per query: mean, stdev, cv %, qcod %, iqr, median, min, max of the run times."""
    t = F.col(seconds)
    moments = timings.groupBy(query).agg(
        F.count(seconds).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("stdev"),
        F.min(t).cast("double").alias("min"), F.max(t).cast("double").alias("max"),
    )
    quartiles = grouped_quantiles(timings, [query], seconds, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quartiles, query).select(
        query, "n", "mean", "stdev",
        (F.try_divide(F.col("stdev"), F.col("mean")) * 100).alias("cv_pct"),
        (F.try_divide(F.col("q3") - F.col("q1"), F.col("q3") + F.col("q1")) * 100).alias("qcod_pct"),
        (F.col("q3") - F.col("q1")).alias("iqr"), "median", "min", "max",
    )


def geometric_mean(stats: DataFrame, column: str = "median") -> DataFrame:
    return stats.agg(F.exp(F.avg(F.log(column))).alias("geo_mean"))


def throughput(timings: DataFrame, query: str = "query", stream: str = "stream", seconds: str = "seconds") -> DataFrame:
    """Queries per hour from the slowest run of each query: per stream, then summed.

    ``timings`` has one row per (stream, query, run); one stream answers n queries
    in the sum of their maxima, that is n * 3600 / sum queries per hour.
    """
    slowest = timings.groupBy(stream, query).agg(F.max(seconds).cast("double").alias("slowest"))
    per_stream = slowest.groupBy(stream).agg(F.count(query).alias("n"), F.sum("slowest").alias("total"))
    return per_stream.agg(
        F.count(F.lit(1)).alias("streams"), F.sum("total").alias("sum_of_maxima"),
        F.sum(F.col("n") * 3600.0 / F.col("total")).alias("queries_per_hour"),
    )


def throughput_by_span(timings: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Queries per hour over all streams, by the wall-clock span of the whole run."""
    span = elapsed_seconds(F.min(start), F.max(end))
    return timings.agg((F.count(F.lit(1)) * 3600.0 / span).alias("queries_per_hour"))
