"""Several serving requests at the same time, each with its own output table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def serve_concurrently(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], folder: str, streams: int
) -> list[str]:
    """Run ``build`` once per stream and write ``<folder>/<name>_<stream>``.

    Every stream submits its jobs under a pool of its own, so that the fair
    scheduler, where it is on, shares the executors among them.
    """

    @inheritable_thread_target(spark)
    def one(stream: int) -> str:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}_{stream}")
        path = f"{folder}/{name}_{stream}"
        build().write.mode("overwrite").parquet(path)
        return path

    with ThreadPoolExecutor(max_workers=streams) as threads:
        return list(threads.map(one, range(1, streams + 1)))
