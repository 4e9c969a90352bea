"""Named queries over the provided tables, each with the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.surrogates import Source
from millrace.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


T = TypeVar("T")


def shared_fit(fit: Callable[[Source], T]) -> Callable[[Source], T]:
    """A fit that several queries use is made once per application and folder."""
    made: dict[tuple[str, str], T] = {}

    @functools.wraps(fit)
    def once(src: Source) -> T:
        key = (src.spark.sparkContext.applicationId, src.folder)
        if key not in made:
            made[key] = fit(src)
        return made[key]

    return once


def query(name: str, oracle: str | None = None):
    """Register ``build(source)`` under a name; without SQL only its rows are checked."""

    def add(build: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Source(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add
