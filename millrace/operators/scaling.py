"""Column scaling with parameters kept as a table of one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fit(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """One scan for all columns, turned into one row per column."""
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[f(F.col(c)).cast("double").alias(n) for n, f in stats.items()])
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("p")).select(F.inline("p"))


def _parameters(params: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> Column:
    """The whole parameter table as one struct from a scalar subquery.

    Its size is fixed by ``columns``, so applying a scaler needs no join at all.
    """
    def pick(c: str, f: str) -> Column:
        return F.max(F.when(F.col("column_name") == c, F.col(f))).alias(f)

    per_column = [F.struct(*[pick(c, f) for f in fields]).alias(c) for c in columns]
    return params.agg(F.struct(*per_column).alias("p")).scalar()


def minmax_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fit(df, columns, {"min_value": F.min, "max_value": F.max})


def minmax_apply(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale with stored bounds; values outside them are not clipped."""
    p = _parameters(params, columns, ["min_value", "max_value"])

    def scaled(c: str) -> Column:
        low, high = p[c]["min_value"], p[c]["max_value"]
        return F.when(high == low, F.lit(0.0)).otherwise((F.col(c).cast("double") - low) / (high - low))

    return df.withColumns({c: scaled(c) for c in columns})


def standard_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fit(df, columns, {"mean": F.avg, "std": F.stddev_samp})


def standard_apply(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise with stored mean and sample deviation; a constant column becomes 0."""
    p = _parameters(params, columns, ["mean", "std"])

    def scaled(c: str) -> Column:
        mean, std = p[c]["mean"], p[c]["std"]
        return F.when(std == 0, F.lit(0.0)).otherwise((F.col(c).cast("double") - mean) / std)

    return df.withColumns({c: scaled(c) for c in columns})
