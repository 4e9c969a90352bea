"""Declared constraints as reports: an empty report means the data is clean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) of required columns that hold NULLs, from one scan."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).filter("nulls > 0")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(value, n) of references without a parent; NULL refers to nothing and is fine.

    The child is counted per value first, so a value shared by many rows is one
    row in the anti-join.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_column).alias("value"))
    return used.join(known, "value", "left_anti")
