"""The user-defined-function surface: scalar, table and aggregate functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.quantiles import counted_median


@F.pandas_udf(T.IntegerType())
def pymax(a: pd.Series, b: pd.Series) -> pd.Series:
    """Larger of two integers, batch-wise. ``greatest`` does the same inside the JVM."""
    return a.where(a > b, b)


_TOKEN = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("token", T.StringType())])


@F.udtf(returnType=_TOKEN)
class SplitTokens:
    """Table function: the words of a text with their 1-based position."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate((w for w in text.split(" ") if w), start=1)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udf.register("pymax", pymax)
    spark.udf.register("counted_median", counted_median)
    spark.udtf.register("split_tokens", SplitTokens)
