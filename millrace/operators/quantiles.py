"""Exact quantiles per group when a group may be too large for one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a sketch first brackets each quantile within a guaranteed rank error. While a
bracket still holds more than ``MOST`` rows, the rows inside it are sketched again and the bracket
shrinks to the steps around the wanted rank, forty times a pass. Then all values outside the
brackets collapse to one counted row each, so at most about ``MOST`` rows of a group are ever ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.session import materialise

_ACCURACY = 20_000  # the sketch's rank error is at most rows / _ACCURACY


MOST = 1 << 16  # rows of a bracket that may be left to be ordered
_GRID = 128


def _narrowed(data: DataFrame, sketch: DataFrame, keys: Sequence[str], quantiles: Sequence[float], most: int) -> DataFrame:
    """The same brackets, none of which holds more than ``most`` rows unless they are all one value."""
    grid = [k / _GRID for k in range(_GRID + 1)]
    while True:
        ends, v = F.col("_ends"), F.col("v")
        measures = []
        for j in range(len(quantiles)):
            inside = (v >= ends[2 * j]) & (v <= ends[2 * j + 1])
            measures += [F.count_if(v < ends[2 * j]).alias(f"_below{j}"), F.count_if(inside).alias(f"_in{j}"), F.percentile_approx(F.when(inside, v), grid, 100 * _GRID).alias(f"_grid{j}")]
        joined = data.join(sketch, [*keys])
        sized = materialise(joined.groupBy(*keys).agg(F.first("_ends").alias("_ends"), F.first("_rows").alias("_rows"), *measures))
        wide = [(F.col(f"_in{j}") > most) & (ends[2 * j] < ends[2 * j + 1]) for j in range(len(quantiles))]
        made = []
        for j, q in enumerate(quantiles):
            position = F.lit(float(q)) * (F.col("_rows") - 1) - F.col(f"_below{j}")
            step = F.col(f"_in{j}") / _GRID
            low, high = F.floor(F.floor(position) / step).cast("int") - 1, F.ceil((F.ceil(position) + 1) / step).cast("int") + 1
            steps = F.col(f"_grid{j}")
            made.append(F.when(wide[j] & (low > 0), F.get(steps, low)).otherwise(ends[2 * j]))
            made.append(F.when(wide[j] & (high < _GRID), F.get(steps, high)).otherwise(ends[2 * j + 1]))
        after = materialise(sized.select(*keys, F.array(*made).alias("_ends"), "_rows", (F.greatest(*[w.cast("int") for w in wide], F.lit(0)) == 1).alias("_wide"), F.col("_ends").alias("_old")))
        sketch = after.select(*keys, "_ends", "_rows")
        if after.where("_wide AND _ends <> _old").isEmpty():
            return sketch


def _bracketed_counts(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], most: int = MOST, accuracy: int = _ACCURACY) -> DataFrame:
    """(keys, v, gap, n, _rows): values near a quantile one by one, the others lumped (gap = 1).

    The smallest and the largest value of a lump stay values of their own. In a group with so few
    rows that the slack spans no whole rank, the sketch is exact and a wanted rank is at most one
    outside its bracket, so it is such a value: one rule holds for groups of every size.
    """
    slack = 4.0 / accuracy
    ends = [p for q in quantiles for p in (max(0.0, q - slack), min(1.0, q + slack))]
    data = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    # stored, so that its size decides whether the raw rows have to move for the join
    sketch = materialise(
        data.groupBy(*keys).agg(F.percentile_approx("v", ends, accuracy).alias("_ends"), F.count("v").alias("_rows"))
    )
    # A bracket holds a known share of its group, so the largest group tells whether any can be too wide.
    if (sketch.agg(F.max("_rows")).first()[0] or 0) * 3 * slack > most:
        sketch = _narrowed(data, sketch, keys, quantiles, most)

    def place(lump: int | None) -> Column:
        alone = F.col("v") if lump is None else F.lit(None).cast("double")
        return F.struct(F.lit(-1 if lump is None else lump).alias("lump"), alone.alias("v"))

    at = F.when(F.col("v") < F.col("_ends")[0], place(0))
    for i in range(len(quantiles)):
        low, high = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        at = at.when(F.col("v") < low, place(i)).when(F.col("v") <= high, place(None))
    grouped = (
        data.join(sketch, [*keys])
        .withColumn("_at", at.otherwise(place(len(quantiles))))
        .groupBy(*keys, "_at")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("_rows").alias("_rows"))
    )

    def piece(v: str, gap: int, n: Column) -> Column:
        return F.struct(F.col(v).alias("v"), F.lit(gap).alias("gap"), n.cast("long").alias("n"))

    split = F.array(piece("lo", 0, F.lit(1)), piece("lo", 1, F.col("n") - 2), piece("hi", 0, F.lit(1)))
    pieces = F.when(F.col("lo") == F.col("hi"), F.array(piece("lo", 0, F.col("n")))).otherwise(split)
    return grouped.select(*keys, "_rows", F.inline(pieces)).filter("n > 0").select(*keys, "v", "gap", "n", "_rows")


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], most: int = MOST, accuracy: int = _ACCURACY
) -> DataFrame:
    """One row per group with a column per named quantile, linearly interpolated."""
    wanted = sorted(quantiles.items(), key=lambda item: item[1])
    counts = _bracketed_counts(df, keys, value, [q for _, q in wanted], most, accuracy)
    running = Window.partitionBy(*keys).orderBy("v", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("n").over(running))

    def at_rank(rank: Column) -> Column:
        hit = F.min(F.when(F.col("_upto") >= rank, F.struct("v", "gap")))
        return F.when(hit["gap"] == 0, hit["v"]).otherwise(F.raise_error(F.lit("quantile outside its bracket")))

    columns = []
    for name, q in wanted:
        position = F.lit(float(q)) * (F.col("_rows") - 1)
        low, high = at_rank(F.floor(position) + 1), at_rank(F.ceil(position) + 1)
        weight = F.max(position - F.floor(position))
        columns.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    return grouped_quantiles(df, keys, value, {alias: 0.5})


@F.pandas_udf(T.DoubleType())
def counted_median(value: pd.Series, n: pd.Series) -> float:
    """User-defined aggregate: median of values that come with their counts."""
    order = value.argsort()
    value, upto = value.iloc[order], n.iloc[order].cumsum()
    total = int(upto.iloc[-1])
    low = value.iloc[int((upto >= (total + 1) // 2).argmax())]
    high = value.iloc[int((upto >= total // 2 + 1).argmax())]
    return (low + high) / 2


def median_by_user_aggregate(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    """The same median through a registered Python aggregate.

    Python aggregates see a whole group at once, so they are fed the bracketed
    counts, never the raw group.
    """
    counts = _bracketed_counts(df, keys, value, [0.5])
    return counts.groupBy(*keys).agg(counted_median(F.col("v"), F.col("n").cast("double")).alias(alias))
