"""Scalar, text, calendar and vector expressions. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_department(name: Column) -> Column:
    """Lower-case a department and fold every run of other characters to ``_``."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_")


def sales_year(date: Column, iso_year: bool = False) -> Column:
    """Year that a sales week is booked in.

    Week 52/53 seen in January belongs to the previous year. The opposite case,
    week 1 seen in December, stays in the calendar year unless ``iso_year``.
    """
    if iso_year:
        return F.extract(F.lit("YEAROFWEEK"), date).cast("int")
    late_week_in_january = (F.weekofyear(date) > 51) & (F.month(date) == 1)
    return F.when(late_week_in_january, F.year(date) - 1).otherwise(F.year(date))


def iso_weekday(date: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(date) + 1


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rating_scale(score: Column) -> Column:
    """Round a raw score to a whole rating between 1 and 5."""
    return clip(round_half_even(score), 1.0, 5.0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_distance(a: Column, b: Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda total, x: total + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def local_day_start(ts_utc: Column, zone: str) -> Column:
    """UTC start of the local calendar day that holds a UTC timestamp (no zone type)."""
    day = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc).cast("date")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def tokens(text: Column, drop_numeric: bool = False) -> Column:
    """Lower-cased words of a text; NULL when none are left.

    Everything but ASCII letters, digits and white space is dropped, then the
    text is cut at single blanks, so a tab or line break stays inside a token.
    """
    words = F.split(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")), " ")
    kept = F.filter(words, lambda w: w != "")
    if drop_numeric:
        kept = F.filter(kept, lambda w: ~w.rlike(r"^\d+$"))
    return F.nullif(kept, F.array().cast("array<string>"))


def joined_values(value: str, separator: str = "|") -> Column:
    """Aggregate: the distinct values of a group in order, as one text. For columns of few distinct values."""
    return F.expr(f"listagg(DISTINCT {value}, '{separator}') WITHIN GROUP (ORDER BY {value})")


def matrix_rows(values: Column, width: int) -> Column:
    """Cut a flat array into consecutive rows of ``width`` values (a 2-D array)."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(values) / F.lit(width)) - 1)
    return F.transform(starts, lambda i: F.slice(values, (i * width + 1).cast("int"), width))


def each_token(df: DataFrame, keep: Sequence[str], words: str | Column, alias: str = "token") -> DataFrame:
    """One row per token of a token list; rows without tokens disappear.

    The outer explode and the filter behind it are deliberate: for a plain explode
    the optimizer adds a filter on the list, which would build every list again.
    """
    return df.select(*keep, F.explode_outer(words).alias(alias)).filter(F.col(alias).isNotNull())
