"""Delimited text files as typed DataFrames, with repair of known defects."""

from __future__ import annotations

import csv
import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.records import records
from millrace.sources.schemas import TABLES

DELIMITERS = (",", ";", "\t", "|")
# header width -> a row with one field more has its fields 10 and 11 joined
REPAIRED_WIDTHS = (12, 13)
SPLIT_FIELD = 10
TRUE_WORDS = ("t", "true", "1", "y", "yes", "on")
FALSE_WORDS = ("f", "false", "0", "n", "no", "off")

_ABSENT = "\u0001"  # stands for "no value at all", so an empty field stays distinguishable


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """Path of a file by name pattern, ignoring case; None when there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    hits = [f.getPath().toString() for f in system.listStatus(path) if fnmatch.fnmatchcase(f.getPath().getName().lower(), name.lower())]
    return min(hits, default=None)


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return "" if row is None else row.value.lstrip("\ufeff")


def detect_delimiter(header: str) -> str:
    return next((d for d in DELIMITERS if d in header), ",")


def _repair(df: DataFrame, names: list[str]) -> DataFrame:
    """Join the two halves of a field that was cut at an unquoted delimiter."""
    extra = F.col("_extra").isNotNull()

    def field(i: int) -> Column:
        here = F.col(names[i])
        after = F.col(names[i + 1]) if i + 1 < len(names) else F.col("_extra")
        if i < SPLIT_FIELD:
            return here
        if i == SPLIT_FIELD:
            return F.when(extra, F.concat_ws(", ", here, after)).otherwise(here)
        return F.when(extra, after).otherwise(here)

    return df.select(*[field(i).alias(n) for i, n in enumerate(names)], "_order")


def read_text_columns(
    spark: SparkSession, path: str, repair: bool = False, keep_bad_bytes: bool = False
) -> DataFrame:
    """All columns as text, lower-cased header names, plus ``_order``: (file, offset of the split, number inside it).

    Bytes that are not UTF-8 become U+FFFD, and are dropped unless ``keep_bad_bytes``. Quoted line
    breaks belong to their field, as \\n; a file is read by as many tasks as it has splits. A row with more
    or fewer fields than the header stops the load, unless it is of the width that ``repair`` mends.
    """
    header = first_line(spark, path)
    delimiter = detect_delimiter(header)
    names = [n.strip().lower() for n in next(csv.reader([header], delimiter=delimiter))]
    repair = repair and len(names) in REPAIRED_WIDTHS
    read_as = [*names, "_extra"] if repair else [*names, "_corrupt"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in read_as])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "nullValue": _ABSENT, "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    heading = (F.col("block") == 0) & (F.col("at") == 0)
    found = records(spark, path, delimiter).where(~heading)
    rows = found.select(F.from_csv("record", schema.toDDL(), options).alias("_row"), F.struct("file", "block", "at").alias("_order")).select("_row.*", "_order")
    if repair:
        rows = _repair(rows, names)
    else:
        wrong = F.raise_error(F.concat(F.lit(f"{path}: a row has not {len(names)} fields: "), F.col("_corrupt")))
        rows = rows.withColumn(names[0], F.when(F.col("_corrupt").isNotNull(), wrong.cast("string")).otherwise(F.col(names[0]))).drop("_corrupt")
    cleaned = {n: F.col(n) if keep_bad_bytes else F.regexp_replace(n, "\ufffd", "") for n in names}
    return rows.withColumns({n: F.when(c != "", c) for n, c in cleaned.items()})


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key in the given order.

    A grouped minimum rather than a window: copies of one key are already reduced
    where they are read, so a key with any number of copies costs one row per task.
    """
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), order).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared types; a declared column the file lacks becomes NULL."""
    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            word = F.lower(F.trim(text))
            bad = F.raise_error(F.concat(F.lit(f"{f.name} is no boolean: "), text)).cast("boolean")
            return (
                F.when(text.isNull(), F.lit(None).cast("boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(bad)
            ).alias(f.name)
        return text.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema])


def declared(table: str, split: str) -> T.StructType:
    """Declared column types of a table in a split."""
    return TABLES[table].schema(split)
