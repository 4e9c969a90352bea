"""Loading whole splits: every table is staged and checked before any is published."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import configure, size_shuffles, stored_size
from millrace.sources import checks, delimited, numbering
from millrace.sources.schemas import FOLDERS, SPLITS, TABLES, file_name

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str, table: str, split: str) -> DataFrame:
    """One file as its declared table: repaired, deduplicated, numbered, typed."""
    spec = TABLES[table]
    customer = table == "customer"
    rows = delimited.read_text_columns(spark, path, repair=customer, keep_bad_bytes=customer)
    if spec.dedup:
        rows = delimited.keep_first(rows, list(spec.key), "_order")
    if spec.serial and spec.serial not in rows.columns:
        rows = numbering.load_ids(rows, "_order", spec.serial)
    return delimited.conform(rows, spec.schema(split))


def violations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All declared constraints of a split that some row breaks, as named reports."""
    reports = {}
    for name, df in tables.items():
        spec = TABLES[name]
        if spec.key:
            reports[f"{name}: duplicate key"] = checks.duplicate_keys(df, spec.key)
        if spec.required:
            reports[f"{name}: missing value"] = checks.null_counts(df, spec.required)
        for column, parent, parent_column in spec.references:
            if parent in tables:
                reports[f"{name}.{column}: no such {parent}"] = checks.orphans(df, column, tables[parent], parent_column)
    return {name: report for name, report in reports.items() if not report.isEmpty()}


def load(
    spark: SparkSession, source: str, target: str, folders: Iterable[str] = tuple(FOLDERS), enforce: bool = True
) -> str:
    """Load every file found under ``source/<folder>`` and publish them together.

    All tables of all splits are written under a new version folder and checked.
    Only then one row is appended to the list of published versions, which is
    what readers look at: a failed load leaves the previous version in place.
    """
    version = uuid.uuid4().hex
    for folder in folders:
        split = FOLDERS[folder]
        staged = {}
        for table, spec in TABLES.items():
            if split not in spec.splits:
                continue
            path = delimited.find_file(spark, f"{source}/{folder}", file_name(table))
            if path is None:
                log.warning("%s not found in %s", file_name(table), folder)
                continue
            out = f"{target}/versions/{version}/{split}/{table}"
            read_table(spark, path, table, split).write.mode("overwrite").parquet(out)
            staged[table] = spark.read.parquet(out)
        broken = violations(staged) if enforce else {}
        if broken:
            raise ValueError(f"split {split} breaks: {', '.join(sorted(broken))}")
    published = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    published.write.mode("append").parquet(f"{target}/published")
    return version


def tables(spark: SparkSession, target: str, split: str) -> dict[str, DataFrame]:
    """The tables of a split in the latest published version; sizes the shuffles to them."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}")
    latest = spark.read.parquet(f"{target}/published").orderBy(F.desc("published_at")).first()
    base = f"{target}/versions/{latest.version}/{split}"
    found = {}
    for name, spec in TABLES.items():
        if split in spec.splits:
            try:
                found[name] = spark.read.parquet(f"{base}/{name}")
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
    size_shuffles(configure(spark), sum(stored_size(df) for df in found.values()))
    return found
