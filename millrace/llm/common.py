"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder

# Documents handed to Python at a time: rows and bytes are both bounded, since one text can be long.
BATCH_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A name, not yet used, in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/millrace-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Write to the shared folder and go on from there; survives lost executors and cuts the lineage."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path  # so that an iteration can drop what it has replaced
    return back


def drop_stored(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more for the end). Null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def row_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each row's UTF-8 bytes; null: empty."""
    data, starts = flat_bytes(column)
    whole = data.tobytes()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield whole[a:b]


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
