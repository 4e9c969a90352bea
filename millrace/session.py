"""Session settings and the one place that knows where checkpoints live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the runtime part of the scale work: it coalesces small
# shuffle partitions, turns sort-merge joins into broadcast joins once a side is
# measured to be small, and splits hot join partitions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Stored input per shuffle partition. Only the needed columns, and mostly partial
# sums of them, reach a shuffle, so a partition ends up well below this.
INPUT_PER_PARTITION = 1 << 28
_OWN_PARTITIONS = "spark.millrace.shuffle.partitions"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(_OWN_PARTITIONS, None) is None:
        spark.conf.set(_OWN_PARTITIONS, spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get(_OWN_PARTITIONS))
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Raise the number of shuffle partitions to fit the input; never go below the session's own.

    Adaptive execution joins partitions that turn out small, so the number only
    has to be large enough for the largest shuffle of a query.
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // INPUT_PER_PARTITION))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def stored_size(df: DataFrame) -> int:
    """Bytes of the files behind a freshly opened table, from the listing made when it was opened."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def local_session(cores: int | str = 8, app: str = "millrace") -> SparkSession:
    """A single-machine session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# of the running block; each thread has its own
_RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def owned_intermediates(spark: SparkSession) -> Iterator[str]:
    """Stored intermediates of the block go to a folder of its own, which is removed at the end.

    What the block returns must be written or collected inside it.
    """
    folder = f"{shared_folder(spark)}/millrace-run-{uuid.uuid4().hex}"
    token = _RUN_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _RUN_FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """The name of a folder for an intermediate; nothing is made yet."""
    return f"{_RUN_FOLDER.get() or shared_folder(spark)}/millrace-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder as a plain path, if it is one that any process can open; none if only Spark can."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return at.getPath() if at.getScheme() == "file" else None


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into a table of the shared folder and go on from there.

    Survives lost executors, cuts the lineage, and gives later plans a measured
    size (so a small result is broadcast) and a columnar scan.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
